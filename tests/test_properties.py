"""Random inputs against naive Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from seqmodel.functions import text
from seqmodel.functions.stack import check_symbols
from seqmodel.operators import rules as pushdown
from seqmodel.operators import score
from seqmodel.operators.automaton import Model
from seqmodel.operators.rules import RULE_TYPE, Rules, rule_attempts


def naive_fields(line, delimiter):
    """Quotes toggle; inside, a doubled quote stands for one."""
    fields, field, inside, i = [], "", False, 0
    while i < len(line):
        two = line[i:i + 2]
        if inside and two == '""':
            field, i = field + '"', i + 2
            continue
        if line[i] == '"':
            inside = not inside
        elif line[i] == delimiter and not inside:
            fields.append(field)
            field = ""
        else:
            field += line[i]
        i += 1
    return [f.strip(" \t\n\x0b\f\r") for f in [*fields, field]]


def test_fields(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice('"",|ab \t') for _ in range(rng.randrange(14))) for _ in range(3000)]
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    for delimiter in "|,":
        got = df.select("line", text.split_fields(F.col("line"), delimiter).alias("f")).collect()
        assert all(r.f == naive_fields(r.line, delimiter) for r in got)


def test_symbol_texts(spark):
    cases = {"": ([], []), "a": (["a"], ["a"]), "a,": (["a"], ["a,"]), ",": ([""], [","]),
             " a ,, b\t,": (["a", "", "b"], ["a", ",,", "b", ","]), "a,,": (["a", ""], ["a,,"]),
             "a,\n": (["a", ""], ["a,"])}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    for r in df.select("s", text.symbols_from_commas(F.col("s")).alias("c"),
                       text.symbols_from_blanks(F.col("s")).alias("b")).collect():
        assert (r.c, r.b) == cases[r.s], r.s


def test_stack_fold(spark):
    rng = random.Random(2)
    seqs = [[rng.choice("+-.") for _ in range(rng.randrange(9))] for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in seqs], "symbols array<string>")
    got = df.select("symbols", check_symbols(F.col("symbols"), "+", "-").alias("c")).collect()
    for r in got:
        depth, bad = 0, None
        for i, s in enumerate(r.symbols):
            if s == "-" and depth == 0:
                bad = i
                break
            depth += {"+": 1, "-": -1}.get(s, 0)
        assert r.c.first_error == bad
        assert bad is not None or r.c.depth == depth


def naive_automaton(samples):
    """Trie with sink, refined until stable: (class of each node, number of classes, nodes)."""
    votes, nodes, symbols = {}, {()}, set()
    for seq, label in samples:
        votes.setdefault(seq, [0, 0])[0 if label else 1] += 1
        nodes |= {seq[:k] for k in range(len(seq) + 1)}
        symbols |= set(seq)
    sink = None
    go = lambda n, s: n + (s,) if n is not None and n + (s,) in nodes else None
    kind = {n: votes.get(n, [0, 0])[0] > votes.get(n, [0, 0])[1] for n in nodes}
    kind[sink] = False
    count = len(set(kind.values()))
    while True:
        sign = {n: (kind[n], *[kind[go(n, s)] for s in sorted(symbols)]) for n in kind}
        names = {v: i for i, v in enumerate(set(sign.values()))}
        kind = {n: names[sign[n]] for n in kind}
        if len(names) == count:
            return kind, count, nodes, votes
        count = len(names)


def test_merging_and_scoring(spark):
    rng = random.Random(3)
    for size in (1, 12, 80):
        samples = [(tuple(rng.choice("abc") for _ in range(rng.randrange(5))), rng.random() < 0.5)
                   for _ in range(size)] + [(("a",), True)]
        rows = [(list(s), label) for s, label in samples]
        model = Model.fit(spark.createDataFrame(rows, "symbols array<string>, label boolean"))
        kind, count, nodes, votes = naive_automaton(samples)
        assert model.states.count() == count
        ours = {tuple(r.prefix): r.state_id for r in model.named_prefixes().collect()}
        assert set(ours) == nodes
        pairs = {(kind[n], ours[n]) for n in nodes}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})

        tests = list({tuple(rng.choice("abcx") for _ in range(rng.randrange(6))) for _ in range(60)})
        df = spark.createDataFrame([(list(t),) for t in tests], "symbols array<string>")
        for r in score.classify(df, model).collect():
            pos, neg = votes.get(tuple(r.symbols), (0, 0))
            assert r.predicted == (pos > neg)

        delta = {(r.state_id, r.symbol): r.next_state_id for r in model.complete_transitions().collect()}
        accepting = {r.state_id: r.accepting for r in model.states.collect()}
        start = model.states.filter("is_start").first()["state_id"]
        first = rng.choice(sorted(accepting))
        for origin, found in ((start, score.classify_stay(df, model)),
                              (first, score.classify_stay(df, model, start=f"s{first}"))):
            for r in found.collect():
                state = origin
                for s in r.symbols:
                    state = delta.get((state, s), state)
                assert (r.final_state, r.verdict == "Malicious") == (f"s{state}", accepting[state])


def naive_search(rules, start, accepting, seq):
    """Plain breadth-first search; a configuration met again is not followed again."""
    queue, best, seen = deque([(start, 0, (), ())]), (0, ()), set()
    while queue:
        state, pos, stack, path = queue.popleft()
        if (state, pos, stack) in seen:
            continue
        seen.add((state, pos, stack))
        assert len(seen) < 100_000
        if pos > best[0]:
            best = (pos, path)
        if pos == len(seq) and state in accepting:
            return True, list(path)
        for no, source, inp, pop, push, target in rules:
            if source != state or (inp is not None and (pos == len(seq) or seq[pos] != inp)):
                continue
            if pop is not None and (not stack or stack[-1] != pop):
                continue
            kept = stack if pop is None else stack[:-1]
            queue.append((target, pos + (inp is not None), kept + tuple(reversed(push)), path + (no,)))
    return False, list(best[1])


def naive_trace(rules, path):
    """(stack, state before, state after) of every step."""
    stack, steps = [], []
    for no in path:
        _, source, _, pop, push, target = rules[no]
        stack = (stack if pop is None else stack[:-1]) + push[::-1]
        steps.append((stack, source, target))
    return steps


def random_rules(rng):
    """Input-free rules only lead to later states, so every search ends."""
    states, rules = "PQR", []
    for no in range(rng.randrange(3, 9)):
        source = rng.choice(states)
        inp = rng.choice(["a", "b", "b", None])
        later = [s for s in states if s > source]
        if inp is None and not later:
            inp = "a"
        target = rng.choice(later if inp is None else states)
        push = [rng.choice("XY") for _ in range(rng.randrange(3))]
        rules.append((no, source, inp, rng.choice([None, None, "X", "Y"]), push, target))
    return rules


@pytest.mark.parametrize("block, chunks, rounds", [(256, (100,), 4), (2, (100, 3), 3)])
def test_rule_search(spark, monkeypatch, block, chunks, rounds):
    monkeypatch.setattr(pushdown, "BLOCK_EVENTS", block)
    rng = random.Random(block)
    for _ in range(rounds):
        rows = random_rules(rng)
        rules = Rules.of(spark.createDataFrame(rows, RULE_TYPE), "P", ["R"])
        seqs = {i: [rng.choice("ab") for _ in range(rng.randrange(1, 6))] for i in range(25)}
        events = spark.createDataFrame(
            [(k, i, s) for k, seq in seqs.items() for i, s in enumerate(seq)], "id int, i int, symbol string"
        )
        want = {k: naive_search(rows, "P", {"R"}, seq) for k, seq in seqs.items()}
        for chunk_events in chunks:
            found = rule_attempts(events, "id", ["i"], "symbol", rules, chunk_events=chunk_events)
            assert {r.id: (r.accepted, r.path) for r in found.collect()} == want


def circling_rules(rng):
    """Any input-free rules; most of them pop."""
    rules = []
    for no in range(rng.randrange(3, 9)):
        inp = rng.choice(["a", "b", None, None])
        push = [rng.choice("XY") for _ in range(rng.choice([0, 0, 1, 1, 2]))]
        rules.append((no, rng.choice("PQR"), inp, rng.choice([None, "X", "Y"]), push, rng.choice("PQR")))
    return rules


def silent_runs(rules, state, stack):
    """Steps of the shortest input-free run to each configuration."""
    found, queue = {(state, stack): 0}, deque([(state, stack)])
    while queue:
        at, held = here = queue.popleft()
        for _, source, inp, pop, push, target in rules:
            if inp is None and source == at and (pop is None or held[-1:] == (pop,)):
                then = (target, (held if pop is None else held[:-1]) + tuple(reversed(push)))
                if then not in found:
                    found[then] = found[here] + 1
                    queue.append(then)
        assert len(found) < 20_000
    return found


def test_bound_of_runs_without_input():
    """Tables that pass have finite runs, no longer than the bound; from stacks that reading can bring about."""
    rng, passed, refused = random.Random(3), 0, 0
    for _ in range(1500):
        rows = circling_rules(rng)
        rules = Rules(rows, "P", ["R"])
        try:
            most, per_cell = rules.silent_bound()
        except ValueError:
            refused += 1
            continue
        passed += rules.empty_chain() is None
        frontier = {("P", ())}
        for _ in range(4):
            after = set()
            for state, stack in frontier:
                runs = silent_runs(rows, state, stack)
                assert max(runs.values()) < most + per_cell * len(stack)
                for at, held in runs:
                    for _, source, inp, pop, push, target in rows:
                        if inp is not None and source == at and (pop is None or held[-1:] == (pop,)):
                            after.add((target, (held if pop is None else held[:-1]) + tuple(reversed(push))))
            frontier = set(sorted(after)[:20])
    assert passed > 100 and refused > 100


@pytest.mark.parametrize("rows", [
    [(0, "P", None, None, ["X"], "P")],
    [(0, "P", None, None, ["X"], "Q"), (1, "Q", None, "X", ["X", "X"], "P"), (2, "P", None, "X", ["X"], "Q")],
    [(0, "P", "a", None, ["S"], "Q"), (1, "Q", None, "S", ["S", "X"], "Q")],
])
def test_rules_that_push_for_ever_are_refused(spark, rows):
    events = spark.createDataFrame([(1, 0, "a")], "id int, i int, symbol string")
    with pytest.raises(ValueError, match="without end"):
        rule_attempts(events, "id", ["i"], "symbol", Rules(rows, "P", ["Q"]))


@pytest.mark.parametrize("rows", [
    # a circle that changes nothing
    [(0, "P", None, None, [], "Q"), (1, "Q", None, None, [], "P"), (2, "Q", "a", None, [], "R")],
    # a circle that empties the stack
    [(0, "P", None, None, ["Z"], "Q"), (1, "Q", "a", None, ["X"], "Q"), (2, "Q", None, None, [], "R"),
     (3, "R", None, "X", [], "R"), (4, "R", "b", "Z", [], "P"), (5, "R", "b", "X", ["X", "X"], "R")],
    # expansion of the top symbol: S -> a S b, S -> a b
    [(0, "P", None, None, ["S"], "R"), (1, "R", None, "S", ["a", "S", "b"], "R"), (2, "R", None, "S", ["a", "b"], "R"),
     (3, "R", "a", "a", [], "R"), (4, "R", "b", "b", [], "R")],
    # a symbol pushed and popped again
    [(0, "P", None, None, ["X"], "Q"), (1, "Q", None, "X", [], "P"), (2, "Q", "a", None, [], "P"), (3, "P", "b", "X", [], "R")],
])
def test_rules_that_go_round_without_input(spark, rows):
    rng = random.Random(len(rows))
    rules = Rules(rows, "P", ["R"])
    seqs = {i: [rng.choice("aab") for _ in range(rng.randrange(1, 7))] for i in range(20)}
    seqs |= {20: list("aabb"), 21: list("aaab"), 22: list("ab")}
    events = spark.createDataFrame(
        [(k, i, s) for k, seq in seqs.items() for i, s in enumerate(seq)], "id int, i int, symbol string"
    )
    want = {k: naive_search(rows, "P", {"R"}, seq) for k, seq in seqs.items()}
    for chunk_events in (100, 3):
        found = rule_attempts(events, "id", ["i"], "symbol", rules, chunk_events=chunk_events)
        assert {r.id: (r.accepted, r.path) for r in found.collect()} == want
    steps = {}
    for r in pushdown.rule_step_trace(found, "id", rules).orderBy("id", "step").collect():
        steps.setdefault(r.id, []).append((r.stack_after, r.current_state, r.next_state))
    assert steps == {k: naive_trace(rows, path) for k, (_, path) in want.items() if path}


def test_trace_rows_of_a_long_run(spark):
    """Cells and steps of a deep stack have fixed size: as many rows as steps and pushes."""
    rows = [(0, "P", "a", None, ["X"], "P"), (1, "P", "b", "X", [], "P")]
    attempts = spark.createDataFrame([(1, [0] * 20_000 + [1] * 20_000), (2, []), (None, [0, 1])], "id int, path array<int>")
    steps = pushdown.rule_steps(attempts, "id", Rules(rows, "P", ["P"]))
    assert steps.count() == 40_002
    cells = {r[0]: r for r in pushdown.rule_stack_cells(steps, "id").filter("id = 1").select("level", "from_step", "to_step").collect()}
    assert len(cells) == 20_000
    assert all(r.from_step == level - 1 and r.to_step == 39_999 - level for level, r in cells.items())
