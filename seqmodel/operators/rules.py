"""Pushdown rules over a table of sequences.

A rule reads an input symbol (or none), pops a stack symbol (or none), pushes a list (the first one
ends on top) and goes to a next state. A sequence is accepted if some choice of rules consumes all
input and stands in an accepting state; the stack need not be empty. Among several ways the one with
fewest steps counts, then the one with the smaller rule numbers. If none is accepted the same order
picks the attempt that consumed most input.

A sequence is folded inside a row: the set of reachable configurations is an array that each symbol
maps to the next set, without a shuffle or a round trip. Sequences above ``CHUNK_EVENTS`` are cut into
chunks of that many symbols and folded chunk by chunk, with the configurations carried in between.
Rules whose input-free steps can go round in a circle are looked at before any data: what a run can do
depends on the state and the top of the stack alone, so the rule table says whether a circle can let the
stack grow (an error) and how many input-free steps the shortest way to any configuration has at most.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmodel.operators.ordered import ordered, parted_by_size
from seqmodel.operators.sessions import positions
from seqmodel.sources.scratch import written

# The empty-symbol mark and the operation names.
EMPTY = "ε"
OP_PUSH, OP_POP, OP_NONE = "PUSH", "POP", "NO_OP"

CHUNK_EVENTS = 65_536
BLOCK_EVENTS = 256

COLUMNS = ("rule_no", "state", "input", "pop", "push", "next_state")
RULE_TYPE = "struct<rule_no:int,state:string,input:string,pop:string,push:array<string>,next_state:string>"


def split_rule_label(label: Column) -> Column:
    """`input, pop -> push ...` to struct(input, pop, push); null is the empty symbol.

    A label without both the comma and the arrow is an input alone.
    """
    arrow, comma = F.instr(label, F.lit("->")), F.instr(label, F.lit(","))
    full = (arrow > 0) & (comma > 0)
    strip = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    before = F.when(arrow > comma, F.substr(label, comma + 1, arrow - comma - 1)).otherwise(
        F.substr(label, comma + 1)
    )
    known = lambda c: F.when(c != EMPTY, c)
    pushed = strip(F.substr(label, arrow + 2))
    words = F.filter(F.split(pushed, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    nothing = F.array().cast("array<string>")
    return F.struct(
        known(F.when(full, strip(F.substr(label, F.lit(1), comma - 1))).otherwise(label)).alias("input"),
        known(F.when(full, strip(before))).alias("pop"),
        F.when(full & (pushed != EMPTY), words).otherwise(nothing).alias("push"),
    )


def rule_table(rows: DataFrame, label: str) -> DataFrame:
    return rows.withColumn("__r", split_rule_label(F.col(label))).select(
        *rows.columns, "__r.input", "__r.pop", "__r.push"
    )


@dataclass(frozen=True)
class Rules:
    """A rule table as a parameter: rows (rule_no, state, input, pop, push, next_state) in order."""

    rows: list[tuple]
    start: str
    accepting: list[str]

    @classmethod
    def of(cls, table: DataFrame, start: str, accepting: list[str]) -> "Rules":
        found = [tuple(r) for r in table.select(*COLUMNS).orderBy("rule_no").collect()]
        return cls([(i, *r[1:]) for i, r in enumerate(found)], start, accepting)

    def literal(self, wanted=lambda row: True) -> Column:
        rules = [dict(zip(COLUMNS, row)) for row in filter(wanted, self.rows)]
        return F.from_json(F.lit(json.dumps(rules)), f"array<{RULE_TYPE}>")

    def empty_chain(self) -> int | None:
        """Most input-free steps in a row, None if they can go round in a circle."""
        after: dict[str, set[str]] = {}
        for _, state, inp, _, _, nxt in self.rows:
            if inp is None:
                after.setdefault(state, set()).add(nxt)
        reached, steps = set(after), 0
        while reached:
            reached = {nxt for state in reached for nxt in after.get(state, ())}
            steps += 1
            if steps > len(after) + 1:
                return None
        return max(steps - 1, 0) if after else 0

    def silent_bound(self) -> tuple[int, int]:
        """(a, b): an input-free run is never longer than a + b * (depth of the stack) if it is the shortest one.

        Raises if a circle of input-free steps that can be reached lets the stack grow: such runs have no end.
        """
        silent = [row for row in self.rows if row[2] is None]
        reachable = _reached(_heads(self.rows, _pop_steps(self.rows), {(self.start, None)}), (self.start, None))
        popping = _pop_steps(silent)
        edges = _heads(silent, popping, reachable)
        for head, found in edges.items():
            for target, (_, grows) in found.items():
                if grows and head in _reached(edges, target):
                    raise ValueError(f"rules push without end and without input in state {head[0]}")
        longest = max((steps for found in edges.values() for steps, _ in found.values()), default=0)
        return len(edges) * longest + 1, max(popping.values(), default=0)


Head = tuple[str, str | None]  # a state and the symbol on top, None at the bottom of the stack


def _pop_steps(rows: list[tuple]) -> dict[tuple[str, str, str], int]:
    """Fewest steps from a state with a symbol on top until that symbol is gone, by the state then reached."""
    symbols = {x for row in rows for x in (row[3], *row[4]) if x is not None}
    found: dict[tuple[str, str, str], int] = {}
    changed = True
    while changed:
        changed = False
        for _, state, _, pop, push, target in rows:
            for top in symbols if pop is None else {pop}:
                *_, gone = _unstacked(target, [*push, top] if pop is None else list(push), found)
                for end, steps in gone.items():
                    if steps < found.get((state, top, end), steps + 1):
                        found[state, top, end] = steps
                        changed = True
    return found


def _unstacked(target: str, stack: list, popping: dict[tuple[str, str, str], int]) -> list[dict[str, int]]:
    """After a step to ``target`` with ``stack`` (top first): the states in which each cell comes to the top, then
    those in which all are gone, with the fewest steps so far."""
    levels = [{target: 1}]
    for symbol in stack:
        after: dict[str, int] = {}
        for (state, top, end), steps in popping.items():
            if top == symbol and state in levels[-1]:
                after[end] = min(levels[-1][state] + steps, after.get(end, levels[-1][state] + steps))
        levels.append(after)
    return levels


def _heads(rows: list[tuple], popping: dict, heads: set[Head]) -> dict[Head, dict[Head, tuple[int, bool]]]:
    """From each head on: the heads that come next without going below its top, in how many steps, and whether
    something stays underneath that was not there before."""
    edges: dict[Head, dict[Head, tuple[int, bool]]] = {}
    waiting = list(heads)
    while waiting:
        head = waiting.pop()
        if head in edges:
            continue
        found = edges.setdefault(head, {})
        for _, state, _, pop, push, target in rows:
            if state != head[0] or pop not in (None, head[1]):
                continue
            stack = [*push, head[1]] if pop is None else list(push)
            for place, states in enumerate(_unstacked(target, stack, popping)[: len(stack)]):
                for state_then, steps in states.items():
                    at = (state_then, stack[place])
                    known = found.get(at, (0, False))
                    found[at] = (max(steps, known[0]), known[1] or place < len(stack) - 1)
                    waiting.append(at)
    return edges


def _reached(edges: dict[Head, dict], head: Head) -> set[Head]:
    seen, waiting = {head}, [head]
    while waiting:
        for target in edges.get(waiting.pop(), ()):
            if target not in seen:
                seen.add(target)
                waiting.append(target)
    return seen


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _after(stack: Column, rule: Column) -> Column:
    """The stack (bottom first) after popping and pushing."""
    kept = F.when(rule["pop"].isNull(), stack).otherwise(
        F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
    )
    return F.concat(kept, F.reverse(rule["push"]))


def _pops(stack: Column, rule: Column) -> Column:
    top = F.get(stack, F.size(stack) - 1)
    return rule["pop"].isNull() | F.coalesce(rule["pop"] == top, F.lit(False))


# Higher-order functions copy their values, so what a step carries must be short. Symbols are therefore
# folded in blocks: inside a block a configuration is (state, stack, steps, origin, path) with the rules
# since the block began and the place of the configuration it comes from; between blocks it is
# (head, state, stack, steps) with all rules so far, kept in the order of ``head``. No head starts
# another one, since each ends where the last symbol was read, so (steps, origin, path) orders
# configurations like (steps, head + path).
_CARRIED = "array<struct<head:array<int>,state:string,stack:array<string>,steps:int>>"
_ATTEMPT = "struct<steps:int,origin:int,path:array<int>>"
_NO_PATH = "cast(array() as array<int>)"


def _config(state: Column, stack: Column, steps: Column, origin: Column, path: Column) -> Column:
    return F.struct(
        state.alias("state"), stack.alias("stack"), steps.alias("steps"), origin.alias("origin"),
        path.alias("path"),
    )


def _moves(configs: Column, rules: Column, reads) -> Column:
    def of_config(c: Column) -> Column:
        fits = F.filter(rules, lambda r: (r["state"] == c["state"]) & reads(r) & _pops(c["stack"], r))
        return F.transform(
            fits,
            lambda r: _config(
                r["next_state"], _after(c["stack"], r), c["steps"] + 1, c["origin"],
                F.array_append(c["path"], r["rule_no"]),
            ),
        )

    return F.flatten(F.transform(configs, of_config))


def _smallest(configs: Column) -> Column:
    """One configuration per (state, stack), the one with the smallest path."""

    def first_of_run(s: Column) -> Column:
        def keep(x: Column, i: Column) -> Column:
            before = F.get(s, i - 1)
            return (i == 0) | (x["state"] != before["state"]) | (x["stack"] != before["stack"])

        return F.when(F.size(s) < 2, s).otherwise(F.filter(s, keep))

    return _bind(F.array_sort(configs), first_of_run)


def _least(configs: Column) -> Column:
    """The smallest attempt among configurations, null if there are none."""
    return F.array_min(F.transform(configs, lambda c: F.struct(c["steps"], c["origin"], c["path"])))


class Fold:
    """The search as a fold over symbols. Input-free rules that go round in a circle must not let the stack grow.

    The accumulator is struct(configs, best): the configurations right after reading a symbol, and,
    once there are none left, the path of the attempt that came furthest.
    """

    def __init__(self, rules: Rules):
        self.rules = rules
        self.chain = rules.empty_chain()
        self.bound = rules.silent_bound() if self.chain is None else None
        self.reading = rules.literal(lambda row: row[2] is not None)
        self.silent = rules.literal(lambda row: row[2] is None)

    def start(self) -> Column:
        first = F.struct(
            F.expr(_NO_PATH).alias("head"), F.lit(self.rules.start).alias("state"),
            F.array().cast("array<string>").alias("stack"), F.lit(0).alias("steps"),
        )
        return F.struct(F.array(first).cast(_CARRIED).alias("configs"), F.expr(_NO_PATH).alias("best"))

    def _closed(self, configs: Column) -> Column:
        anything = lambda r: F.lit(True)
        if self.bound is not None:
            return _bind(configs, lambda c: self._settled(c, lambda new: _moves(new, self.silent, anything)))
        if not self.chain:
            return configs
        grow = lambda c, _: _smallest(F.concat(c, _moves(c, self.silent, anything)))
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.chain)), configs, grow)

    def _settled(self, configs: Column, moves) -> Column:
        """``configs`` and all that input-free steps lead to; only what is new or reached by less goes on."""
        deepest = F.array_max(F.transform(configs, lambda c: F.size(c["stack"])))
        most = F.lit(self.bound[0]) + F.lit(self.bound[1]) * F.coalesce(deepest, F.lit(0))

        def grow(acc: Column, _) -> Column:
            merged = _bind(
                _smallest(F.concat(acc["known"], moves(acc["new"]))),
                lambda found: F.struct(found.alias("known"), F.array_except(found, acc["known"]).alias("new")),
            )
            return F.when(F.size(acc["new"]) == 0, acc).otherwise(merged)

        begin = F.struct(configs.alias("known"), configs.alias("new"))
        return F.aggregate(F.sequence(F.lit(1), most), begin, grow, lambda acc: acc["known"])

    def _step(self, acc: Column, symbol: Column) -> Column:
        """``acc`` is struct(configs, last): ``last`` is the best attempt before none was left."""
        moved = _moves(self._closed(acc["configs"]), self.reading, lambda r: r["input"] == symbol)

        def kept(configs: Column) -> Column:
            lost = (F.size(acc["configs"]) > 0) & (F.size(configs) == 0)
            last = F.when(lost, _least(acc["configs"])).otherwise(acc["last"])
            return F.struct(configs.alias("configs"), last.alias("last"))

        return _bind(_smallest(moved), kept)

    @staticmethod
    def _opened(carried: Column) -> Column:
        return F.transform(
            carried,
            lambda c, i: _config(c["state"], c["stack"], c["steps"], i, F.expr(_NO_PATH)),
        )

    @staticmethod
    def _path(carried: Column, attempt: Column) -> Column:
        return F.concat(F.get(carried, attempt["origin"])["head"], attempt["path"])

    def _block(self, acc: Column, symbols: Column) -> Column:
        begin = F.struct(
            self._opened(acc["configs"]).alias("configs"), F.lit(None).cast(_ATTEMPT).alias("last")
        )

        def rolled(inner: Column) -> Column:
            configs = F.transform(
                inner["configs"],
                lambda c: F.struct(
                    self._path(acc["configs"], c).alias("head"), c["state"].alias("state"),
                    c["stack"].alias("stack"), c["steps"].alias("steps"),
                ),
            )
            best = F.coalesce(self._path(acc["configs"], inner["last"]), acc["best"])
            return F.struct(F.array_sort(configs).alias("configs"), best.alias("best"))

        return _bind(F.aggregate(symbols, begin, self._step), rolled)

    def over(self, acc: Column, symbols: Column) -> Column:
        """``acc`` after all of ``symbols``."""
        starts = F.sequence(F.lit(1), F.greatest(F.size(symbols), F.lit(1)), F.lit(BLOCK_EVENTS))
        blocks = F.transform(starts, lambda i: F.slice(symbols, i, F.lit(BLOCK_EVENTS)))
        return F.aggregate(blocks, acc, self._block)

    def result(self, acc: Column) -> Column:
        """struct(accepted, path)."""

        def verdict(a: Column) -> Column:
            opened = self._opened(a["configs"])
            goal = _least(
                F.filter(self._closed(opened), lambda c: c["state"].isin(*self.rules.accepting))
            )
            found = F.coalesce(goal, _least(opened))
            path = F.coalesce(self._path(a["configs"], found), a["best"])
            return F.struct(goal.isNotNull().alias("accepted"), path.alias("path"))

        return _bind(acc, verdict)


def fold_chunks(chunks: DataFrame, key: str, fold: Fold) -> DataFrame:
    """(key, accepted, path) from written rows (key, chunk, symbols): one round per chunk number.

    A round carries one row per sequence, its live configurations, and reads one chunk of each.
    """
    carried = chunks.select(key).distinct().withColumn("acc", fold.start())
    for number in range(chunks.agg(F.max("chunk")).first()[0] + 1):
        here = chunks.filter(F.col("chunk") == number).select(key, "symbols")
        symbols = F.coalesce("symbols", F.array().cast("array<string>"))
        carried = written(
            carried.join(here, key, "left").select(key, fold.over(F.col("acc"), symbols).alias("acc")),
            "carried",
        )
    return carried.select(key, fold.result(F.col("acc")).alias("__r")).select(
        key, "__r.accepted", "__r.path"
    )


def rule_attempts(events: DataFrame, key: str, order: list[str], symbol: str, rules: Rules,
                  end: str | None = None, chunk_events: int = CHUNK_EVENTS) -> DataFrame:
    """(key, accepted, path) per sequence of event rows; ``end`` is a symbol put after the last one.

    Rules that can push for ever without reading are an error, raised before any data is read.
    """

    def placed(rows: DataFrame) -> DataFrame:
        rows = positions(rows, [key], [*order, symbol]).select(key, "pos", F.col(symbol).alias("symbol"))
        if end is None:
            return rows
        last = rows.groupBy(key).agg((F.max("pos") + 1).alias("pos"))
        return rows.unionByName(last.withColumn("symbol", F.lit(end)))

    fold = Fold(rules)
    small, large, _ = parted_by_size(events, [key], chunk_events)
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(symbol).alias("__s"))))
    symbols = F.transform(items, lambda x: x["__s"])
    symbols = symbols if end is None else F.array_append(symbols, F.lit(end))
    rows = small.groupBy(key).agg(symbols.alias("symbols"))
    result = fold.result(fold.over(fold.start(), F.col("symbols")))
    found = rows.select(key, result.alias("__r")).select(key, "__r.accepted", "__r.path")
    if large is None:
        return found
    items = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    chunks = placed(large).groupBy(key, F.floor(F.col("pos") / chunk_events).alias("chunk")).agg(
        F.transform(items, lambda x: x["symbol"]).alias("symbols")
    )
    return found.unionByName(fold_chunks(written(chunks, "chunks"), key, fold))


def rule_steps(attempts: DataFrame, key: str, rules: Rules) -> DataFrame:
    """One row of fixed size per step of each path: step, op, symbol, depth, states, the rule's pop and push."""
    rows = attempts.select(
        key, (F.size("path") - 1).alias("last_step"), F.posexplode("path").alias("step", "no")
    ).withColumn("r", F.get(rules.literal(), F.col("no")))
    effect = F.size("r.push") - F.col("r.pop").isNotNull().cast("int")
    op = (
        F.when(F.size("r.push") > 0, F.lit(OP_PUSH))
        .when(F.col("r.pop").isNotNull(), F.lit(OP_POP))
        .otherwise(F.lit(OP_NONE))
    )
    return ordered(rows, [key], ["step"]).running_sum(effect, "depth").rows().select(
        key, "step", "last_step", op.alias("op"), F.coalesce("r.input", F.lit(EMPTY)).alias("symbol"),
        F.col("depth").cast("int").alias("depth"), F.col("r.state").alias("current_state"), "r.next_state",
        "r.pop", "r.push",
    )


def rule_stack_cells(steps: DataFrame, key: str) -> DataFrame:
    """One row per pushed symbol: (key, level, symbol, from_step, to_step), the steps after which it is on the stack.

    A step pops one symbol at most, so pushes and pops of a level take turns: a cell lives until the next pop there.
    """
    below = F.col("depth") - F.size("push")
    pushed = steps.select(key, "step", "last_step", F.lit(1).alias("kind"), below.alias("below"),
                          F.posexplode(F.reverse("push")).alias("nth", "cell"))
    pushed = pushed.select(key, "step", "last_step", "kind", (F.col("below") + F.col("nth") + 1).alias("level"), "cell")
    popped = steps.filter(F.col("pop").isNotNull()).select(
        key, "step", "last_step", F.lit(0).alias("kind"), (below + 1).alias("level"),
        F.lit(None).cast("string").alias("cell"),
    )
    turns = Window.partitionBy(key, "level").orderBy("step", "kind")
    until = F.coalesce(F.lead("step").over(turns) - 1, F.col("last_step"))
    return pushed.unionByName(popped).withColumn("to_step", until).filter("kind = 1").select(
        key, "level", F.col("cell").alias("symbol"), F.col("step").alias("from_step"), "to_step"
    )


def rule_step_trace(attempts: DataFrame, key: str, rules: Rules) -> DataFrame:
    """One row per step of each path: step, op, symbol, stack_after, current_state, next_state.

    The stacks are spelled out, so the answer has as many symbols as all stacks together; ``rule_steps`` and
    ``rule_stack_cells`` say the same in rows of fixed size.
    """
    steps = rule_steps(attempts, key, rules)
    names = ["op", "symbol", "current_state", "next_state"]
    cells = rule_stack_cells(steps, key).select(
        key, F.explode(F.sequence("from_step", "to_step")).alias("step"),
        F.struct("level", F.col("symbol").alias("cell")).alias("held"),
    )
    rows = steps.select(key, "step", F.struct(*names).alias("said")).unionByName(cells, allowMissingColumns=True)
    stack = F.transform(F.array_sort(F.collect_list("held")), lambda x: x["cell"])
    found = rows.groupBy(key, "step").agg(F.first("said", ignorenulls=True).alias("said"), stack.alias("stack_after"))
    return found.select(key, "step", "said.op", "said.symbol", "stack_after", "said.current_state", "said.next_state")
