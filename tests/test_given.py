"""Walks through given automata against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from seqmodel.operators import given

STATES = [("A", False), ("B", True), ("C", False)]


def table(spark, states, moves, start):
    return given.Given.of(
        spark.createDataFrame(states, "state string, accepting boolean"),
        spark.createDataFrame(moves, "state string, symbol string, next_state string"), start,
    )


def plain_walk(moves, accepting, state, symbols, stay):
    path = []
    for i, s in enumerate(symbols):
        if (state, s) not in moves:
            if not stay:
                return state, False, f"no transition on '{s}' from state '{state}' at position {i}", path
            path.append((i, state, s, state))
            continue
        path.append((i, state, s, moves[state, s]))
        state = moves[state, s]
    return state, accepting[state], "accepted" if accepting[state] else f"ended in non-accepting state '{state}'", path


@pytest.mark.parametrize("block", [1, 3, 128])
def test_walks(spark, monkeypatch, block):
    monkeypatch.setattr(given, "BLOCKS_TOGETHER", 2)
    rng = random.Random(block)
    moves = {(s, x): rng.choice("ABC") for s in "ABC" for x in "xyz" if rng.random() < 0.8}
    model = table(spark, STATES, [(s, x, t) for (s, x), t in moves.items()], "A")
    seqs = {k: [rng.choice("xyzxyzxyzq") for _ in range(n)] for k, n in enumerate([1, 2, 5, 17, 40, 131])}
    seqs[None] = ["x"] * 9
    rows = [(k, i, s) for k, symbols in seqs.items() for i, s in enumerate(symbols)]
    events = spark.createDataFrame(rows, "key long, i long, name string").withColumns({c: F.lit(1) for c in ("no", "letter", "symbols")})
    for rule in (given.STAY, given.FAIL):
        args = (events, ["key"], ["i"], F.col("name"), model, rule, 20, block)
        got = {r.key: (r.final_state, r.accepted, r.reason) for r in given.walk(*args).collect()}
        want = {k: plain_walk(moves, dict(STATES), "A", s, rule == given.STAY) for k, s in seqs.items()}
        assert got == {k: w[:3] for k, w in want.items()}
        steps = {(r.key, r.step, r.current_state, r.symbol, r.next_state) for r in given.walk_trace(*args).collect()}
        assert steps == {(k, *p) for k, w in want.items() for p in w[3]}


def test_long_walk_takes_no_row_of_its_length(spark):
    moves = [("A", "0", "B"), ("B", "1", "C"), ("C", "2", "A"), ("A", "2", "A")]
    model = table(spark, STATES, moves, "A")
    rows = spark.range(60_000).select(F.lit("k").alias("key"), "id", (F.col("id") % 3).cast("string").alias("name"))
    got = given.walk(rows, ["key"], ["id"], F.col("name"), model, given.FAIL, limit=9000).first()
    assert (got.final_state, got.accepted) == ("A", False)
    trace = given.walk_trace(rows, ["key"], ["id"], F.col("name"), model, limit=9000)
    assert trace.groupBy("current_state").count().where("count = 20000").count() == 3


def test_odd_automata(spark):
    events = spark.createDataFrame([(1, 0, "x"), (2, 0, None)], "key long, i long, name string")
    empty = table(spark, [], [], None)
    got = given.walk(events, ["key"], ["i"], F.col("name"), empty, given.FAIL).collect()
    assert {(r.key, r.accepted, r.reason) for r in got} == {(1, False, "empty grammar"), (2, False, "empty grammar")}
    still = table(spark, STATES, [], "B")
    got = given.walk(events, ["key"], ["i"], F.col("name"), still, given.STAY).collect()
    assert {(r.key, r.final_state, r.verdict) for r in got} == {(1, "B", "Malicious"), (2, "B", "Malicious")}
    assert given.walk(events.limit(0), ["key"], ["i"], F.col("name"), still).count() == 0
    for states, moves, start in ((STATES, [], "D"), (STATES, [("A", "x", "D")], "A"), (STATES, [("A", "x", "A"), ("A", "x", "B")], "A")):
        with pytest.raises(ValueError):
            table(spark, states, moves, start)
