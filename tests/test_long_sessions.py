"""Sessions of many events: linear work, and the same results whether a session is cut into segments or not."""

import time

import pytest
from pyspark.sql import functions as F

from seqmodel.operators import score
from seqmodel.operators.automaton import Model
from seqmodel.operators.prefix_tree import SEQUENCE, prefix_nodes, prefix_rows, ranked_votes, sequence_key, terminal_votes


def long_session(spark, n):
    symbols = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("s"), (F.xxhash64(i) % 7).cast("string")))
    return spark.range(1).select(F.lit("x").alias("id"), symbols.alias("symbols"), F.lit(True).alias("label"))


@pytest.mark.parametrize("use", [
    lambda seqs: prefix_nodes(ranked_votes(terminal_votes(seqs))).agg(F.count("*"), F.sum("res_n"), F.countDistinct("res_a", "res_b")),
    lambda seqs: score.state_trace(seqs, Model.fit(seqs)).agg(F.count("*"), F.countDistinct("next_state"), F.max("step") + 2),
    lambda seqs: score.rule_usage(terminal_votes(seqs), Model.fit(seqs)).agg(F.sum("uses"), F.count("*"), F.sum("positive_uses") + 1),
], ids=["nodes", "trace", "usage"])
def test_long_session_takes_linear_time(spark, use):
    def seconds(n):
        started = time.perf_counter()
        found = tuple(use(long_session(spark, n)).first())
        assert found[0] in (n, n + 1) and found[1] in (n, n + 1) and found[2] == n + 1
        return time.perf_counter() - started

    seconds(1000)
    assert seconds(100_000) < 20 * max(seconds(10_000), 0.5)


def test_keys_of_cut_sequences(spark):
    rows = [(i, [None if (i * j) % 11 == 5 else f"s{(i + j * j) % 3}" for j in range(i % 40)]) for i in range(60)]
    seqs = spark.createDataFrame(rows, "id long, symbols array<string>").withColumns(sequence_key(SEQUENCE))
    whole, cut = (prefix_rows(seqs, ["id"], limit) for limit in (10**6, 7))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, cut.collect()))
    ends = whole.where("depth = n").select("id", "depth", "ka", "kb")
    keys = seqs.select("id", *SEQUENCE)
    assert ends.count() == len(rows) and ends.exceptAll(keys).count() == 0
    by_id = dict(rows)
    seen = {}
    for r in whole.collect():  # equal keys, equal prefixes; equal rests, equal continuations
        symbols = by_id[r.id]
        assert seen.setdefault(("front", r.depth, r.ka, r.kb), symbols[: r.depth]) == symbols[: r.depth]
        assert seen.setdefault(("back", r.rest_a, r.rest_b), symbols[r.depth :]) == symbols[r.depth :]
        assert r.symbol == (symbols[r.depth - 1] if r.depth else None)
    assert len(seen) == len({(k[0], tuple(v)) for k, v in seen.items()})
