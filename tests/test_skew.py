"""Large groups take another way; its results must be the same."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from seqmodel.operators import sessions, stack
from seqmodel.operators.ordered import SEGMENT, numbered, ordered
from seqmodel.operators.split import train_test_split
from seqmodel.sources.conn_log import unique_ids

LIMIT = 50


@pytest.fixture(scope="module")
def events(spark):
    """Key 0 has a third of the rows, many of them at the same time; some keys are null."""
    rows = spark.range(1800).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 100 == 1, None)
        .otherwise(F.col("id") % 40).cast("long").alias("key"),
        F.timestamp_seconds(F.floor(F.col("id") / 7) * F.when(F.col("id") < 900, 60).otherwise(900)).alias("ts"),
        "id",
        F.element_at(F.array(*map(F.lit, ["up", "down", "proto=tcp", "proto=x", "other"])),
                     (F.xxhash64("id") % 5 + 5).cast("int") % 5 + 1).alias("symbol"),
        (F.col("id") % 97).cast("double").alias("value"),
    )
    return rows.repartition(5).cache()


def rows_of(df):
    return sorted(map(repr, (r.asDict().items() for r in df.select(*sorted(df.columns)).collect())))


def test_hot_key_is_cut(events):
    cut = ordered(events, ["key"], ["ts", "id"], LIMIT)
    assert cut.cut
    sizes = cut.df.filter(F.col(SEGMENT) >= 0).groupBy("key", SEGMENT).count()
    assert sizes.filter("key = 0").count() > 3
    assert cut.df.count() == events.count()


@pytest.mark.parametrize("make", [
    lambda e, n: sessions.positions(e, ["key"], ["ts", "id"], limit=n),
    lambda e, n: sessions.session_sequences(e, ["key"], ["ts", "id"], F.col("symbol"),
                                            F.max("value") > 90),
    lambda e, n: sessions.session_gap_sequences(e, ["key"], "ts", "id", 600, F.col("symbol"),
                                                F.max("value") > 90, limit=n),
    lambda e, n: stack.stack_balance(e, ["key"], ["ts", "id"], push="up", pop="down", limit=n),
    lambda e, n: stack.stack_trace(e, ["key"], ["ts", "id"], push="up", pop="down", limit=n),
    lambda e, n: stack.stack_trace(e.filter("symbol <> 'down'"), ["key"], ["ts", "id"], push="up",
                                   pop="down", limit=n),
    lambda e, n: numbered(e, ["value", "id"], "n", limit=n),
], ids=["positions", "sessions", "gaps", "balance", "trace", "long_trace", "numbered"])
def test_same_result(events, make):
    assert rows_of(make(events, LIMIT)) == rows_of(make(events, 10**6))


def test_sessions_stay_whole(events):
    seqs = sessions.session_sequences(events, ["key"], ["ts", "id"], F.col("symbol"), F.max("value") > 90)
    sizes = {r["key"]: r["count"] for r in events.groupBy("key").count().collect()}
    assert {int(r.id) if r.id else None: len(r.symbols) for r in seqs.collect()} == sizes and max(sizes.values()) > 256


def test_digests_of_sessions(events):
    """Cut or not, with ties, null symbols and null keys, it is the digest of the whole session in its order."""
    symbol = F.when(F.col("symbol") != "other", F.col("symbol"))
    seqs = sessions.session_sequences(events, ["key"], ["ts"], symbol, F.max("value") > 90)
    want = set()
    for r in seqs.collect():
        digest = 0
        for i, s in enumerate(r.symbols):
            digest ^= int(hashlib.md5(f"{i}:{'' if s is None else '=' + s}".encode()).hexdigest()[:15], 16)
        want.add((r.id, len(r.symbols), digest, r.label))
    for limit in (LIMIT, 10**6):
        got = sessions.session_digests(events, ["key"], ["ts"], symbol, F.max("value") > 90, limit).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_digests_need_no_python_and_hold_no_session(spark):
    rows = spark.range(50_000).select(F.lit("k").alias("k"), "id", F.lit("s").alias("symbol"))
    found = sessions.session_digests(rows, ["k"], ["id"], F.col("symbol"), F.max("id") > 5, limit=9000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "collect_list" not in plan
    assert [(r.id, r.n, r.label) for r in found.collect()] == [("k", 50_000, True)]


@pytest.mark.parametrize("chunk", [1, 7, 512, 10**6])
def test_md5s_of_whole_sessions(events, chunk):
    """Whatever the chunk and the segments, ties and null symbols and keys too, it is the md5 of the whole joined text."""
    symbol = F.when(F.col("symbol") != "other", F.col("symbol"))
    want = set()
    for r in sessions.session_sequences(events, ["key"], ["ts"], symbol, F.max("value") > 90).collect():
        text = "|".join(s for s in r.symbols if s is not None)
        want.add((r.id, len(r.symbols), hashlib.md5(text.encode()).hexdigest() if text else None, r.label))
    for limit in (LIMIT, 10**6):
        got = sessions.session_md5s(events, ["key"], ["ts"], symbol, F.max("value") > 90, limit, chunk).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_md5s_take_every_event_and_hold_no_session_in_a_row(spark, monkeypatch):
    rows = spark.range(50_000).select(F.lit("k").alias("k"), "id", F.when(F.col("id") != 7, F.lit("s")).alias("symbol"))
    rows = rows.union(spark.sql("select 'none' as k, 0L as id, cast(null as string) as symbol"))
    seen, real = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, *a, **k: (seen.append(df), real(df, *a, **k))[1])
    got = sessions.session_md5s(rows, ["k"], ["id"], F.col("symbol"), F.max("id") > 5, limit=9000).collect()
    want = hashlib.md5(b"|".join([b"s"] * 49_999)).hexdigest()
    assert {tuple(r) for r in got} == {("k", 50_000, want, True), ("none", 1, None, False)}
    assert seen[0].select(F.max(F.length("__text"))).first()[0] < 2 * sessions.CHUNK_EVENTS


def test_sessions_by_type_is_the_md5_of_all_events(spark, tmp_path):
    """The SQL twin, too, hashes the whole text of a session."""
    duckdb = pytest.importorskip("duckdb")
    from seqmodel.plans import ingest_queries

    rows = [(i, i % 7, "ab"[i % 2], i // 3) for i in range(2000)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, t long")
    frame.select("event_id", "user_id", "event_type", F.timestamp_seconds("t").alias("ts"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = {(k, 1000, hashlib.md5("|".join(f"user={u}" for i, u, t, _ in rows if t == k).encode()).hexdigest(), k == "a") for k in "ab"}
    got = ingest_queries.QUERIES["sessions_by_type"](spark, str(tmp_path)).select("id", "n", "symbols", "label").collect()
    assert {tuple(r) for r in got} == want
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert set(db.execute(f"select id, n, symbols, label from ({ingest_queries.ORACLES['sessions_by_type']})").fetchall()) == want


def test_long_session_has_one_label_and_takes_linear_time(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).alias("k"), "id", F.concat(F.lit("s"), F.col("id") % 7).alias("symbol"))
        seqs = sessions.session_sequences(rows, ["k"], ["id"], F.col("symbol"), F.max("id") > n - 2)
        started = time.perf_counter()
        got = seqs.select(F.size("symbols"), "label", F.element_at("symbols", -1)).collect()
        assert [tuple(r) for r in got] == [(n, True, f"s{(n - 1) % 7}")]
        return time.perf_counter() - started

    seconds(1000)
    assert seconds(400_000) < 20 * max(seconds(100_000), 0.5)


def test_copies_get_unique_ids(spark):
    rows = spark.range(600).select(F.when(F.col("id") < 200, "same").otherwise((F.col("id") + 1).cast("string")).alias("id"))
    for limit in (LIMIT, 10**6):
        ids = unique_ids(rows, limit=limit)
        assert ids.distinct().count() == 600
        assert ids.filter("id like 'same%'").count() == 200
        assert ids.filter("id = 'same#200'").count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997])
@pytest.mark.parametrize("limit", [5, 10**6])
def test_split_size(spark, n, limit):
    seqs = spark.range(n)
    marked = train_test_split(seqs, limit=limit).cache()
    assert marked.filter("is_train").count() == max(1, min(int(n * 0.7), max(n - 1, 1)))
    assert marked.count() == n
    keys = marked.withColumn("k", F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))))
    bounds = keys.agg(F.max(F.when(F.col("is_train"), F.col("k"))), F.min(F.when(~F.col("is_train"), F.col("k"))))
    low, high = bounds.first()
    assert high is None or low < high


def test_split_of_copies(spark):
    """All rows of one id: the size is exact all the same."""
    seqs = spark.range(300).select(F.lit("a").alias("id"), F.col("id").alias("row"))
    for limit in (LIMIT, 10**6):
        marked = train_test_split(seqs, limit=limit).cache()
        assert (marked.filter("is_train").count(), marked.select("row").distinct().count()) == (210, 300)


def test_split_edges(spark):
    empty = spark.range(0)
    assert train_test_split(empty).count() == 0
    for ratio in (0.0, 1.0, -1.0, 2.0):
        with pytest.raises(ValueError):
            train_test_split(empty, ratio)
