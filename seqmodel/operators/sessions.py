"""Event rows to sequences: one per key, or one per key and quiet gap.

A sequence is one row and holds its whole session, so a session has to fit into a row. Operators that
need no row per session (digests, stack checks, positions) work on the event rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.operators.ordered import Ordered, ordered, same_keys

# Fixed value: hexadecimal digits of an md5 that fit a positive 64-bit number.
DIGEST_DIGITS = 15
#: Events whose symbols are joined in one row on the way to the md5 of a session.
CHUNK_EVENTS = 512


def positions(events: DataFrame, keys: list[str], order: list[str], out: str = "pos",
              limit: int | None = None) -> DataFrame:
    """0-based place of each event within its key."""
    rows = ordered(events, keys, order, limit).running_sum(F.lit(1), out).rows()
    return rows.withColumn(out, (F.col(out) - 1).cast("long"))


def _collected(rows: DataFrame, keys: list[str], order: list[str], symbol: Column,
               label: Column) -> DataFrame:
    """(id, symbols, label) per key; events of equal order are sorted by symbol."""
    items = F.array_sort(F.collect_list(F.struct(*order, symbol.alias("__symbol"))))
    return rows.groupBy(*keys).agg(items.alias("__items"), label.alias("label")).select(
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("id"),
        F.transform("__items", lambda x: x["__symbol"]).alias("symbols"),
        "label",
    )


def session_sequences(events: DataFrame, keys: list[str], order: list[str], symbol: Column,
                      label: Column) -> DataFrame:
    """(id, symbols, label) per key; ``label`` is an aggregate over the sequence's events."""
    return _collected(events, keys, order, symbol, label)


def place_digest(place: Column, symbol: Column) -> Column:
    """A number for a symbol at a place; a null symbol differs from any text."""
    marked = F.coalesce(F.concat(F.lit("="), symbol), F.lit(""))
    text = F.md5(F.concat(place.cast("string"), F.lit(":"), marked))
    return F.conv(F.substring(text, 1, DIGEST_DIGITS), 16, 10).cast("long")


def session_digests(events: DataFrame, keys: list[str], order: list[str], symbol: Column, label: Column,
                    limit: int | None = None) -> DataFrame:
    """(id, n, digest, label) per key for sessions of any length: the XOR of a number per (place, symbol).

    Places are running values, also over sessions that are cut into segments, and the digest of a session is that of
    its parts put together: it aggregates partially, so no task and no row holds a session. Events of equal order are
    placed by symbol.
    """
    rows = positions(events.withColumn("__symbol", symbol), keys, [*order, "__symbol"], "__pos", limit)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(place_digest(F.col("__pos"), F.col("__symbol"))).alias("digest"),
        label.alias("label"),
    ).select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("id"), "n", "digest", "label")


def session_md5s(events: DataFrame, keys: list[str], order: list[str], symbol: Column, label: Column,
                 limit: int | None = None, chunk_events: int = CHUNK_EVENTS) -> DataFrame:
    """(id, n, symbols, label) per key, ``symbols`` as the md5 of the symbols joined by '|', for sessions of any length.

    Placing, sorting and joining is cut into chunks. An md5 has no parallel form but goes on from its state alone, so the
    texts of one key's chunks are hashed one after the other, as a stream; no row holds more than one chunk. Null
    symbols are left out; without others ``symbols`` is null.
    """
    rows = positions(events.withColumn("__symbol", symbol), keys, [*order, "__symbol"], "__pos", limit)
    items = F.array_sort(F.collect_list(F.struct("__pos", "__symbol")))
    texts = F.when(F.count("__symbol") > 0, F.array_join(F.transform(items, lambda x: x["__symbol"]), "|"))
    chunk = F.floor(F.col("__pos") / chunk_events).alias("__chunk")
    chunks = rows.groupBy(*keys, chunk).agg(texts.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed, joined = None, hashlib.md5(), False

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*key, pa.array([hashed.hexdigest() if joined else None], pa.string())], [*keys, "symbols"])

        for batch in batches:
            numbers, parts = batch.column("__chunk").to_pylist(), batch.column("__text").to_pylist()
            for i, (number, text) in enumerate(zip(numbers, parts, strict=True)):
                if number == 0:
                    if key:
                        yield closed()
                    key, hashed, joined = [batch.column(k).slice(i, 1) for k in keys], hashlib.md5(), False
                if text is not None:
                    hashed.update((f"|{text}" if joined else text).encode())
                    joined = True
        if key:
            yield closed()

    dealt = chunks.repartition(*keys).sortWithinPartitions(*keys, "__chunk")
    kinds = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)
    digests = dealt.mapInArrow(run, f"{kinds}, symbols string")
    totals = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), label.alias("label"))
    return totals.join(digests, same_keys(totals, digests, keys)).select(
        F.concat_ws("|", *[totals[k].cast("string") for k in keys]).alias("id"), "n", "symbols", "label",
    )


def gap_sessions(events: DataFrame, keys: list[str], time: str, tiebreak: str, gap_seconds: int,
                 limit: int | None = None) -> Ordered:
    """Events with ``session`` (from 0): a new one starts after more than ``gap_seconds`` of quiet."""
    quiet = F.expr(f"timestampdiff(MICROSECOND, __before, {time})") > gap_seconds * 1_000_000
    rows = ordered(events, keys, [time, tiebreak], limit).running_last(
        F.col(time), "__before", inclusive=False
    )
    starts = F.when(quiet, F.lit(1)).otherwise(F.lit(0))
    return rows.with_column("__starts", starts).running_sum(F.col("__starts"), "session")


def session_gap_sequences(events: DataFrame, keys: list[str], time: str, tiebreak: str,
                          gap_seconds: int, symbol: Column, label: Column,
                          limit: int | None = None) -> DataFrame:
    rows = gap_sessions(events, keys, time, tiebreak, gap_seconds, limit).rows()
    return _collected(rows, [*keys, "session"], [time, tiebreak], symbol, label)
