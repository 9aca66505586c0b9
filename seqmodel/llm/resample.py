"""Importance resampling towards a target distribution over hashed word n-grams."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.llm.ragged import map_texts, utf8
from seqmodel.operators.ordered import ordered
from seqmodel.sources.scratch import written

# A word after A-Z are lower-cased, and the byte between two texts, which no word holds.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SENTINEL = 0
#: Checksums of so many different words are remembered between batches of a task, then forgotten.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Resampling:
    """Features are runs of 1 to ``longest`` words; ``num`` of ``den`` documents of ``least_words`` or more are drawn."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    num: int = 10
    den: int = 100
    seed: str = "2024"

    @property
    def kind(self) -> type:
        return np.uint16 if self.buckets <= 1 << 16 else np.uint32


_known: dict[bytes, int] = {}


def _checksums(words: list[bytes]) -> np.ndarray:
    if len(_known) > REMEMBERED:
        _known.clear()
    for word in set(words).difference(_known):
        _known[word] = zlib.crc32(word)
    return np.fromiter(map(_known.__getitem__, words), np.uint32, len(words))


def batch_features(column: pa.Array, how: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and features of each text, and the buckets of all features, text by text.

    The texts are joined by sentinels, one regex pass finds all words, and a search of their places among the texts'
    offsets says whose they are. A run whose first and last word lie in different texts is none.
    """
    flat, offsets = utf8(column)
    texts = len(offsets) - 1
    data = np.insert(flat, offsets[1:-1], SENTINEL).tobytes().translate(_LOWER)
    begins = offsets[:-1] + np.arange(texts)
    found = [(m.start(), m.group()) for m in _WORD.finditer(data)]
    starts = np.fromiter((s for s, _ in found), np.int64, len(found))
    words = [w for _, w in found]
    owner = np.searchsorted(begins, starts, side="right") - 1
    sums = _checksums(words)
    owners, buckets = [owner], [sums % how.buckets]
    for more in range(1, how.longest):
        live = np.flatnonzero(owner[: max(len(owner) - more, 0)] == owner[more:])
        longer = np.zeros(len(sums), np.uint32)
        longer[live] = np.fromiter((zlib.crc32(b" " + words[i + more], int(sums[i])) for i in live.tolist()), np.uint32, len(live))
        sums = longer
        owners.append(owner[live])
        buckets.append(sums[live] % how.buckets)
    whose, made = np.concatenate(owners), np.concatenate(buckets)
    if how.longest > 1:
        order = np.argsort(whose, kind="stable")
        whose, made = whose[order], made[order]
    return np.bincount(owner, minlength=texts), np.bincount(whose, minlength=texts), made.astype(how.kind)


def features(df: DataFrame, how: Resampling, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_words, n_features, buckets)``: the bucket of every feature of a text, repeats included, as binary."""

    def run(batch: pa.RecordBatch) -> dict:
        n_words, n_features, buckets = batch_features(batch.column(text_col), how)
        data, width = buckets.tobytes(), np.dtype(how.kind).itemsize
        at = np.concatenate(([0], np.cumsum(n_features))) * width
        packed = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return {"n_words": n_words, "n_features": n_features, "buckets": pa.array(packed, pa.binary())}

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, [id_col], text_col, run, f"`{id_col}` {kind}, n_words long, n_features long, buckets binary")


def _flat(column: pa.Array, how: Resampling) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, how.kind)


def bucket_counts(rows: DataFrame, how: Resampling) -> dict[int, int]:
    """Features of a whole table in each bucket: at most ``how.buckets`` numbers, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("buckets"), how), minlength=how.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    counted = rows.select("buckets").mapInArrow(run, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(source: dict[int, int], target: dict[int, int], how: Resampling) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares in target and source, floored, per bucket."""
    s_all, t_all = sum(source.values()), sum(target.values())
    out = np.zeros(how.buckets, np.int64)
    for b in range(how.buckets):
        above = float(target.get(b, 0) + 1) * float(s_all + how.buckets)
        below = float(source.get(b, 0) + 1) * float(t_all + how.buckets)
        out[b] = math.floor(1000 * math.log(above / below))
    return out


def _weighed(rows: DataFrame, gains: np.ndarray, how: Resampling, id_col: str) -> DataFrame:
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(pc.fill_null(batch.column("n_features"), 0), np.int64)
            upto = np.concatenate(([0], np.cumsum(gains[_flat(batch.column("buckets"), how)])))
            ends = np.cumsum(n)
            weight = (upto[ends] - upto[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("n_words"), pa.array(n), pa.array(weight)], [id_col, "n_words", "n_features", "weight"]
            )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def _noise(id_: Column, seed: str) -> Column:
    """1000 times a Gumbel number that depends on the seed and the id alone, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, how: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text",
              target_text: str = "text") -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of every row; ``rank`` is null where a document is not drawn.

    A document's weight is the floored mean of its features' gains, and the drawn ones are those of the highest weight
    plus Gumbel noise, which draws without replacement in proportion to the weights. Counts cover all texts whole.

    Null and empty texts have no features and weight 0, and count as short. Equal scores go by the smaller id, null ids
    after all others (their noise is that of an empty id); rows of equal id are drawn each. Empty tables of documents
    give an empty table; an empty target favours what is rare in the documents. Other columns are not read.
    """
    rows = written(features(docs, how, id_col, text_col), "features")
    aim = target.select(F.lit(0).alias("__no"), F.col(f"`{target_text}`").alias("text"))
    gains = bucket_gains(bucket_counts(rows, how), bucket_counts(features(aim, how, "__no", "text"), how), how)
    score = F.col("weight") + _noise(F.col(id_col), how.seed)
    scored = written(_weighed(rows, gains, how, id_col).withColumn("score", score), "scores")
    long_ones = scored.where(F.col("n_words") >= how.least_words)
    wanted = how.num * long_ones.count() // how.den
    kept = [id_col, "n_features", "weight", "score"]
    rest = lambda df: df.select(*kept, F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return rest(scored)
    # Scores are integers in a range that the logarithms bound, so there are few different ones.
    per_score = long_ones.groupBy("score").agg(F.count("*").alias("rows")).select(F.lit(0).alias("all"), "score", (-F.col("score")).alias("falling"), "rows")
    before = ordered(per_score, ["all"], ["falling"]).running_sum(F.col("rows"), "before", inclusive=False).rows()
    table = written(before.where(F.col("before") < wanted).select("score", "before"), "score-ranks", lookup=True)
    last = table.agg(F.min("score")).first()[0]
    high = (F.col("n_words") >= how.least_words) & (F.col("score") >= last)
    place = [F.col(id_col).isNull().alias("__unknown")]
    drawn = ordered(scored.where(high).select("*", *place), ["score"], ["__unknown", id_col, "n_features"]).running_sum(F.lit(1), "nth").rows()
    rank = F.col("before") + F.col("nth")
    ranked = drawn.join(table, "score").select(*kept, F.when(rank <= wanted, rank).cast("long").alias("rank"))
    return ranked.unionByName(rest(scored.where(~high)))
