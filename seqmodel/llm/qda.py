"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmodel.llm.ragged import SMALL_SLICE_BYTES, map_texts, slices, utf8, word_hashes, words
from seqmodel.sources.scratch import written

#: Letters of each byte class, and the share it is taken to have in prose: short texts lean on it.
_CLASSES = {
    "upper": (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.02),
    "digit": (b"0123456789", 0.002),
    "symbol": (b"#*$%&|<>@^~_={}[]\\+/", 0.001),
    "loud": (b"!?", 0.001),
    "stop": (b".,;:", 0.03),
    "line": (b"\n", 0.01),
    "wide": (bytes(range(128, 256)), 0.04),
}
#: Weight, in bytes or words, of what prose is taken to be.
_LEAN = 40.0
STATISTICS = ("length", *_CLASSES, "word_length", "same_next", "distinct", "one_byte", "long_word", "word_spread")


def statistics(batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    """One row of ``STATISTICS`` per text: smoothed shares by arcsine of the root, sizes as logarithms. Empty texts look like prose."""
    flat, offsets = utf8(batch.column(text_col))
    size = np.diff(offsets).astype(float)
    columns = [np.log(size + 200)]

    def share(part: np.ndarray, whole: np.ndarray, usual: float) -> np.ndarray:
        return np.arcsin(np.sqrt(np.minimum((part + _LEAN * usual) / (whole + _LEAN), 1)))

    for letters, usual in _CLASSES.values():
        table = np.zeros(256, np.int64)
        table[list(letters)] = 1
        sums = np.concatenate(([0], np.cumsum(table[flat])))[offsets]
        columns.append(share(np.diff(sums), size, usual))
    starts, ends, counts = words(flat, offsets)
    length = ends - starts
    edge = np.concatenate(([0], np.cumsum(counts)))

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values)))[edge]).astype(float)

    hashes = word_hashes(flat, starts, ends, lower=True)
    same = np.zeros(len(hashes), np.int64)
    same[1:] = hashes[1:] == hashes[:-1]
    same[edge[:-1][counts > 0]] = 0
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)], float)
    n = counts.astype(float)
    mean = (per_text(length) + 5.5 * _LEAN) / (n + _LEAN)
    spread = (per_text(length.astype(float) ** 2) + 40 * _LEAN) / (n + _LEAN) - mean**2
    columns += [
        np.log1p(mean), share(per_text(same), n, 0.01), np.log((distinct + _LEAN) / (np.sqrt(n) + _LEAN)),
        share(per_text(length == 1), n, 0.01), share(per_text(length > 20), n, 0.01), np.log1p(np.maximum(spread, 0)),
    ]
    return np.stack(columns, 1)


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians. ``roots`` are the inverse Cholesky factors of their covariances, computed once."""

    means: np.ndarray
    roots: np.ndarray
    constants: np.ndarray  # log share minus half the log determinant
    low: np.ndarray
    high: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the Mahalanobis log densities."""
        x = np.clip(x, self.low, self.high)
        log = [c - 0.5 * (((x - m) @ r.T) ** 2).sum(1) for m, r, c in zip(self.means, self.roots, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def discriminant(count: np.ndarray, first: np.ndarray, second: np.ndarray, shrink: float, ridge: float) -> Discriminant:
    """From class counts, sums and sums of products. Covariances are shrunk towards the pooled one and its diagonal.

    A class without rows takes the pooled mean and covariance, and its share is that of one pseudo-row.
    """
    total = max(count.sum(), 1.0)
    d = first.shape[1]
    pooled_mean = first.sum(0) / total
    means = np.where(count[:, None] > 0, first / np.maximum(count, 1)[:, None], pooled_mean)
    within = [s - n * np.outer(m, m) for s, n, m in zip(second, count, means, strict=True)]
    pooled = sum(within) / total + 1e-6 * np.eye(d)
    roots, constants = [], []
    for n, w in zip(count, within, strict=True):
        kept = (1 - shrink) * n / (n + d)
        cov = kept * w / max(n, 1.0) + (1 - kept) * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(np.diag(pooled))
        factor = np.linalg.cholesky(cov)
        roots.append(np.linalg.inv(factor))
        constants.append(np.log((n + 1) / (total + 2)) - np.log(np.diag(factor)).sum())
    spread = np.sqrt(np.diag(pooled))
    return Discriminant(means, np.array(roots), np.array(constants), means.min(0) - 8 * spread, means.max(0) + 8 * spread)


def fit(stats: DataFrame, label: str, shrink: float, ridge: float) -> Discriminant:
    """Class counts, sums and products of all labelled rows as one Spark sum; the driver gets 2 (1 + d + d²) numbers."""
    d = len(STATISTICS)

    def sums(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column("stats").flatten(), float).reshape(-1, d)
            y = np.asarray(batch.column("label"), int)
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
        c, k = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_pydict({"label": c, "k": k, "v": total.ravel()})

    rows = stats.select("stats", F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    got = rows.mapInArrow(sums, "label long, k long, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    table = np.zeros((2, 1 + d + d * d))
    for r in got:
        table[r["label"], r["k"]] = r["v"]
    return discriminant(table[:, 0], table[:, 1 : 1 + d], table[:, 1 + d :].reshape(2, d, d), shrink, ridge)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _stats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = len(STATISTICS)

    def stats_of(batch: pa.RecordBatch) -> dict:
        flat = statistics(batch, text_col).ravel()
        return {"stats": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, d, dtype=np.int32), pa.array(flat))}

    kind = df.schema[id_col].dataType.simpleString()
    return written(map_texts(df, [id_col], text_col, stats_of, f"`{id_col}` {kind}, stats array<double>", SMALL_SLICE_BYTES), "text-statistics")


def _learned(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, shrink: float, ridge: float) -> Discriminant:
    known = labels.select(F.col(id_col), F.col(label_col).alias("label")).where(~held_out(id_col))
    return fit(stats.join(known, id_col), "label", shrink, ridge)


def accepted(
    df: DataFrame, labels: DataFrame, least: float = 0.3, shrink: float = 0.1, ridge: float = 0.02,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """The rows of ``df``, unchanged, that ``quality_scores`` gives at least ``least``; judged row by row, without a join."""
    model = _learned(_stats(df, id_col, text_col), labels, id_col, label_col, shrink, ridge)

    def kept(batches):
        for whole in batches:
            for batch in slices(whole, text_col, SMALL_SLICE_BYTES):
                yield batch.filter(pa.array(model.score(statistics(batch, text_col)) >= least))

    return df.mapInArrow(kept, df.schema)


def quality_scores(
    df: DataFrame, labels: DataFrame, least: float = 0.3, shrink: float = 0.1, ridge: float = 0.02,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row of ``df``.

    Learns from all rows of ``labels`` with label 0 or 1 whose crc32 of the id as text is no multiple of 5; a
    document with several label rows counts once for each. Other labels, null ids and ids without a document
    teach nothing. Only the statistics of the whole text enter the score; null counts as empty text. An empty
    table gives an empty table; without labels every score is near the same. Columns of other names are ignored.
    """
    kind, d = df.schema[id_col].dataType.simpleString(), len(STATISTICS)
    stats = _stats(df, id_col, text_col)
    model = _learned(stats, labels, id_col, label_col, shrink, ridge)

    def scored(batches):
        for batch in batches:
            x = np.asarray(batch.column("stats").flatten(), float).reshape(-1, d)
            yield pa.RecordBatch.from_pydict(
                {id_col: batch.column(id_col), "held_out": batch.column("held_out"), "score": model.score(x)}
            )

    out = stats.withColumn("held_out", held_out(id_col)).mapInArrow(scored, f"`{id_col}` {kind}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
