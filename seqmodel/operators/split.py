"""Seeded train/test split with an exact training size, without sorting the data.

Rows are ranked by md5(seed:id). Counting rows per leading hex digits (a map-side aggregate of at
most 4096 groups) shows which prefix the cut falls into; everything before it is training,
everything after it is test, decided per row without a shuffle. Only the rows of the boundary
prefix are ranked, after refining it until it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.operators.ordered import ordered, rows_per_task
from seqmodel.sources.scratch import written

# Fixed values.
TRAIN_RATIO = 0.7
SEED = 42

_DIGITS = 3
_KEY_LENGTH = 32


def train_size(n: int, ratio: float) -> int:
    """Truncated n*ratio, moved off 0 and off n (one single row is training)."""
    if not 0.0 < ratio < 1.0:
        raise ValueError("train ratio must be between 0 and 1, both excluded")
    if n == 0:
        return 0
    k = int(n * ratio)
    if k == 0:
        return 1
    return n - 1 if k == n else k


def split_key(id_column: str, seed: int) -> Column:
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def _boundary(keyed: DataFrame, ratio: float, limit: int) -> tuple[str, int, int]:
    """(prefix, how many rows have it, how many of these are training)."""
    prefix, take, n = "", None, 0
    while len(prefix) < _KEY_LENGTH:
        width = min(len(prefix) + _DIGITS, _KEY_LENGTH)
        counts = sorted(
            keyed.filter(F.col("__key").startswith(prefix))
            .groupBy(F.substring("__key", 1, width).alias("p"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        if take is None:
            take = train_size(sum(n for _, n in counts), ratio)
        for p, n in counts:
            if take <= n:
                break
            take -= n
        else:
            return "", 0, 0
        prefix = p
        if n <= limit:
            break
    return prefix, n, take


def train_test_split(seqs: DataFrame, ratio: float = TRAIN_RATIO, seed: int = SEED,
                     id_column: str = "id", limit: int | None = None) -> DataFrame:
    """``seqs`` with ``is_train``, a comparison per row with the cut found beforehand.

    Only if the cut falls between rows of equal id are those rows ranked in the result.
    """
    train_size(0, ratio)
    keyed = seqs.withColumn("__key", split_key(id_column, seed))
    limit = limit or rows_per_task(seqs)
    prefix, n, take = _boundary(keyed, ratio, limit)
    if not prefix:
        return seqs.withColumn("is_train", F.lit(True))
    edge = keyed.filter(F.col("__key").startswith(prefix))
    around = (
        _ranked(edge, n, limit)
        .filter(F.col("__nth").isin(take, take + 1))
        .select("__nth", "__key")
        .orderBy("__nth")
        .collect()
    )
    key, cut = F.col("__key"), around[0]["__key"]
    if len(around) == 1 or around[1]["__key"] != cut:
        return keyed.withColumn("is_train", key <= cut).drop("__key")
    clear = keyed.filter(key != cut).withColumn("is_train", key < cut)
    taken = take - edge.filter(key < cut).count()
    same = _ranked(edge.filter(key == cut), n, limit)
    same = same.withColumn("is_train", F.col("__nth") <= taken).drop("__nth")
    # Which copies are training is settled by writing them: train and test stay disjoint.
    return clear.unionByName(written(same, "copies")).drop("__key")


def _ranked(rows: DataFrame, n: int, limit: int) -> DataFrame:
    marked = rows.withColumn("__all", F.lit(0)).withColumn("__row", F.monotonically_increasing_id())
    ranked = ordered(marked, ["__all"], ["__key", "__row"], limit, largest=n)
    return ranked.running_sum(F.lit(1), "__nth").rows().drop("__all", "__row")


def train_full(seqs: DataFrame) -> DataFrame:
    """Everything is training, no local test."""
    return seqs.withColumn("is_train", F.lit(True))
