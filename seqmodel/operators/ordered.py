"""Running values over ordered groups, also when one group holds a large part of all rows.

A window puts a whole group into one task. Groups above ``limit`` rows are therefore cut into
segments of their own order: range-partitioned on (keys, order), so the sampled bounds fall inside
the large groups, and written once. A running value is then the value inside the segment combined
with the totals of the segments before it. Small groups take the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmodel.sources.scratch import written

LIMIT_CONF = "spark.seqmodel.rowsPerTask"
LIMIT_DEFAULT = 4_000_000
SEGMENT = "__segment"
_CARRY = "__carry"


def rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_CONF, str(LIMIT_DEFAULT)))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: list[str]
    order: list[str]
    cut: bool

    def _window(self, inclusive: bool):
        return (
            Window.partitionBy(*self.keys, SEGMENT)
            .orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        )

    def _carried(self, totals: DataFrame, over) -> DataFrame:
        """One row per (keys, segment) of the cut groups: their number is rows / limit."""
        before = (
            Window.partitionBy(*self.keys)
            .orderBy(SEGMENT)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return written(totals.select(*self.keys, SEGMENT, over(before).alias(_CARRY)), "carry", lookup=True)

    def _join_carry(self, df: DataFrame, carry: DataFrame, keep: list[Column]) -> DataFrame:
        on = same_keys(df, carry, [*self.keys, SEGMENT])
        return df.join(carry, on, "left").select(
            *[df[c] for c in df.columns if c not in ("__within",)], *keep
        )

    def running_sum(self, value: Column, out: str, inclusive: bool = True) -> "Ordered":
        within = F.coalesce(F.sum(value).over(self._window(inclusive)), F.lit(0))
        if not self.cut:
            return replace(self, df=self.df.withColumn(out, within))
        totals = (
            self.df.filter(F.col(SEGMENT) >= 0)
            .groupBy(*self.keys, SEGMENT)
            .agg(F.sum(value).alias("__total"))
        )
        carry = self._carried(totals, lambda w: F.sum("__total").over(w))
        df = self.df.withColumn("__within", within)
        total = df["__within"] + F.coalesce(carry[_CARRY], F.lit(0))
        return replace(self, df=self._join_carry(df, carry, [total.alias(out)]))

    def running_xor(self, value: Column, out: str) -> "Ordered":
        within = F.bit_xor(value).over(self._window(True))
        if not self.cut:
            return replace(self, df=self.df.withColumn(out, within))
        totals = (
            self.df.filter(F.col(SEGMENT) >= 0)
            .groupBy(*self.keys, SEGMENT)
            .agg(F.bit_xor(value).alias("__total"))
        )
        carry = self._carried(totals, lambda w: F.bit_xor("__total").over(w))
        df = self.df.withColumn("__within", within)
        total = df["__within"].bitwiseXOR(F.coalesce(carry[_CARRY], F.lit(0).cast("long")))
        return replace(self, df=self._join_carry(df, carry, [total.alias(out)]))

    def running_last(self, value: Column, out: str, inclusive: bool = True) -> "Ordered":
        """Latest non-null value so far (``inclusive=False``: before the current row)."""
        within = F.last(value, ignorenulls=True).over(self._window(inclusive))
        if not self.cut:
            return replace(self, df=self.df.withColumn(out, within))
        totals = (
            self.df.filter((F.col(SEGMENT) >= 0) & value.isNotNull())
            .groupBy(*self.keys, SEGMENT)
            .agg(F.max_by(value, F.struct(*self.order)).alias("__total"))
        )
        segments = self.df.filter(F.col(SEGMENT) >= 0).select(*self.keys, SEGMENT).distinct()
        on = same_keys(segments, totals, [*self.keys, SEGMENT])
        filled = segments.join(totals, on, "left").select(
            *[segments[c] for c in segments.columns], totals["__total"]
        )
        carry = self._carried(filled, lambda w: F.last("__total", ignorenulls=True).over(w))
        df = self.df.withColumn("__within", within)
        latest = F.coalesce(df["__within"], carry[_CARRY])
        return replace(self, df=self._join_carry(df, carry, [latest.alias(out)]))

    def with_column(self, name: str, value: Column) -> "Ordered":
        return replace(self, df=self.df.withColumn(name, value))

    def rows(self) -> DataFrame:
        return self.df.drop(SEGMENT)


def parted_by_size(
    df: DataFrame, keys: list[str], limit: int
) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of groups of at most ``limit`` rows, rows of larger groups (or None), rows of the latter.

    The list of large groups has at most rows / limit entries; a job looks whether there are any.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > limit)
    if sizes.isEmpty():
        return df, None, 0
    large = written(sizes, "large", lookup=True)
    total = large.agg(F.sum("__rows")).first()[0]
    on = same_keys(df, large, keys)
    return df.join(large, on, "left_anti"), df.join(large, on, "left_semi"), total


def ordered(df: DataFrame, keys: list[str], order: list[str], limit: int | None = None,
            largest: int | None = None) -> Ordered:
    """Prepare running values of ``df`` within ``keys`` along ``order`` (unique per key).

    ``largest`` is a known bound of the group size; up to ``limit`` it saves the look at the sizes.
    """
    limit = limit or rows_per_task(df)
    if largest is not None and largest <= limit:
        return Ordered(df.withColumn(SEGMENT, F.lit(-1)), keys, order, False)
    small, large, total = parted_by_size(df, keys, limit)
    small = small.withColumn(SEGMENT, F.lit(-1))
    if large is None:
        return Ordered(small, keys, order, False)
    segments = written(
        large.repartitionByRange(-(-total // limit) + 1, *keys, *order)
        .withColumn(SEGMENT, F.spark_partition_id()),
        "segments",
    )
    return Ordered(small.unionByName(segments), keys, order, True)


def numbered(df: DataFrame, order: list[str], out: str, limit: int | None = None,
             largest: int | None = None) -> DataFrame:
    """Row numbers from 0 along a total order over the whole table of at most ``largest`` rows."""
    whole = df.withColumn("__all", F.lit(0))
    rows = ordered(whole, ["__all"], order, limit, largest).running_sum(F.lit(1), out).rows()
    return rows.withColumn(out, (F.col(out) - 1).cast("long")).drop("__all")
