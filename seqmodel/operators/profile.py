"""Counts over symbols and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmodel.sources.scratch import written

# Fixed value: how many symbols a summary shows.
MAX_DISPLAY = 20


def alphabet(seqs: DataFrame) -> DataFrame:
    """Distinct symbols."""
    return seqs.select(F.explode("symbols").alias("symbol")).distinct()


def feature_summary(seqs: DataFrame, max_display: int = MAX_DISPLAY) -> DataFrame:
    """One row: number of distinct symbols, the first ones in order, whether there are more."""
    symbols = written(alphabet(seqs), "symbols")
    total = symbols.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("shown"))
    first = symbols.orderBy("symbol").limit(max_display)
    shown = first.agg(
        F.lit(None).cast("long").alias("n"),
        F.array_join(F.array_sort(F.collect_list("symbol")), ", ").alias("shown"),
    )
    return total.unionByName(shown).agg(
        F.max("n").alias("unique_count"),
        F.max("shown").alias("sample_features"),
        (F.max("n") > max_display).alias("truncated"),
    )


def dataset_counts(seqs: DataFrame, by: list[str]) -> DataFrame:
    return seqs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
