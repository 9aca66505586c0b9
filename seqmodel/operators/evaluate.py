"""Confusion counts and rates, per source in one pass.

Test rows are counted per (source, sequence) first. Only these counts meet the model, so neither a
frequent sequence nor a large source makes the join uneven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.operators.automaton import Model
from seqmodel.operators.prefix_tree import KEY, sequence_key
from seqmodel.operators.score import with_verdict

COUNTS = ("tp", "tn", "fp", "fn")
LOCAL_TEST = "combined_inputs"


def confusion(seqs: DataFrame, model: Model, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counted = seqs.withColumns(sequence_key()).groupBy(*by, *KEY).agg(
        F.count_if(F.col("label")).alias("pos"), F.count_if(~F.col("label")).alias("neg")
    )
    hit = F.col("predicted")
    cells = {
        "tp": F.when(hit, F.col("pos")), "tn": F.when(~hit, F.col("neg")),
        "fp": F.when(hit, F.col("neg")), "fn": F.when(~hit, F.col("pos")),
    }
    total = lambda cell: F.coalesce(F.sum(cell), F.lit(0)).cast("long")
    return with_verdict(counted, model, "predicted").groupBy(*by).agg(
        *[total(cells[name]).alias(name) for name in COUNTS]
    )


def rate(part: Column, whole: Column) -> Column:
    """0.0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(name) for name in COUNTS)
    return counts.select(
        "*", (tp + tn + fp + fn).alias("test_size"),
        rate(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        rate(fp, fp + tn).alias("false_positive_rate"),
        rate(fn, fn + tp).alias("false_negative_rate"),
    )


def metrics(seqs: DataFrame, model: Model) -> DataFrame:
    return rates(confusion(seqs, model)).drop(*COUNTS)


def holdout_report(local_test: DataFrame, holdouts: DataFrame, model: Model) -> DataFrame:
    """One row for the local test and one per holdout source; sources without rows are absent."""
    local = local_test.withColumn("source", F.lit(LOCAL_TEST))
    columns = ["source", "symbols", "label"]
    both = local.select(columns).unionByName(holdouts.select(columns))
    return rates(confusion(both, model, ["source"])).drop(*COUNTS)
