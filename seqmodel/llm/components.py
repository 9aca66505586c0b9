"""Connected components by smallest labels, with the labels as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmodel.sources.scratch import discard, written


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` of every node of ``links`` (a, b): the smallest node it is connected with.

    Each round takes the smallest label among the neighbours and then the label of that label, so chains shrink
    by half or better. Rounds end when no label changes. Nulls are not expected; an empty table gives none.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.select("node", "comp").join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
        new = lower.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("over", "comp")).alias("comp"))
        new = written(new, "labels")
        discard(labels)
        if new.where("comp <> was").isEmpty():
            discard(both)
            return new.select("node", "comp")
        labels = new
