"""Train on labelled sequences and evaluate on the local test and on holdout sources."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.operators.automaton import Model
from seqmodel.operators.evaluate import holdout_report
from seqmodel.operators.profile import feature_summary
from seqmodel.operators.split import SEED, TRAIN_RATIO, train_full, train_test_split
from seqmodel.sources.scratch import written


@dataclass(frozen=True)
class Run:
    marked: DataFrame
    holdouts: DataFrame
    model: Model

    def report(self) -> DataFrame:
        """Rates per source; the local test is absent when everything was training."""
        return holdout_report(self.marked.filter("not is_train"), self.holdouts, self.model)

    def summary(self) -> DataFrame:
        """(item, source, number, note): sizes, features, states, percentages per source."""

        def rows(df: DataFrame, items: dict[str, Column], source=F.lit(""), notes=None) -> DataFrame:
            entries = [
                F.struct(
                    F.lit(name).alias("item"), source.alias("source"),
                    value.cast("double").alias("number"),
                    (notes or {}).get(name, F.lit("")).alias("note"),
                )
                for name, value in items.items()
            ]
            return df.select(F.inline(F.array(*entries)))

        sizes = self.marked.agg(
            F.count(F.lit(1)).alias("n"), F.count_if("is_train").alias("train")
        )
        percent = lambda name: F.round(F.col(name) * 100, 4)
        parts = [
            rows(sizes, {"samples": F.col("n"), "train": F.col("train"),
                         "test": F.col("n") - F.col("train")}),
            rows(
                feature_summary(self.marked),
                {"features": F.col("unique_count"), "features_truncated": F.col("truncated").cast("int")},
                notes={"features": F.col("sample_features")},
            ),
            rows(self.model.stats(), {"states_before": F.col("states_before"),
                                      "states_after": F.col("states_after")}),
            rows(
                self.report(),
                {"test_size": F.col("test_size"), "accuracy_percent": percent("accuracy"),
                 "false_positive_percent": percent("false_positive_rate"),
                 "false_negative_percent": percent("false_negative_rate")},
                F.col("source"),
            ),
        ]
        return reduce(DataFrame.unionByName, parts)


def train_and_evaluate(seqs: DataFrame, holdouts: DataFrame, ratio: float = TRAIN_RATIO,
                       seed: int = SEED, full: bool = False) -> Run:
    """Sequences are written once; every later pass reads only the columns it needs."""
    seqs = written(seqs, "sequences")
    marked = train_full(seqs) if full else train_test_split(seqs, ratio, seed)
    return Run(marked, holdouts, Model.fit(marked.filter("is_train")))
