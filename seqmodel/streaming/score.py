"""Classify sequences as they arrive.

The model is a static table, so a stream is scored by the same left join as a batch: no state, no
watermark, and each micro-batch is as parallel as its input. A broadcast side is read once per
micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqmodel.operators.automaton import Model
from seqmodel.operators.score import classify


def classify_stream(seqs: DataFrame, model: Model, out: str = "predicted") -> DataFrame:
    """``seqs`` is a streaming DataFrame with ``symbols``."""
    if not seqs.isStreaming:
        raise ValueError("not a streaming DataFrame; use operators.score.classify")
    return classify(seqs, model, out)
