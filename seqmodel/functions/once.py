"""Keep an expensive expression from being evaluated again in every filter above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column later predicates cannot be moved below.

    Catalyst pushes filters through projections by copying the expression. A one-element generator
    is a boundary for that, stays inside whole-stage codegen and needs no shuffle.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
