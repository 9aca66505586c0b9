"""Push/pop checks on symbol arrays that already sit in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdict texts.
ACCEPTED = "accepted"
BAD_POP = "pop without matching push at position %d"
LEFT_OVER = "final stack not empty (%d unmatched pushes)"


def stack_effect(symbol: Column, push: str, pop: str) -> Column:
    return F.when(symbol == push, F.lit(1)).when(symbol == pop, F.lit(-1)).otherwise(F.lit(0))


def stack_reason(first_error: Column, depth: Column) -> Column:
    """Verdict text from the 0-based position of the first bad pop (or null) and the final depth."""
    return (
        F.when(first_error.isNotNull(), F.format_string(BAD_POP, first_error))
        .when(depth > 0, F.format_string(LEFT_OVER, depth))
        .otherwise(F.lit(ACCEPTED))
    )


def check_symbols(symbols: Column, push: str, pop: str) -> Column:
    """struct(first_error, depth) of one symbol array, folded in the row without a shuffle."""
    start = F.struct(
        F.lit(None).cast("long").alias("first_error"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("seen"),
    )

    def step(acc: Column, symbol: Column) -> Column:
        bad = acc["first_error"].isNull() & (symbol == pop) & (acc["depth"] == 0)
        return F.struct(
            F.when(bad, acc["seen"]).otherwise(acc["first_error"]).alias("first_error"),
            F.when(bad, acc["depth"])
            .otherwise(acc["depth"] + stack_effect(symbol, push, pop))
            .alias("depth"),
            (acc["seen"] + 1).alias("seen"),
        )

    return F.aggregate(symbols, start, step).dropFields("seen")
