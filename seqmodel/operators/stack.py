"""Push/pop checks on event rows, however many events one sequence has.

The depth is a running sum of +1/-1. Verdict and trace come from running values only, so no
sequence is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.functions.stack import ACCEPTED, stack_effect, stack_reason
from seqmodel.operators.ordered import Ordered, ordered

# The symbols, the control states and the operation names.
PUSH, POP = "state=S0", "state=SF"
CONTROL_PREFIX = "proto="
CONTROL_STATES = {"tcp": "TCP", "udp": "UDP"}
CONTROL_START, CONTROL_OTHER = "Start", "OTHER"
OP_PUSH, OP_POP, OP_NONE, OP_ERROR = "PUSH", "POP", "NO_OP", "POP_ERROR"


def _depths(events: DataFrame, keys: list[str], order: list[str], symbol: str, push: str, pop: str,
            limit: int | None) -> Ordered:
    rows = ordered(events, keys, order, limit)
    rows = rows.with_column("__effect", stack_effect(F.col(symbol), push, pop))
    return rows.running_sum(F.lit(1), "__nth").running_sum(F.col("__effect"), "depth")


def stack_balance(events: DataFrame, keys: list[str], order: list[str], symbol: str = "symbol",
                  push: str = PUSH, pop: str = POP, limit: int | None = None) -> DataFrame:
    """(keys, ok, reason): the first pop on an empty stack, else what is left over, else accepted."""
    rows = _depths(events, keys, order, symbol, push, pop, limit).rows()
    per_key = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("depth") < 0, F.col("__nth") - 1)).alias("first_error"),
        F.sum("__effect").alias("left"),
    )
    reason = stack_reason(F.col("first_error"), F.col("left"))
    return per_key.select(*keys, (reason == ACCEPTED).alias("ok"), reason.alias("reason"))


def control_state(symbol: Column, prefix: str, states: dict[str, str], other: str) -> Column:
    """The control state a symbol switches to, null if it switches nothing."""
    value = F.substr(symbol, F.lit(len(prefix) + 1))
    named = F.lit(other)
    for text, state in states.items():
        named = F.when(value == text, F.lit(state)).otherwise(named)
    return F.when(symbol.startswith(prefix), named)


def stack_trace(events: DataFrame, keys: list[str], order: list[str], symbol: str = "symbol",
                push: str = PUSH, pop: str = POP, prefix: str = CONTROL_PREFIX,
                states: dict[str, str] = CONTROL_STATES, other: str = CONTROL_OTHER,
                limit: int | None = None) -> DataFrame:
    """One row per event up to and with the first bad pop: step, op, stack depth, control states.

    All stack entries are the push symbol, so the depth says the whole stack; ``stack_after`` spells
    it out.
    """
    events = events.withColumn("__switch", control_state(F.col(symbol), prefix, states, other))
    rows = _depths(events, keys, order, symbol, push, pop, limit)
    switch = F.col("__switch")
    rows = rows.running_last(switch, "__next").running_last(switch, "__current", inclusive=False)
    rows = rows.with_column("__error", F.when(F.col("depth") < 0, F.lit(1)).otherwise(F.lit(0)))
    rows = rows.running_sum(F.col("__error"), "__errors", inclusive=False)
    bad = F.col("__error") == 1
    op = (
        F.when(bad, F.lit(OP_ERROR))
        .when(F.col("__effect") == 1, F.lit(OP_PUSH))
        .when(F.col("__effect") == -1, F.lit(OP_POP))
        .otherwise(F.lit(OP_NONE))
    )
    return rows.rows().filter(F.col("__errors") == 0).select(
        *keys, (F.col("__nth") - 1).cast("long").alias("step"), op.alias("op"),
        F.col(symbol).alias("symbol"),
        F.when(bad, F.lit(0)).otherwise(F.col("depth")).cast("long").alias("stack_depth"),
        F.coalesce("__current", F.lit(CONTROL_START)).alias("current_state"),
        F.coalesce("__next", F.lit(CONTROL_START)).alias("next_state"),
    )


def stack_after(depth: Column, push: str = PUSH) -> Column:
    return F.array_repeat(F.lit(push), depth.cast("int"))
