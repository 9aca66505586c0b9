"""Walking sequences through an automaton that is given, with cycles and missing transitions.

Every block of symbols maps each state to the state it leads to. These maps compose, so the state before a block is a
running value over the blocks: maps of neighbouring blocks are put together level by level, and the states found for
the larger ones are handed down to the smaller. Sequences of one block need no maps. Symbols that have no transition
from a state leave it as it is ('stay'), or end the walk and say where ('fail').
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.operators.ordered import same_keys
from seqmodel.operators.score import ACCEPTED, NO_TRANSITION, NOT_ACCEPTING, verdict
from seqmodel.operators.sessions import positions
from seqmodel.sources.scratch import written

# Fixed value: the verdict of an automaton without states.
EMPTY_GRAMMAR = "empty grammar"

BLOCK_EVENTS = 128
BLOCKS_TOGETHER = 32
#: The table of transitions travels with every task, so its size is checked.
MOST_CELLS = 4_000_000

STAY, FAIL = "stay", "fail"


@dataclass(frozen=True)
class Given:
    """States with their verdicts, and (state, symbol) -> state for the pairs that have a transition."""

    accepting: dict[str, bool]
    moves: dict[tuple[str, str], str]
    start: str | None

    @classmethod
    def of(cls, states: DataFrame, transitions: DataFrame, start: str | None = None) -> "Given":
        """From tables (state, accepting) and (state, symbol, next_state); ``start`` is one of the states.

        Tables of more than ``MOST_CELLS`` rows are refused before they are read.
        """
        if max(states.limit(MOST_CELLS + 1).count(), transitions.limit(MOST_CELLS + 1).count()) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} states or transitions")
        accepting = {r["state"]: bool(r["accepting"]) for r in states.collect()}
        moves: dict[tuple[str, str], str] = {}
        for r in transitions.select("state", "symbol", "next_state").collect():
            if r["state"] not in accepting or r["next_state"] not in accepting:
                raise ValueError(f"transition of an unknown state: {r['state']} to {r['next_state']}")
            if moves.setdefault((r["state"], r["symbol"]), r["next_state"]) != r["next_state"]:
                raise ValueError(f"two transitions from {r['state']} on {r['symbol']}")
        if accepting and start not in accepting:
            raise ValueError(f"unknown state: {start}")
        given = cls(accepting, moves, start)
        if len(given.names) * len(given.symbols) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} pairs of a state and a symbol")
        return given

    @cached_property
    def names(self) -> list[str]:
        return sorted(self.accepting)

    @cached_property
    def symbols(self) -> list[str]:
        return sorted({s for _, s in self.moves})

    def alphabet(self, spark) -> DataFrame:
        """(symbol, column): which targets of ``table`` belong to a symbol."""
        rows = [(s, i) for i, s in enumerate(self.symbols)]
        return spark.createDataFrame(rows, "symbol string, letter int")

    def table(self, on_missing: str) -> Column:
        """Next state of (letter, state) at ``letter * states + state``; -1 has none."""
        number = {name: i for i, name in enumerate(self.names)}
        cells = [
            number[self.moves[name, s]] if (name, s) in self.moves else (i if on_missing == STAY else -1)
            for s in self.symbols for i, name in enumerate(self.names)
        ]
        return F.split(F.lit(",".join(map(str, cells))), ",").cast("array<int>") if cells else F.array().cast("array<int>")


def _step(table: Column, states: int, on_missing: str):
    """State after one letter; -1 is the state of a failed walk, a null letter is in no transition."""

    def step(state: Column, letter: Column) -> Column:
        moved = F.get(table, letter * states + state)
        lost = state if on_missing == STAY else F.lit(-1)
        return F.when(state < 0, F.lit(-1)).when(letter.isNull(), lost).otherwise(moved)

    return step


def _composed(maps: Column, state: Column) -> Column:
    return F.aggregate(maps, state, lambda s, m: F.when(s < 0, F.lit(-1)).otherwise(F.get(m, s)))


def _states_before(maps: DataFrame, keys: list[str], states: int, first: int) -> DataFrame:
    """(keys, no, state) before each map of ``maps`` (keys, no, map), numbered from 0 per key without gaps."""
    if not maps.where("no > 0").limit(1).count():
        return maps.select(*keys, "no", F.lit(first).alias("state"))
    over = F.floor(F.col("no") / BLOCKS_TOGETHER).alias("over")
    items = F.array_sort(F.collect_list(F.struct("no", "map")))
    groups = written(maps.groupBy(*keys, over).agg(F.transform(items, lambda x: x["map"]).alias("maps")), "blocks")
    whole = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: _composed(F.col("maps"), s))
    upper = written(groups.select(*keys, F.col("over").alias("no"), whole.alias("map")), "maps")
    entered = _states_before(upper, keys, states, first).withColumnRenamed("no", "over")
    nth = F.sequence(F.lit(0), F.size("maps") - 1)
    # at most BLOCKS_TOGETHER maps, so starting over for each of them costs a bounded factor
    inner = F.transform(nth, lambda i: _composed(F.slice("maps", F.lit(1), i), F.col("state")))
    joined = groups.join(entered, same_keys(groups, entered, [*keys, "over"]))
    joined = joined.select(*[groups[c] for c in groups.columns], entered["state"])
    rows = joined.select(*keys, "over", F.posexplode(inner).alias("i", "state"))
    return rows.select(*keys, (F.col("over") * BLOCKS_TOGETHER + F.col("i")).alias("no"), "state")


def _blocks(events: DataFrame, keys: list[str], order: list[str], symbol: Column, given: Given, limit: int | None,
            block_events: int) -> DataFrame:
    """(keys, no, symbols, letters) of every block of events."""
    rows = positions(events.withColumn("symbol", symbol), keys, [*order, "symbol"], "pos", limit)
    rows = rows.select(*keys, "pos", "symbol").join(given.alphabet(events.sparkSession), "symbol", "left")
    items = F.array_sort(F.collect_list(F.struct("pos", "symbol", "letter")))
    blocks = rows.groupBy(*keys, F.floor(F.col("pos") / block_events).alias("no")).agg(items.alias("items"))
    return blocks.select(
        *keys, "no", F.transform("items", lambda x: x["symbol"]).alias("symbols"),
        F.transform("items", lambda x: x["letter"]).alias("letters"),
    )


def _entered(events: DataFrame, keys: list[str], order: list[str], symbol: Column, given: Given, on_missing: str,
             limit: int | None, block_events: int) -> tuple[DataFrame, Column]:
    """The blocks with the ``state`` before each, and the table of transitions."""
    blocks = written(_blocks(events, keys, order, symbol, given, limit, block_events), "symbol-blocks")
    table, first, states = given.table(on_missing), given.names.index(given.start), len(given.names)
    step = _step(F.col("__table"), states, on_missing)
    longer = blocks.where("no > 0").select(*keys).distinct()
    if longer.isEmpty():
        return blocks.withColumns({"state": F.lit(first), "__table": table}), step
    longer = written(longer, "longer", lookup=True)
    into = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate("letters", s, step))
    maps = blocks.join(longer, same_keys(blocks, longer, keys), "left_semi").withColumn("__table", table).select(*keys, "no", into.alias("map"))
    before = written(_states_before(written(maps, "maps"), keys, states, first), "states-before", lookup=True)
    joined = blocks.join(before, same_keys(blocks, before, [*keys, "no"]), "left")
    joined = joined.select(*[blocks[c] for c in blocks.columns], F.coalesce(before["state"], F.lit(first)).alias("state"))
    return joined.withColumn("__table", table), step


def _name(given: Given, state: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in given.names]), state)


def walk(events: DataFrame, keys: list[str], order: list[str], symbol: Column, given: Given, on_missing: str = STAY,
         limit: int | None = None, block_events: int = BLOCK_EVENTS) -> DataFrame:
    """(keys, final_state, accepted, verdict, reason) of the sequence of each key's events.

    With 'fail' the reason is the first symbol without a transition and the state it was met in; an automaton without
    states rejects all with ``EMPTY_GRAMMAR``. Events of equal order go by symbol; null symbols have no transition.
    """
    if not given.accepting:
        rejected = [F.lit(None).cast("string").alias("final_state"), F.lit(False).alias("accepted"),
                    verdict(F.lit(False)).alias("verdict"), F.lit(EMPTY_GRAMMAR).alias("reason")]
        return events.select(*keys).distinct().select(*keys, *rejected)
    blocks, step = _entered(events, keys, order, symbol, given, on_missing, limit, block_events)

    def go(acc: Column, letter: Column) -> Column:
        state = step(acc["state"], letter)
        lost = (state < 0) & (acc["state"] >= 0)
        return F.struct(
            state.alias("state"), (acc["seen"] + 1).alias("seen"),
            F.when(lost, F.struct(acc["seen"].alias("at"), acc["state"].alias("from"))).otherwise(acc["lost"]).alias("lost"),
        )

    begin = F.struct(
        F.col("state").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("struct<at:int,from:int>").alias("lost")
    )
    ends = blocks.select(*keys, "no", "symbols", F.aggregate("letters", begin, go).alias("end"))
    at = F.col("end.lost.at")
    lost = F.when(at.isNotNull(), F.struct(
        (F.col("no") * block_events + at).alias("at"), F.col("end.lost.from").alias("from"), F.get("symbols", at).alias("symbol")
    ))
    last = ends.groupBy(*keys).agg(F.max(F.struct("no", F.col("end.state").alias("state"))).alias("last"), F.min(lost).alias("lost"))
    state, name = F.col("last.state"), _name(given, F.col("last.state"))
    accepted = (state >= 0) & F.coalesce(F.get(F.array(*[F.lit(given.accepting[n]) for n in given.names]), state), F.lit(False))
    failed = F.format_string(NO_TRANSITION, F.col("lost.symbol"), _name(given, F.col("lost.from")), F.col("lost.at"))
    reason = F.when(F.col("lost").isNotNull(), failed).when(accepted, F.lit(ACCEPTED)).otherwise(F.format_string(NOT_ACCEPTING, name))
    shown = F.when(F.col("lost").isNotNull(), _name(given, F.col("lost.from"))).otherwise(name)
    return last.select(
        *keys, shown.alias("final_state"), accepted.alias("accepted"), verdict(accepted).alias("verdict"), reason.alias("reason")
    )


def walk_trace(events: DataFrame, keys: list[str], order: list[str], symbol: Column, given: Given, on_missing: str = STAY,
               limit: int | None = None, block_events: int = BLOCK_EVENTS) -> DataFrame:
    """(keys, step, current_state, symbol, next_state), one row per symbol; with 'fail' up to the last one that moved."""
    if not given.accepting:
        raise ValueError(EMPTY_GRAMMAR)
    blocks, step = _entered(events, keys, order, symbol, given, on_missing, limit, block_events)
    # a block has a bounded number of states to copy
    begin = F.array(F.col("state"))
    path = F.aggregate("letters", begin, lambda acc, letter: F.array_append(acc, step(F.get(acc, F.size(acc) - 1), letter)))
    rows = blocks.select(*keys, "no", "symbols", path.alias("path")).select(*keys, "no", "path", F.posexplode("symbols").alias("i", "symbol"))
    here, there = F.get("path", F.col("i")), F.get("path", F.col("i") + 1)
    return rows.where(there >= 0).select(
        *keys, (F.col("no") * block_events + F.col("i")).alias("step"), _name(given, here).alias("current_state"), "symbol",
        _name(given, there).alias("next_state"),
    )
