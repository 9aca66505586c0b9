"""Automaton with equivalent states merged, as tables.

Prefixes with the same residual digest accept the same suffixes, so they form one state: merging is
a ``groupBy``. Prefixes without any accepted continuation share the sink's state. Transitions are
kept sparse: a (state, symbol) pair that is not listed leads to the sink.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.operators import profile
from seqmodel.operators.ordered import numbered
from seqmodel.operators.prefix_tree import (
    KEY, RESIDUAL, majority, prefix_edges, prefix_nodes, ranked_votes, sequence_key, terminal_votes, with_prefix,
)
from seqmodel.sources.scratch import written

# Fixed value: the sink counts as one negative example.
SINK_NEG = 1

# Names in the rules of a grammar.
START_SYMBOL, OTHER_PREFIX, EMPTY = "S", "A", "ε"

ALPHABET_BLOCK = 1000


def merged_states(nodes: DataFrame) -> DataFrame:
    """One row per residual digest: summed counts, re-voted verdict, smallest prefix, flags.

    The smallest prefix of a state (shortest, then first in order) is named by its key and the rank of a sequence
    through it. The sink exists as soon as there is an edge, since a finite tree has a leaf.
    """
    sink = nodes.agg(F.max("depth").alias("d")).filter(F.col("d") > 0)
    nothing = F.lit(None).cast("long")
    sink = sink.select(
        F.lit(None).cast("int").alias("depth"), *[nothing.alias(c) for c in ("first", "ka", "kb")],
        F.lit(0).cast("long").alias("pos"), F.lit(SINK_NEG).cast("long").alias("neg"),
        *[F.lit(0).cast("long").alias(c) for c in RESIDUAL], F.lit(True).alias("sink"),
    )
    known = nodes.drop("symbol", "pa", "pb").withColumn("sink", F.lit(False)).unionByName(sink)
    rep = F.when(F.col("depth").isNotNull(), F.struct("depth", "first", "ka", "kb"))
    states = known.groupBy(*RESIDUAL).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min(rep).alias("rep"),
        F.max("sink").alias("is_sink"),
    )
    return states.select(
        *RESIDUAL, "pos", "neg", (F.col("pos") > F.col("neg")).alias("accepting"),
        F.col("rep.depth").alias("rep_depth"), F.col("rep.first").alias("rep_first"),
        F.col("rep.ka").alias("rep_ka"), F.col("rep.kb").alias("rep_kb"),
        F.coalesce(F.col("rep.depth") == 0, F.lit(False)).alias("is_start"), "is_sink",
    )


def numbered_states(states: DataFrame, limit: int | None = None,
                    largest: int | None = None) -> DataFrame:
    """``state_id`` from 0 by (length, value) of the smallest prefix; a sink without one is last."""
    length = F.coalesce("rep_depth", F.lit(2**31 - 1))
    order = ["__len", "rep_first"]
    ranked = numbered(states.withColumn("__len", length), order, "state_id", limit, largest)
    return ranked.drop("__len")


def prefix_states(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """(key, state_id) of every tree node."""
    return nodes.join(states.select(*RESIDUAL, "state_id"), RESIDUAL).select(*KEY, "state_id")


def merged_transitions(nodes: DataFrame, prefix_state: DataFrame) -> DataFrame:
    """(state_id, symbol, next_state_id) of the tree edges, mapped to states."""
    edges = prefix_edges(nodes).join(prefix_state.withColumnRenamed("state_id", "next_state_id"), KEY)
    source = prefix_state.toDF("parent_depth", "parent_a", "parent_b", "state_id")
    mapped = edges.join(source, ["parent_depth", "parent_a", "parent_b"])
    return mapped.select("state_id", "symbol", "next_state_id").distinct()


class Model:
    """The tables of one trained automaton. Those others join against are written, once, when first used."""

    def __init__(self, votes: DataFrame):
        self.votes = votes

    @classmethod
    def fit(cls, seqs: DataFrame) -> "Model":
        return cls(written(terminal_votes(seqs), "votes", lookup=True))

    @cached_property
    def accepted(self) -> DataFrame:
        """Keys of the accepted sequences; enough to classify."""
        keys = majority(self.votes).filter("accepting").select(*[c.alias(n) for n, c in sequence_key().items()])
        return written(keys, "accepted", lookup=True)

    @cached_property
    def ranked(self) -> DataFrame:
        return ranked_votes(self.votes)

    @cached_property
    def nodes(self) -> DataFrame:
        return written(prefix_nodes(self.ranked), "nodes")

    @cached_property
    def states(self) -> DataFrame:
        most = self.nodes.count() + 1
        states = numbered_states(merged_states(self.nodes), largest=most)
        return written(states, "states", lookup=True)

    @cached_property
    def prefix_state(self) -> DataFrame:
        return written(prefix_states(self.nodes, self.states), "prefix_state", lookup=True)

    @cached_property
    def transitions(self) -> DataFrame:
        return merged_transitions(self.nodes, self.prefix_state)

    def named_prefixes(self) -> DataFrame:
        """(prefix, state_id) of every tree node, spelled out."""
        return with_prefix(self.nodes.join(self.states.select(*RESIDUAL, "state_id"), RESIDUAL), self.ranked).select("prefix", "state_id")

    def named_states(self) -> DataFrame:
        """The states with their smallest prefix spelled out as ``rep_prefix``; null for a sink without one."""
        return with_prefix(self.states, self.ranked, "rep_depth", "rep_first", "rep_prefix")

    @cached_property
    def alphabet(self) -> DataFrame:
        return written(profile.alphabet(self.votes), "alphabet", lookup=True)

    @cached_property
    def sink_id(self) -> int | None:
        row = self.states.filter("is_sink").select("state_id").first()
        return None if row is None else row[0]

    def state(self, name: str) -> dict:
        """The row of a state named `s<i>`; an unknown name is an error."""
        digits = name[1:]
        row = None
        if name[:1] == "s" and digits.isdecimal() and str(int(digits)) == digits:
            row = self.states.filter(F.col("state_id") == int(digits)).first()
        if row is None:
            raise ValueError(f"unknown state: {name}")
        return row.asDict()

    def or_sink(self, state_id: Column) -> Column:
        return state_id if self.sink_id is None else F.coalesce(state_id, F.lit(self.sink_id))

    def complete_transitions(self) -> DataFrame:
        """Transitions of every (state, symbol); what the tree lacks goes to the sink.

        The answer has states x symbols rows by definition. States meet the alphabet by an
        equi-join on the number of an alphabet block, so neither side has to fit anywhere.
        """
        symbols = self.alphabet.count()
        if symbols == 0:
            return self.transitions
        count = -(-symbols // ALPHABET_BLOCK)
        blocks = (
            numbered(self.alphabet, ["symbol"], "nth", largest=symbols)
            .groupBy(F.floor(F.col("nth") / ALPHABET_BLOCK).alias("block"))
            .agg(F.collect_list("symbol").alias("symbols"))
        )
        ids = self.states.select(
            "state_id",
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("block"),
        )
        pairs = ids.join(blocks, "block").select("state_id", F.explode("symbols").alias("symbol"))
        return pairs.join(self.transitions, ["state_id", "symbol"], "left").select(
            "state_id", "symbol", self.or_sink(F.col("next_state_id")).alias("next_state_id")
        )

    def definition(self) -> DataFrame:
        """The model as one long table: (part, item, value) rows for Q, alphabet, q0, F, sink, delta."""
        name = state_name(F.col("state_id"))
        nothing = F.lit("")
        part = lambda label: F.lit(label).alias("part")
        states = self.states
        rows = [
            states.select(part("state"), name.alias("item"), nothing.alias("value")),
            self.alphabet.select(part("alphabet"), F.col("symbol").alias("item"), nothing.alias("value")),
            states.filter("is_start").select(part("start"), name.alias("item"), nothing.alias("value")),
            states.filter("accepting").select(part("accepting"), name.alias("item"), nothing.alias("value")),
            states.filter("is_sink").select(part("sink"), name.alias("item"), nothing.alias("value")),
            self.complete_transitions().select(
                part("transition"),
                F.concat(name, F.lit(" "), F.col("symbol")).alias("item"),
                state_name(F.col("next_state_id")).alias("value"),
            ),
        ]
        return reduce(DataFrame.unionByName, rows)

    def grammar(self) -> DataFrame:
        """The model as right-linear rules (lhs, terminal, rhs): `A -> a B` for every transition,
        `A -> a` where it ends accepting, and the empty rule if the start accepts."""
        left = self.states.select("state_id", grammar_name("state_id").alias("lhs"))
        right = self.states.select(
            F.col("state_id").alias("next_state_id"), grammar_name("state_id").alias("rhs"), "accepting"
        )
        steps = self.complete_transitions().join(left, "state_id").join(right, "next_state_id")
        ends = F.when(F.col("accepting"), F.array("rhs", F.lit(""))).otherwise(F.array("rhs"))
        empty = self.states.filter("is_start and accepting")
        return steps.select("lhs", F.col("symbol").alias("terminal"), F.explode(ends).alias("rhs")).unionByName(
            empty.select(grammar_name("state_id").alias("lhs"), F.lit(EMPTY).alias("terminal"), F.lit("").alias("rhs"))
        )

    def stats(self) -> DataFrame:
        """States before merging (tree nodes and the sink) and after."""
        before = self.nodes.select(F.lit(1).alias("before"), F.lit(0).alias("after"))
        after = self.states.select(F.lit(0).alias("before"), F.lit(1).alias("after"))
        added = self.states.filter("is_sink").select(F.lit(1).alias("before"), F.lit(0).alias("after"))
        return before.unionByName(after).unionByName(added).agg(
            F.sum("before").alias("states_before"), F.sum("after").alias("states_after")
        )


def grammar_name(state_id: str) -> Column:
    """`S` for the start, which is state 0, then `A0`, `A1`, ..."""
    other = F.concat(F.lit(OTHER_PREFIX), (F.col(state_id) - 1).cast("string"))
    return F.when(F.col(state_id) == 0, F.lit(START_SYMBOL)).otherwise(other)


def state_name(state_id: Column) -> Column:
    return F.concat(F.lit("s"), state_id.cast("string"))
