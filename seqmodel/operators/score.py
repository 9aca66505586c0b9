"""Scoring sequences with a trained model.

The walk through the automaton is an equi-join on the 20-byte key of a sequence: it ends in the state of the node of
its own key, or in the sink if the tree does not have it. Three rules for symbols the model does not know:

- ``classify`` / ``final_state``: they lead to the sink;
- ``*_stay``: they leave the state as it is, which equals leaving them out;
- ``classify_reason``: the walk fails there and says where.

A row without a sequence (null) is negative and has no state. Whatever depends on a sequence's content only is computed
once per distinct sequence and joined back by its key, so copies cost nothing. These per-sequence results are written
first: while they are small the rows are scored by a broadcast join and never shuffled; past that size it is a
sort-merge join, of which AQE splits the partition that one frequent sequence makes large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.operators.automaton import Model, state_name
from seqmodel.operators.ordered import ordered
from seqmodel.operators.prefix_tree import KEY, SEQUENCE, letter_hash, prefix_rows, sequence_key
from seqmodel.sources.scratch import written

# Verdict names and texts.
POSITIVE, NEGATIVE = "Malicious", "Benign"
ACCEPTED = "accepted"
NO_TRANSITION = "no transition on '%s' from state '%s' at position %d"
NO_SEQUENCE = "no sequence"
NOT_ACCEPTING = "ended in non-accepting state '%s'"


def verdict(accepting: Column) -> Column:
    return F.when(accepting, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))


def with_verdict(keyed: DataFrame, model: Model, out: str) -> DataFrame:
    """``out`` of rows that carry the key of their sequence."""
    accepted = model.accepted.withColumn(out, F.lit(True))
    return keyed.join(accepted, KEY, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def _by_key(seqs: DataFrame, found: DataFrame) -> DataFrame:
    """``seqs`` with the columns of ``found``, which has one row per ``SEQUENCE`` key."""
    return seqs.withColumns(sequence_key(SEQUENCE)).join(found, SEQUENCE, "left").drop(*SEQUENCE)


def _renamed(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumnsRenamed(dict(zip(KEY, names)))


def classify(seqs: DataFrame, model: Model, out: str = "predicted") -> DataFrame:
    found = _renamed(model.accepted, SEQUENCE).withColumn(out, F.lit(True))
    return _by_key(seqs, found).withColumn(out, F.coalesce(out, F.lit(False)))


def final_state(seqs: DataFrame, model: Model, out: str = "state_id") -> DataFrame:
    """State after the whole sequence; null if it is unknown and the model has no sink."""
    ends = _renamed(model.prefix_state, SEQUENCE).withColumnRenamed("state_id", out)
    return _by_key(seqs, ends).withColumn(out, model.or_sink(F.col(out)))


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(key, symbols) once per sequence, written."""
    found = seqs.select("symbols", *[c.alias(n) for n, c in sequence_key(SEQUENCE).items()])
    return written(found.where("symbols is not null").dropDuplicates(SEQUENCE), "distinct-sequences")


def walked_keys(seqs: DataFrame, model: Model, ahead: int = 0, limit: int | None = None) -> DataFrame:
    """Per distinct sequence the keys of two walks, and ``first_unknown`` (0-based).

    ``depth, ka, kb``: its known symbols alone, put after ``ahead`` others; ``head_*``: its symbols before the first
    unknown one. Places among the known symbols and the flag "an unknown one came before" are running values.
    """
    sequences = distinct_sequences(seqs)
    longest = sequences.agg(F.max(F.size("symbols"))).first()[0] or 0
    items = sequences.select(*SEQUENCE, F.posexplode("symbols").alias("i", "symbol"))
    alphabet = model.alphabet.withColumn("known", F.lit(1))
    marked = items.join(alphabet, "symbol", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    unknown = F.when((F.col("known") == 0) & F.col("symbol").isNotNull(), 1).otherwise(0)
    rows = ordered(marked.withColumn("unknown", unknown), SEQUENCE, ["i"], limit, largest=longest)
    rows = rows.running_sum(F.col("known"), "nth").running_sum(F.col("unknown"), "missed").rows()
    digest = lambda chosen, place, seed: F.coalesce(
        F.bit_xor(F.when(chosen, letter_hash(place, F.col("symbol"), seed))), F.lit(0).cast("long")
    )
    kept, head = F.col("known") == 1, F.col("missed") == 0
    found = rows.groupBy(*SEQUENCE).agg(
        F.count_if(kept).cast("int").alias("depth"),
        *[digest(kept, F.col("nth") + ahead, seed).alias(name) for seed, name in ((1, "ka"), (2, "kb"))],
        F.count_if(head).cast("int").alias("head_depth"),
        *[digest(head, F.col("i") + 1, seed).alias(name) for seed, name in ((1, "head_a"), (2, "head_b"))],
        F.min(F.when(F.col("unknown") == 1, F.col("i"))).alias("first_unknown"),
    )
    filled = sequences.select(*SEQUENCE).join(found, SEQUENCE, "left")  # empty sequences have no items
    numbers = [c for c in found.columns if c not in (*SEQUENCE, "first_unknown")]
    return filled.select(*SEQUENCE, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], "first_unknown")


def _ended(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``state_id`` and ``accepting`` of the node with this key, or of the sink."""
    ends = _renamed(model.prefix_state, keys)
    rows = rows.join(ends, keys, "left").withColumn("state_id", model.or_sink(F.col("state_id")))
    rows = rows.join(model.states.select("state_id", "accepting"), "state_id", "left")
    return rows.withColumn("accepting", F.coalesce("accepting", F.lit(False)))


def classify_stay(seqs: DataFrame, model: Model, start: str | None = None) -> DataFrame:
    """``final_state`` and ``verdict`` when unknown symbols are passed over.

    ``start`` names another first state: walking on from it equals walking from the root with its
    smallest prefix put in front, since merged prefixes have the same continuations.
    """
    first = model.state(start) if start is not None else None
    lost = first is not None and first["is_sink"]
    ahead = 0 if first is None or lost else first["rep_depth"]
    states = walked_keys(seqs, model, ahead)
    if ahead:
        states = states.withColumns({
            "depth": F.col("depth") + ahead,
            "ka": F.col("ka").bitwiseXOR(F.lit(first["rep_ka"])), "kb": F.col("kb").bitwiseXOR(F.lit(first["rep_kb"])),
        })
    if lost:
        states = states.withColumns({"state_id": F.lit(first["state_id"]), "accepting": F.lit(first["accepting"])})
    else:
        states = _ended(states, model, KEY)
    states = states.select(
        *SEQUENCE, state_name(F.col("state_id")).alias("final_state"),
        verdict(F.col("accepting")).alias("verdict"),
    )
    joined = _by_key(seqs, written(states, "verdicts", lookup=True))
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit(NEGATIVE)))


def classify_reason(seqs: DataFrame, model: Model) -> DataFrame:
    """``accepted`` and ``reason``: the walk fails at the first symbol without a transition."""
    states = _ended(walked_keys(seqs, model), model, ["head_depth", "head_a", "head_b"])
    states = states.select(*SEQUENCE, "first_unknown", "accepting", state_name(F.col("state_id")).alias("__name"))
    joined = _by_key(seqs, written(states, "verdicts", lookup=True))
    stop, name = F.col("first_unknown"), F.col("__name")
    failed = F.format_string(NO_TRANSITION, F.get("symbols", stop), name, stop)
    accepted = stop.isNull() & F.coalesce("accepting", F.lit(False))
    reason = (
        F.when(F.col("symbols").isNull(), F.lit(NO_SEQUENCE)).when(stop.isNotNull(), failed)
        .when(accepted, F.lit(ACCEPTED)).otherwise(F.format_string(NOT_ACCEPTING, name))
    )
    return joined.withColumns({"accepted": accepted, "reason": reason}).drop("first_unknown", "accepting", "__name")


def _with_states(edges: DataFrame, model: Model) -> DataFrame:
    """``edges`` of nodes and their parents with ``current_state`` and ``next_state`` ('sink' rule)."""
    child = model.prefix_state.withColumnRenamed("state_id", "__next")
    parent = model.prefix_state.toDF("__depth", "pa", "pb", "__current")
    named = lambda column: state_name(model.or_sink(F.col(column)))
    rows = edges.withColumn("__depth", F.col("depth") - 1).join(child, KEY, "left").join(parent, ["__depth", "pa", "pb"], "left")
    return rows.withColumns({"current_state": named("__current"), "next_state": named("__next")}).drop("__depth", "__current", "__next")


def state_trace(seqs: DataFrame, model: Model) -> DataFrame:
    """One row per symbol: (id, step, current_state, symbol, next_state)."""
    edges = prefix_rows(distinct_sequences(seqs), SEQUENCE).filter(F.col("depth") > 0)
    steps = _with_states(edges, model).select(
        *SEQUENCE, (F.col("depth") - 1).alias("step"), "current_state", "symbol", "next_state"
    )
    ids = seqs.select("id", *[c.alias(n) for n, c in sequence_key(SEQUENCE).items()])
    return ids.join(written(steps, "steps"), SEQUENCE).drop(*SEQUENCE)


def rule_usage(votes: DataFrame, model: Model) -> DataFrame:
    """How often each transition fires over a whole table, and how often for positive sequences.

    An edge fires once for every example below its node, so its uses are the votes of the subtree: one sum per node.
    """
    votes = written(votes.withColumns(sequence_key(SEQUENCE)), "votes")
    below = prefix_rows(votes, SEQUENCE).filter(F.col("depth") > 0).groupBy(*KEY, "symbol", "pa", "pb").agg(
        F.sum(F.col("pos") + F.col("neg")).alias("uses"), F.sum("pos").alias("positive_uses")
    )
    return _with_states(below, model).groupBy("current_state", "symbol", "next_state").agg(
        F.sum("uses").alias("uses"), F.sum("positive_uses").alias("positive_uses")
    )
