"""Prefix tree as tables: votes per distinct sequence, nodes, edges.

Votes come first: all later steps work on distinct sequences, so copies cost one partial aggregate. A prefix is known
by its length and a digest, the XOR of a 128-bit hash of each (place, symbol); along a sequence that is a running
value, so a sequence of n symbols gives n + 1 rows of fixed size, however long it is. Places counted from the end give
the digest of what follows in the same way. A node also carries the digest of its accepted continuations (how many,
and two XORs of 64-bit hashes): two nodes with equal digests accept the same suffixes. All of it aggregates partially.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.operators.ordered import numbered, ordered
from seqmodel.sources.scratch import written

RESIDUAL = ["res_n", "res_a", "res_b"]
#: A node: its depth and the digest of its prefix. A whole sequence has the key of the node it ends in.
KEY = ["depth", "ka", "kb"]
#: The key of a sequence next to the keys of its prefixes.
SEQUENCE = ["sequence_depth", "sequence_a", "sequence_b"]
_FRONT, _BACK = (1, 2), (3, 4)


def terminal_votes(seqs: DataFrame) -> DataFrame:
    """Positive and negative examples per distinct sequence."""
    return seqs.groupBy("symbols").agg(
        F.count_if(F.col("label")).alias("pos"), F.count_if(~F.col("label")).alias("neg")
    )


def majority(votes: DataFrame) -> DataFrame:
    """Accepting iff strictly more positive than negative examples."""
    return votes.withColumn("accepting", F.col("pos") > F.col("neg"))


def letter_hash(place: Column, symbol: Column, seed: int) -> Column:
    # a hash skips nulls, so a null symbol is told from its absence by a mark before the others
    marked = F.coalesce(F.concat(F.lit("="), symbol), F.lit(""))
    return F.xxhash64(F.lit(seed), place.cast("long"), marked)


def _folded(symbols: Column, place, seed: int) -> Column:
    hashes = F.transform(symbols, lambda s, i: letter_hash(place(i), s, seed))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(h))


def sequence_key(names: list[str] = KEY, symbols: str = "symbols") -> dict[str, Column]:
    """The key of a whole sequence, computed in its row; null for a null sequence."""
    column = F.col(symbols)
    digests = [_folded(column, lambda i: i + 1, seed) for seed in _FRONT]
    return dict(zip(names, [F.size(column), *digests]))


def ranked_votes(votes: DataFrame) -> DataFrame:
    """Written ``votes`` with ``rank`` along the order of the sequences, written.

    The sequences through a node are neighbours in that order, so nodes of one depth are ordered like the smallest
    rank through them, and no prefix has to be compared.
    """
    return written(numbered(votes, ["symbols"], "rank", largest=votes.count()), "ranked")


def prefix_rows(seqs: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """One row per prefix of each sequence, the empty one included, with ``seqs``' other columns.

    ``depth, ka, kb`` is the prefix, ``symbol, pa, pb`` its last symbol and the digest of its parent, ``n`` the length of
    the whole sequence, ``rest_a, rest_b`` the digest of what follows. ``by`` tells sequences apart.
    """
    longest = seqs.agg(F.max(F.size("symbols"))).first()[0] or 0
    kept = [c for c in seqs.columns if c != "symbols"]
    size, symbols = F.size("symbols"), F.col("symbols")
    # a running value from the end is the whole minus the running value from the front
    whole = [_folded(symbols, lambda i: size - i - 1, seed).alias(f"__whole{seed}") for seed in _BACK]
    places = F.concat(F.array(F.lit(None).cast("string")), symbols)
    # below the generator, so once per sequence; above it they would be computed for every prefix
    seqs = seqs.select(*kept, "symbols", size.alias("n"), *whole)
    rows = seqs.select(*[c for c in seqs.columns if c != "symbols"], F.posexplode(places).alias("depth", "symbol"))
    depth, symbol = F.col("depth"), F.col("symbol")
    own = lambda place, seed: F.when(depth > 0, letter_hash(place, symbol, seed)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns(
        {f"__own{seed}": own(depth, seed) for seed in _FRONT} | {f"__own{seed}": own(F.col("n") - depth, seed) for seed in _BACK}
    )
    run = ordered(rows, by, ["depth"], limit, largest=longest + 1)
    for seed in (*_FRONT, *_BACK):
        run = run.running_xor(F.col(f"__own{seed}"), f"__run{seed}")
    parent = lambda seed: F.col(f"__run{seed}").bitwiseXOR(F.col(f"__own{seed}"))
    rest = lambda seed: F.col(f"__whole{seed}").bitwiseXOR(F.col(f"__run{seed}"))
    return run.rows().select(
        *kept, "n", "depth", "symbol", F.col("__run1").alias("ka"), F.col("__run2").alias("kb"),
        parent(1).alias("pa"), parent(2).alias("pb"), rest(3).alias("rest_a"), rest(4).alias("rest_b"),
    )


def prefix_nodes(ranked: DataFrame) -> DataFrame:
    """(key, symbol, parent's digest, pos, neg, residual digest, first) of ``ranked_votes``; the root always exists.

    ``first`` is the smallest rank of a sequence through the node.
    """
    root = ranked.sparkSession.range(1).select(
        F.array().cast("array<string>").alias("symbols"), F.lit(0).cast("long").alias("pos"),
        F.lit(0).cast("long").alias("neg"), F.lit(None).cast("long").alias("rank"),
    )
    rows = prefix_rows(majority(ranked.select("symbols", "pos", "neg", "rank").unionByName(root)), ["rank"])
    ends = F.col("depth") == F.col("n")
    hashed = lambda seed: F.when(
        F.col("accepting"), F.xxhash64(F.lit(seed), F.col("n") - F.col("depth"), "rest_a", "rest_b")
    )
    rows = rows.withColumns({"a": hashed(1), "b": hashed(2)})
    return rows.groupBy(*KEY, "symbol", "pa", "pb").agg(
        F.sum(F.when(ends, F.col("pos")).otherwise(0)).alias("pos"),
        F.sum(F.when(ends, F.col("neg")).otherwise(0)).alias("neg"),
        F.count("a").alias("res_n"),
        F.coalesce(F.bit_xor("a"), F.lit(0)).alias("res_a"),
        F.coalesce(F.bit_xor("b"), F.lit(0)).alias("res_b"),
        F.min("rank").alias("first"),
    )


def prefix_edges(nodes: DataFrame) -> DataFrame:
    """(parent's key, symbol, child's key), a projection of the nodes."""
    return nodes.filter(F.col("depth") > 0).select(
        (F.col("depth") - 1).alias("parent_depth"), F.col("pa").alias("parent_a"), F.col("pb").alias("parent_b"),
        "symbol", *KEY,
    )


def with_prefix(rows: DataFrame, ranked: DataFrame, depth: str = "depth", first: str = "first",
                out: str = "prefix") -> DataFrame:
    """``rows`` with the symbols of their prefix: output of the square of a sequence's length, for display only."""
    known = ranked.select(F.col("rank").alias(first), F.col("symbols").alias("__symbols"))
    text = F.when(F.col(depth) == 0, F.array().cast("array<string>")).otherwise(F.slice("__symbols", F.lit(1), F.col(depth)))
    return rows.join(known, first, "left").withColumn(out, text).drop("__symbols")
