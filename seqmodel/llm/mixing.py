"""Sources mixed to target weights: temperature by bisection, then budgeted permutations of blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmodel.sources.scratch import written

_LEVELS = 4
_PASSES = 8


@dataclass(frozen=True)
class Mixture:
    """``entropy``: share of the largest entropy, log of the number of sources, that the weights shall reach.
    ``repeats``: the most times any source may be read on average; it goes before the entropy.
    ``budget``: tokens to hand out, as a multiple of all tokens; None is as many as it takes to read every document
    at least once, whatever the weight of its source. ``block_tokens``: aim for the size of a block.
    """

    entropy: float = 0.98
    repeats: float = 4.0
    budget: float | None = 1.0
    block_tokens: int = 65_536
    seed: int = 7


def token_cost(text: Column) -> Column:
    """Words of the whole text; 1 for a text without words, so that every row has a price."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def source_key(source: Column) -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _bent(sources: DataFrame, exponents: list[float], total: int, how: Mixture) -> dict[float, tuple[float, float]]:
    """(entropy, most repeats) of the weights at each exponent, by one sum over the sources."""
    log = F.col("e") * F.log(F.col("tokens") / F.lit(float(total)))
    rows = (
        sources.select("tokens", F.explode(F.array(*[F.lit(e) for e in exponents])).alias("e"))
        .select("e", log.alias("l"), F.exp(log).alias("w"), "tokens")
        .groupBy("e").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("l")).alias("a"), F.max(F.col("w") / F.col("tokens")).alias("m"),
             F.max(F.col("tokens") / F.col("w")).alias("x"))
        .collect()
    )
    handed = {r["e"]: r["x"] * r["z"] if how.budget is None else how.budget * total for r in rows}
    return {r["e"]: (math.log(r["z"]) - r["a"] / r["z"], r["m"] * handed[r["e"]] / r["z"]) for r in rows}


def exponent(sources: DataFrame, how: Mixture) -> tuple[float, float, int]:
    """(exponent, sum of weights before they are normalised, all tokens) for ``sources`` (key, tokens).

    The largest exponent in [0, 1] whose weights reach the entropy; if these repeat some source too often, the
    smallest that does not. At 1 the weights are the sources' own shares: if that repeats too often, the budget
    does, and 1 is the answer. Bisected over sums in Spark, several halvings to a pass.
    """
    row = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total = int(row["t"] or 0)
    if not total:
        return 1.0, 1.0, 0
    aim = how.entropy * math.log(row["n"])

    def bisect(good) -> float:
        """The border between exponents where ``good`` holds, below, and where it doesn't."""
        low, high = 0.0, 1.0
        for _ in range(_PASSES):
            inner = [low + (high - low) * k / 2**_LEVELS for k in range(1, 2**_LEVELS)]
            seen = _bent(sources, inner, total, how)
            low, high = max([low, *[e for e in inner if good(*seen[e])]]), min([high, *[e for e in inner if not good(*seen[e])]])
        return low

    ends = _bent(sources, [0.0, 1.0], total, how)
    bent = 1.0 if ends[1.0][0] >= aim - 1e-9 else bisect(lambda h, r: h >= aim)
    if ends[1.0][1] > how.repeats:
        bent = 1.0
    elif _bent(sources, [bent], total, how)[bent][1] > how.repeats:
        bent = bisect(lambda h, r: r > how.repeats) + 2.0 ** -(_LEVELS * _PASSES)
    bent = min(1.0, round(bent, 8))
    z = sources.agg(F.sum(F.exp(bent * F.log(F.col("tokens") / F.lit(float(total)))))).first()[0]
    return bent, z, total


def _unit(x: Column) -> Column:
    """31 bits of a hash as a number from 0 below 1."""
    return F.shiftrightunsigned(x, 33) / F.lit(2.0**31)


def plan(docs: DataFrame, how: Mixture, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A row per source: tokens, weight, target, blocks, whole passes, and where the last pass stops.

    The last pass takes blocks in the order of their hash up to ``cut``, and of the block at ``cut`` the documents
    up to ``doc_cut``. Block totals are summed per 1024th of the hash range first, so no window holds more than
    1024 of these, or the blocks of one of these, or the documents of one block.
    """
    slim = docs.select(
        source_key(F.col(source_col)).alias("key"), token_cost(F.col(text_col)).alias("cost"),
        _doc_hash(F.col(id_col), F.col(text_col), how).alias("u"),
    )
    slim = written(slim, "mix-costs")
    sources = written(slim.groupBy("key").agg(F.sum("cost").alias("tokens")), "mix-sources", lookup=True)
    bent, z, total = exponent(sources, how)
    weight = F.exp(bent * F.log(F.col("tokens") / F.lit(float(max(total, 1))))) / z
    weighed = sources.withColumn("weight", weight)
    target = F.round(F.col("weight") * (how.budget * total if how.budget is not None else _whole(weighed))).cast("long")
    if how.budget is None:
        target = F.greatest(target, F.col("tokens"))
    table = written(
        weighed.withColumn("target", target)
        .withColumn("blocks", F.ceil(F.col("tokens") / how.block_tokens).cast("long"))
        .withColumn("passes", F.floor(F.col("target") / F.col("tokens")).cast("long"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("tokens")).withColumn("exponent", F.lit(bent)),
        "mix-plan", lookup=True,
    )
    placed = slim.join(table.select("key", "blocks", "passes", "rest"), "key").withColumn("block", _block(F.col("u"), F.col("blocks")))
    blocks = written(
        placed.groupBy("key", "block", "passes", "rest").agg(F.sum("cost").alias("cost"))
        .withColumn("at", _block_hash(F.col("key"), F.col("block"), F.col("passes"), how)),
        "mix-blocks",
    )
    part = F.shiftrightunsigned("at", 54)
    order = F.shiftrightunsigned("at", 1)  # unsigned order in signed numbers
    upto = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("key", part.alias("part")).agg(F.sum("cost").alias("cost"))
    parts = parts.withColumn("before", F.coalesce(F.sum("cost").over(upto), F.lit(0)))
    inside = Window.partitionBy("key", "part").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = (
        blocks.withColumns({"part": part, "order": order}).join(parts.drop("cost"), ["key", "part"])
        .where("before <= rest")
        .withColumn("start", F.col("before") + F.coalesce(F.sum("cost").over(inside), F.lit(0)))
        .where("start <= rest and rest < start + cost").select("key", "block", F.col("order").alias("cut"), (F.col("rest") - F.col("start")).alias("left"))
    )
    at_cut = written(at_cut, "mix-cuts", lookup=True)
    doc_order = _doc_order(F.col("u"), F.col("passes"))
    in_block = Window.partitionBy("key").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    ends = (
        placed.join(at_cut, ["key", "block"]).withColumn("order", doc_order).withColumn("upto", F.sum("cost").over(in_block))
        .where(F.col("upto") <= F.col("left")).groupBy("key").agg(F.max("order").alias("doc_cut"))
    )
    return written(table.join(at_cut.select("key", "cut"), "key", "left").join(ends, "key", "left"), "mix-plan", lookup=True)


def _whole(weighed: DataFrame) -> float:
    """Tokens to hand out so that each source gets all its own at least."""
    return weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0


def _doc_hash(doc: Column, text: Column, how: Mixture) -> Column:
    return F.xxhash64(F.lit(how.seed), doc, text)


def _block(u: Column, blocks: Column) -> Column:
    return F.floor(_unit(u) * blocks).cast("long")


def _block_hash(key: Column, block: Column, epoch: Column, how: Mixture) -> Column:
    return F.xxhash64(F.lit(how.seed), key, block, epoch.cast("long"))


def _doc_order(u: Column, epoch: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(u, epoch.cast("long")), 1)


def mixed(
    docs: DataFrame, how: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Rows of ``docs`` with ``epoch``, ``block_order`` and ``doc_order``: one for every time a document is read.

    Sorted by (block_order, doc_order) they are the training order: every pass over a source is a permutation of its
    blocks, blocks of all sources interleave, and the documents of a block are permuted too. A source gets its
    weight times the budget in tokens, less than one document short; without a budget no document is left out. Which rows are read is decided in the row from
    the table of sources; equal rows (same id, text and source) are read equally often. A null source is a
    source; null ids and texts are hashed like values. An empty table gives an empty table. Columns named like the
    three new ones are replaced.
    """
    table = plan(docs, how, id_col, text_col, source_col).select(
        F.col("key").alias("__key"), *[F.col(c).alias(f"__{c}") for c in ("blocks", "passes", "cut", "doc_cut")]
    )
    plain = docs.drop("epoch", "block_order", "doc_order")
    columns = plain.columns
    rows = (
        plain.withColumn("__key", source_key(F.col(source_col))).withColumn("__u", _doc_hash(F.col(id_col), F.col(text_col), how))
        .join(table, "__key").withColumn("__block", _block(F.col("__u"), F.col("__blocks")))
    )
    at = F.shiftrightunsigned(_block_hash(F.col("__key"), F.col("__block"), F.col("__passes"), how), 1)
    more = F.coalesce(
        (at < F.col("__cut")) | ((at == F.col("__cut")) & (_doc_order(F.col("__u"), F.col("__passes")) <= F.coalesce("__doc_cut", F.lit(-1)))),
        F.lit(False),
    )
    times = F.col("__passes") + F.when(more, 1).otherwise(0)
    read = rows.withColumn("__times", times).where("__times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    return read.select(
        *[F.col(f"`{c}`") for c in columns], "epoch",
        F.shiftrightunsigned(_block_hash(F.col("__key"), F.col("__block"), F.col("epoch"), how), 1).alias("block_order"),
        _doc_order(F.col("__u"), F.col("epoch")).alias("doc_order"),
    )
