"""Benchmark items inside documents: size-partitioned MinHash containment search, checked by exact containment."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.sources.scratch import written

_KEY = ["k1", "k2"]


@dataclass(frozen=True)
class Containment:
    """A document leaks an item if it has num / den of the item's shingles of ``size`` words.

    ``miss``: the chance that the MinHash search misses one such pair. ``most_hashes``: where the sizes are so far
    apart that this needs more hash functions, every common shingle makes a pair instead.
    """

    size: int = 5
    num: int = 80
    den: int = 100
    miss: float = 1e-9
    most_hashes: int = 128

    def hashes(self, item_class: int, set_class: int) -> int:
        """Hash functions for items of 2^q and sets of 2^p shingles and up: one of them agrees but for ``miss``."""
        t, n, u = self.num / self.den, 2.0**item_class, 2.0 ** (set_class + 1) - 1
        jaccard = min(1.0, t * n / (max(u, t * n) + n - t * n))
        return 1 if jaccard >= 1 else math.ceil(math.log(self.miss) / math.log1p(-jaccard))

    def plan(self) -> dict[int, dict[int, int]]:
        """Per class of sets, the hash functions for each class of items that can lie in such sets; 0: no MinHash."""
        out: dict[int, dict[int, int]] = {}
        for p in range(32):
            fit = [q for q in range(32) if 2.0 ** (p + 1) - 1 >= 2.0**q * self.num / self.den]
            out[p] = {q: b if (b := self.hashes(q, p)) <= self.most_hashes else 0 for q in fit}
        return out


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.array_remove(F.split(plain, " "), "")  # without words there is one empty piece


def _shingles(df: DataFrame, keep: list[str], text_col: str, size: int) -> DataFrame:
    """(keep..., h): a row per shingle. With fewer words the whole sequence is one; without words there is none.

    Rows without words get no places instead of being filtered, since Spark would cut the text once more for the filter.
    """
    worded = df.select(*keep, words_of(F.col(text_col)).alias("words"))
    last = F.greatest(F.size("words") - size, F.lit(0))
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), last))
    at = worded.select(*keep, "words", F.explode(places).alias("i"))
    return at.select(*keep, F.xxhash64(*[F.get(F.col("words"), F.col("i") + k) for k in range(size)]).alias("h"))


def _text_key(text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _by_class(plan: dict[int, list[int]]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in plan.items() for x in (k, v)])


def _signature(elements: Column, numbers: Column) -> Column:
    """(j, v): for hash function j the least hash of the elements."""
    return F.transform(
        numbers, lambda j: F.struct(j.alias("j"), F.array_min(F.transform(elements, lambda h: F.xxhash64(h, j))).alias("v"))
    )


def leaked_texts(
    docs: DataFrame, items: DataFrame, how: Containment = Containment(), text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(k1, k2, item, n_shared, n_item): the text keys of ``docs`` and the items they leak.

    Only shingles of some item count for containment, so documents are first reduced to those; equal texts then are
    one set. Sets and items are put in classes of size by powers of two. For each pair of classes the least
    Jaccard similarity at the containment asked for tells how many hash functions find the pair. Candidates are
    checked by exact intersection. Items of one text count each; items without words are in no document.
    """
    texts = _shingles(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")), ["item"], "t", how.size)
    whole = written(
        texts.groupBy("item").agg(F.collect_set("h").alias("item_set"))  # of one item
        .withColumn("n_item", F.size("item_set")).withColumn("q", _class(F.col("n_item"))),
        "items", lookup=True,
    )
    known = written(whole.select(F.explode("item_set").alias("h")).distinct(), "item-shingles", lookup=True)
    bounds = whole.agg(F.min("n_item").alias("low"), F.max("q").alias("q"), F.min("q").alias("q0")).first()
    if bounds["low"] is None:
        bounds = {"low": 1, "q": 0, "q0": 0}
    found = _shingles(docs.select(*_text_key(text_col), F.col(text_col).alias("t")), _KEY, "t", how.size)
    sets = (
        found.join(known, "h", "left_semi").groupBy(*_KEY).agg(F.collect_set("h").alias("set"))  # of one text
        .where(how.den * F.size("set") >= how.num * F.lit(bounds["low"])).withColumn("p", _class(F.size("set")))
    )
    sets = written(sets, "shared-shingles")

    plan = {p: {q: b for q, b in row.items() if bounds["q0"] <= q <= bounds["q"]} for p, row in how.plan().items()}
    most = {p: max(row.values(), default=0) for p, row in plan.items()}
    signed = sets.withColumn("b", F.element_at(_by_class(most), F.col("p"))).where("b > 0").select(
        *_KEY, "p", F.explode(_signature(F.col("set"), F.sequence(F.lit(0), F.col("b") - 1))).alias("s")
    ).select(*_KEY, "p", "s.j", "s.v")
    probes = [(q, p, b) for p, row in plan.items() for q, b in row.items()]
    rows = [F.struct(*[F.lit(x).cast("int").alias(c) for c, x in zip("qpb", probe, strict=True)]) for probe in probes]
    # a row per pair of classes; createDataFrame would start Python workers on the executors for these rows alone
    table = docs.sparkSession.range(1).select(F.inline(F.array(*rows)))
    asked = whole.join(F.broadcast(table), "q")
    wanted = asked.where("b > 0").select(
        "item", "p", F.explode(_signature(F.col("item_set"), F.sequence(F.lit(0), F.col("b") - 1))).alias("s")
    ).select("item", "p", "s.j", "s.v")
    wanted = written(wanted, "item-signatures", lookup=True)
    exact = written(asked.where("b = 0").select("item", "p", F.explode("item_set").alias("h")), "item-rest", lookup=True)
    pairs = signed.join(wanted, ["p", "j", "v"]).select(*_KEY, "item").union(
        sets.select(*_KEY, "p", F.explode("set").alias("h")).join(exact, ["p", "h"]).select(*_KEY, "item")
    )
    shared = F.size(F.array_intersect("set", "item_set"))
    return (
        pairs.distinct().join(sets.select(*_KEY, "set"), _KEY).join(whole.select("item", "item_set", "n_item"), "item")
        .select(*_KEY, "item", shared.cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"))
        .where(how.den * F.col("n_shared") >= how.num * F.col("n_item"))
    )


def leaks(
    docs: DataFrame, items: DataFrame, how: Containment = Containment(), id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(id, item, n_shared, n_item)`` for every row of ``docs`` and every item its whole text holds.

    Null and empty texts hold nothing; an item of fewer words than a shingle is held only by texts of the same
    words. Repeated and null ids give their rows each; null item ids are one item. Empty tables give an empty
    table. Other columns are not read.
    """
    hits = written(leaked_texts(docs, items, how, text_col, item_col, item_text_col), "leaks", lookup=True)
    keyed = docs.select(F.col(id_col), *_text_key(text_col))
    return keyed.join(hits, _KEY).select(F.col(id_col), F.col("item").alias(item_col), "n_shared", "n_item")


def without_leaks(docs: DataFrame, items: DataFrame, how: Containment = Containment(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text holds no item."""
    hits = written(leaked_texts(docs, items, how, text_col).select(*[F.col(k).alias(f"__{k}") for k in _KEY]).distinct(), "leaks", lookup=True)
    k1, k2 = _text_key(text_col)
    return docs.join(hits, (k1 == hits["__k1"]) & (k2 == hits["__k2"]), "left_anti")


def sql(how: Containment = Containment()) -> str:
    """The same by brute force in DuckDB SQL over ``documents`` and ``benchmark``."""

    def shingled(table: str, no: str) -> str:
        return f"""select distinct {no}, array_to_string(w[i:i + {how.size - 1}], ' ') as s from (
            select {no}, w, unnest(range(1, greatest(len(w) - {how.size - 1}, 1) + 1)) as i from (
            select {no}, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),
                lambda x: x <> '') as w from {table}) where len(w) > 0)"""

    return f"""
    with d as ({shingled("documents", "doc_id")}), b as ({shingled("benchmark", "item_id")}),
    n as (select item_id, count(*) as n_item from b group by item_id),
    c as (select doc_id, item_id, count(*) as n_shared from d join b using (s) group by all)
    select doc_id, item_id, n_shared, n_item from c join n using (item_id) where {how.den} * n_shared >= {how.num} * n_item"""
