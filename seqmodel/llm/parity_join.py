"""N-gram Jaccard join by parity sketches: XOR-hashed bit words, pigeonhole join per size band, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmodel.llm.components import components
from seqmodel.llm.ragged import SMALL_SLICE_BYTES, map_texts, mix, shingle_sets, slices, utf8, word_hashes, words
from seqmodel.sources.scratch import discard, written

_ONE = np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Members of a bucket that are compared in one block.
BLOCK = 256
#: Words of the sketch that goes to the buckets of a set, and of the longest that pairs are sifted by. A longer set has no
#: longer sketch: more of its pairs are checked exactly.
BUCKET_WORDS = 32
MOST_WORDS = 512
#: Rounds in which members are checked against a hub before the rest is compared block by block.
HUB_ROUNDS = 4
#: Texts are sent to their sketches, and keys to their buckets, in so many parts, one after the other, so that no more of
#: them is on disk at once.
SKETCH_PARTS = 2
KEY_PARTS = 4


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``size`` words; two sets link when den * intersection >= num * union.

    ``slack`` 0: the sketch has one word more than sets may differ in, so linked sets share a word. ``slack`` 1: words
    stand in groups of four of which some group of linked sets differs in one word at most, so they share three.
    That is twice the keys of half as many more elements each, for lower thresholds.
    """

    size: int = 5
    num: int = 80
    den: int = 100
    slack: int = 1

    @cached_property
    def bands(self) -> np.ndarray:
        """Lower ends of the size bands. Linked sets lie in the same band or in neighbours."""
        lows = [1, 2]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, (lows[-1] - 1) * self.den // self.num + 1))
        return np.array(lows, np.int64)

    def most_apart(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of at most these sizes."""
        return int((a + b) * (self.den - self.num) // (self.den + self.num))

    @property
    def sampled(self) -> np.uint64:
        """Elements with hashes below this are looked up in the other sets; enough to tell nearly all loners."""
        share = min(1.0, 1.4 * (self.den - self.num) / self.den + 0.02)
        return np.uint64(min(share * 2.0**64, 2.0**64 - 2048))

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """Sketch words, or triples of them, as 64-bit join keys for the band of the set and the band below."""
        n = len(elements)
        if not n:
            return np.zeros(0, np.uint64)
        own = int(np.searchsorted(self.bands, n, side="right")) - 1
        out = []
        for band in (own, own - 1):
            if band < 0:
                continue
            apart = self.most_apart(self.bands[band + 1] - 1, self.bands[band + 2] - 1)
            groups = (apart + 2) // 2 if self.slack else apart + 1
            width = 4 if self.slack else 1
            sketch = np.zeros(groups * width, np.uint64)
            at = (elements >> np.uint64(6)) % np.uint64(groups * width)
            np.bitwise_xor.at(sketch, at.astype(np.int64), _ONE << (elements & np.uint64(63)))
            no = np.arange(len(sketch), dtype=np.uint64)
            hashed = mix(sketch ^ mix(no * _ODD + np.uint64(band))).reshape(groups, width)
            if self.slack:
                total = hashed.sum(1, dtype=np.uint64)
                hashed = total[:, None] - hashed + np.arange(4, dtype=np.uint64)[None, :] * _ODD
            out.append(mix(hashed.ravel()))
        return np.concatenate(out)


def sketch_of(elements: np.ndarray, most: int = MOST_WORDS) -> bytes:
    """Parity of the elements hashed to each of its bits; the Hamming distance of two is at most their difference.

    Between ``BUCKET_WORDS`` and ``most`` words there is a bit or more for each element. The number of words is a power of
    two, so that a long sketch folds to a short one: the XOR of its parts is the sketch that the set has in fewer words.
    """
    width = max(BUCKET_WORDS, min(most, 1 << max(0, -(-len(elements) // 64) - 1).bit_length()))
    words_ = np.zeros(width, np.uint64)
    hashed = mix(elements ^ (_ODD >> _ONE))
    np.bitwise_xor.at(words_, ((hashed >> np.uint64(6)) % np.uint64(width)).astype(np.int64), _ONE << (hashed & np.uint64(63)))
    return words_.tobytes()


def folded(sketches: np.ndarray) -> np.ndarray:
    """A matrix of sketches, all in as many words as the shortest has."""
    sizes = np.array([len(x) // 8 for x in sketches])
    width = int(sizes.min())
    out = np.empty((len(sketches), width), np.uint64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        whole = np.frombuffer(b"".join(sketches[rows]), np.uint64).reshape(len(rows), size // width, width)
        out[rows] = np.bitwise_xor.reduce(whole, axis=1)
    return out


def _digest(elements: np.ndarray) -> tuple[int, int]:
    a = mix(elements).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(elements ^ _ODD)) if len(elements) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sets(docs: DataFrame, how: Similarity) -> DataFrame:
    """(id, n, d1, d2): size and digest of each document's set."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [(len(s), *_digest(s)) for s in shingle_sets(*utf8(batch.column("text")), how.size)]
        return dict(zip(("n", "d1", "d2"), np.array(rows, np.int64).reshape(-1, 3).T, strict=True))

    return map_texts(docs, ["id"], "text", run, "id long, n long, d1 long, d2 long", SMALL_SLICE_BYTES)


def _sample(docs: DataFrame, how: Similarity) -> DataFrame:
    """(id, h): the sampled elements of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SMALL_SLICE_BYTES):
                found = [np.unique(s[s < how.sampled]) for s in _rolled(batch.column("text"), how.size)]
                ids = np.repeat(np.asarray(batch.column("id"), np.int64), [len(s) for s in found])
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_pydict({"id": ids, "h": flat.view(np.int64)})

    return docs.select("id", "text").mapInArrow(run, "id long, h long")


def _rolled(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """As ``shingle_sets``, but neither sorted nor distinct, and without texts of fewer words than a shingle."""
    flat, offsets = utf8(column)
    starts, ends, counts = words(flat, offsets)
    hashes = word_hashes(flat, starts, ends, lower=True)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _ODD + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    last = np.cumsum(counts)
    for a, b in zip(last - counts, last, strict=True):
        yield rolled[a : max(a, b - size + 1)]


def _linkable(docs: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """The rows of ``sets`` that may link with others.

    An element no other row has is in the symmetric difference with every other set. Rows whose sampled elements
    hold more such than linked sets may differ in are left out: they link with nothing, whatever the rest is.
    """
    lonely = (
        _sample(docs, how).groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
        .where("rows = 1").groupBy("id").agg(F.count("*").alias("lonely"))
    )
    ids = sets.groupBy("id").agg(F.count("*").alias("rows"))
    bound = F.expr(f"n * {how.den - how.num} div {how.den}")
    return (
        sets.join(ids, "id").join(lonely, "id", "left")
        .where((F.col("n") > 0) & ((F.col("rows") > 1) | (F.coalesce("lonely", F.lit(0)) <= bound)))
        .select("id", "n", "d1", "d2")
    )


def _sketched(docs: DataFrame, chosen: DataFrame, how: Similarity) -> DataFrame:
    """(id, n, elements, keys, short, sketch) of the chosen documents; the digest tells rows of equal id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SMALL_SLICE_BYTES):
                rows: list[tuple] = []
                found = shingle_sets(*utf8(batch.column("text")), how.size)
                for no, d1, d2, s in zip(*[batch.column(c).to_pylist() for c in ("id", "d1", "d2")], found, strict=True):
                    if _digest(s) == (d1, d2):
                        rows.append((no, len(s), s.view(np.int64), how.keys(s).view(np.int64), sketch_of(s, BUCKET_WORDS), sketch_of(s)))
                if rows:
                    no, n, s, k, short, bits = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({
                        "id": no, "n": n, "elements": list(s), "keys": list(k), "short": list(short), "sketch": list(bits),
                    })

    joined = docs.join(chosen.select("id", "d1", "d2"), "id").select("id", "d1", "d2", "text")
    return joined.mapInArrow(run, "id long, n long, elements array<bigint>, keys array<bigint>, short binary, sketch binary")


def _sifted(pairs: DataFrame, sketched: DataFrame, how: Similarity) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more bits than linked sets may. Sends sketches, no elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            total = np.asarray(batch.column("na"), np.int64) + np.asarray(batch.column("nb"), np.int64)
            for i, both in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                left, right = folded(np.array(both, object))
                apart = int(np.bitwise_count(left ^ right).sum())
                near[i] = apart * (how.den + how.num) <= total[i] * (how.den - how.num)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    left = sketched.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketched.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _checked(pairs: DataFrame, sketched: DataFrame, how: Similarity) -> DataFrame:
    """The written pairs (a, b) whose sets link; ``pairs`` is written. Only sets in some pair are sent anywhere."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired", lookup=True)
    members = sketched.select("id", "elements").join(ids, "id", "left_semi")
    left = members.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    right = members.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    common = F.size(F.array_intersect("ea", "eb"))
    union = F.size("ea") + F.size("eb") - F.col("common")
    found = (
        pairs.join(left, "a").join(right, "b").withColumn("common", common)
        .where(how.den * F.col("common") >= how.num * union).select("a", "b")
    )
    found = written(found, "links")
    discard(ids, pairs)
    return found


def _near(members: DataFrame, how: Similarity) -> DataFrame:
    """(a, b): pairs of different components in a bucket whose sketches differ in no more bits than linked sets may.

    ``members`` has (key, rows, id, comp, n, sketch), ``rows`` being the size of the bucket. Large buckets are cut into
    blocks by a hash of the id, and each pair of blocks is a group of its own of some 2 ``BLOCK`` rows; groups are
    sorted together and compared one by one, with bit counts over whole blocks.
    """
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = (
        members.withColumn("blocks", blocks).withColumn("own", own)
        .select("key", "id", "comp", "n", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "comp", "n", "sketch")
    )

    def compared(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sketch = folded(group["sketch"])
        first = group["own"] == group["x"][0]
        left = np.flatnonzero(first)
        right = left if group["x"][0] == group["y"][0] else np.flatnonzero(~first)
        out_a, out_b = [], []
        for start in range(0, len(left), 64):
            rows = left[start : start + 64]
            apart = np.zeros((len(rows), len(right)), np.int64)
            for w in range(sketch.shape[1]):
                apart += np.bitwise_count(sketch[rows, w][:, None] ^ sketch[right, w][None, :])
            total = group["n"][rows][:, None] + group["n"][right][None, :]
            near = (apart * (how.den + how.num) <= total * (how.den - how.num)) & (group["comp"][rows][:, None] != group["comp"][right][None, :])
            i, j = np.nonzero(near)
            out_a.append(group["id"][rows[i]])
            out_b.append(group["id"][right[j]])
        a, b = np.concatenate(out_a or [group["id"][:0]]), np.concatenate(out_b or [group["id"][:0]])
        return np.minimum(a, b), np.maximum(a, b)

    names = ("key", "x", "y", "own", "id", "comp", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None

        def closed(table: dict[str, np.ndarray], last: bool):
            """Compares all groups but the last, which may go on in the next batch; hands that back."""
            n = len(table["key"])
            new = np.ones(n, bool)
            new[1:] = (np.diff(table["key"]) != 0) | (np.diff(table["x"]) != 0) | (np.diff(table["y"]) != 0)
            edges = [*np.flatnonzero(new), n]
            found = []
            for s, e in zip(edges[: -1 if last else -2], edges[1:], strict=False):
                if e - s > 1:
                    found.append(compared({c: v[s:e] for c, v in table.items()}))
            left = {c: v[edges[-2] :] for c, v in table.items()}
            return found, left

        def made(found):
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            pairs = np.unique(np.stack([a, b], 1), axis=0)
            return pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

        for batch in batches:
            if not batch.num_rows:
                continue
            table = {c: np.asarray(batch.column(c), np.int64) for c in names}
            table["sketch"] = np.empty(batch.num_rows, object)
            table["sketch"][:] = batch.column("sketch").to_pylist()
            if rest is not None:
                table = {c: np.concatenate((rest[c], table[c])) for c in table}
            found, rest = closed(table, last=False)
            yield made(found)
        if rest is not None:
            yield made(closed(rest, last=True)[0])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = spread.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    return sorted_.select(*names, "sketch").mapInArrow(run, "a long, b long").distinct()


def _buckets(keys: DataFrame, part: int) -> DataFrame:
    """(key, id) of the keys of a part that more than one set has, written."""
    keys = keys.where(F.pmod("key", F.lit(KEY_PARTS)) == part)
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    return written(keys.join(shared, "key", "left_semi").distinct(), "buckets")


def _rounds(parts: list[DataFrame], sketched: DataFrame, how: Similarity) -> DataFrame:
    """(node, comp) of the sets that link with others.

    ``parts`` have (key, id) and are written. First every set is checked against one hub: of the members that lie in most
    buckets, the one it meets most often. That connects groups of copies without making their pairs, and is repeated while it
    finds links, at most ``HUB_ROUNDS`` times. In the buckets whose members are not all connected then, members of
    different components are compared by their sketches, block by block, and the near ones exactly.
    """
    buckets = reduce(DataFrame.union, parts)
    degree = buckets.groupBy("id").agg(F.count("*").alias("degree"))
    table = rest = written(buckets.join(degree, "id").select("key", "id", "degree", F.col("id").alias("comp")), "buckets")
    discard(*parts)
    links, labels = None, None
    for turn in range(HUB_ROUNDS + 1):
        hub = F.struct((-F.col("degree")).alias("d"), F.col("id").alias("hub"), F.col("comp").alias("hub_comp"))
        mixed = (
            rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows"), F.min(hub).alias("h"))
            .where("low <> high").select("key", "rows", "h.hub", "h.hub_comp")
        )
        rest = written(rest.select("key", "id", "degree", "comp").join(mixed, "key"), "buckets")
        discard(table)
        table = rest
        if turn == HUB_ROUNDS or rest.isEmpty():
            break
        met = rest.where("comp <> hub_comp").groupBy("id", "hub").agg(F.count("*").alias("times"))
        best = met.groupBy("id").agg(F.min(F.struct((-F.col("times")).alias("t"), "hub")).alias("m"))
        pairs = best.select(F.least("id", "m.hub").alias("a"), F.greatest("id", "m.hub").alias("b")).distinct()
        found = _checked(written(_sifted(pairs, sketched, how), "pairs"), sketched, how)
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        labels = components(links)
        rest = _labelled(rest, labels)
    if not rest.isEmpty():
        members = rest.join(sketched.select("id", "n", F.col("short").alias("sketch")), "id")
        near = written(_near(members, how), "near")
        found = _checked(written(_sifted(near, sketched, how), "pairs"), sketched, how)
        discard(near)
        links = found if links is None else links.union(found)
        labels = components(links)
    if labels is None:
        return buckets.sparkSession.createDataFrame([], "node long, comp long")
    return labels


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    new = labels.select(F.col("node").alias("id"), F.col("comp").alias("new"))
    return rows.drop("comp").join(new, "id", "left").withColumn("comp", F.coalesce("new", "id")).drop("new")


def linked_groups(df: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row: the smallest id it reaches over links, itself included.

    Exact for every pair: copies of one set are one set; sets that provably link with none are put aside; the rest
    meet where words of their sketches agree and are compared bit by bit, then element by element. Null texts are empty, empty
    sets link with nothing. Rows with a null id link with nothing and have a null component. Rows of equal id
    and different text are compared each; all get the smallest of their components. An empty table gives an
    empty table. Other columns are not read. Ids are integers.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = written(_sets(docs, how), "shingle-sets")
    numbered = docs.where("id is not null")
    linkable = written(_linkable(numbered, sets.where("id is not null"), how), "linkable")
    classes = written(linkable.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "classes")
    chosen = linkable.join(classes.select("d1", "d2", F.col("rep").alias("id")), ["d1", "d2", "id"], "left_semi").distinct()
    part = F.pmod(F.xxhash64("id"), F.lit(SKETCH_PARTS))
    parts = [written(_sketched(numbered.where(part == k), chosen.where(part == k), how), "sketches") for k in range(SKETCH_PARTS)]
    sketched = reduce(DataFrame.union, parts)
    keys = sketched.select(F.explode("keys").alias("key"), "id")
    groups = _rounds([_buckets(keys, k) for k in range(KEY_PARTS)], sketched, how)
    discard(*parts)
    members = linkable.join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).join(
        groups.withColumnRenamed("node", "rep"), "rep", "left"
    )
    joined = members.select("id", F.coalesce("comp", "rep").alias("comp")).groupBy("id").agg(F.min("comp").alias("comp"))
    kind = df.schema[id_col].dataType.simpleString()
    return sets.join(joined, "id", "left").select(
        F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").cast(kind).alias("component_id")
    )
