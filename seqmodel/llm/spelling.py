"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmodel.llm.ragged import mix, slices
from seqmodel.sources.scratch import written

# Fixed value: a run of letters after A-Z are lower-cased, in Latin-1, where every other character becomes '?'.
_RUN = re.compile(rb"[a-z\xc0-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
#: Different words that a task counts before it hands their counts on.
KEPT = 400_000
#: Words of this length or more share a shard.
LONGEST_SHARD = 64
#: A block is one cache line of eight 64-bit words; a key sets this many bits in it.
BLOCK_WORDS, KEY_BITS = 8, 6
#: Words whose edits one task probes: about a second of work.
WORDS_PER_TASK = 25_000
#: Edits probed at once, and letters of words hashed at once.
PROBED, HASHED = 1 << 21, 1 << 22


@dataclass(frozen=True)
class Variants:
    """``dropped``: of a run whose crc32 after ``<id>:`` is divisible by this one code point is left out; 0: of none.

    ``filter_bytes`` bounds what is broadcast at once; a larger vocabulary is probed in several passes. ``ratio``: the
    form of a word is at least so many times as frequent.
    """

    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    dropped: int = 0
    bits_per_word: int = 16
    filter_bytes: int = 64 << 20


def word_counts(df: DataFrame, how: Variants, id_col: str, text_col: str) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough, counted over all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def handed_on() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({
                "word": pa.array([w.decode("latin-1") for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64()),
            })
            counts.clear()
            return made

        for whole in batches:
            for batch in slices(whole, "text"):
                for no, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    found = Counter(_RUN.findall((text or "").encode("latin-1", "replace").translate(_LOWER)))
                    ahead = zlib.crc32(f"{'' if no is None else no}:".encode())
                    for word, n in found.items():
                        if how.dropped:
                            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), ahead)
                            if h % how.dropped == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        if len(word) >= how.least_length:
                            counts[word] += n
                if len(counts) > KEPT:
                    yield handed_on()
        yield handed_on()

    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= how.least_count)


def _letter_hash(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return mix((place.astype(_U) * _U(256) + letter.astype(_U) + _U(1)) * _ODD)


def word_keys(codes: np.ndarray) -> np.ndarray:
    """Keys of words of one length, given as a matrix of Latin-1 codes: a sum over (place, letter), then mixed."""
    return mix(_letter_hash(np.arange(codes.shape[1])[None, :], codes).sum(1, dtype=_U))


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, matrix of codes) of words of equal length, in bounded pieces."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        step = max(1, HASHED // max(length, 1))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            codes = np.frombuffer(b"".join([words[j] for j in part.tolist()]), np.uint8)
            yield part, codes.reshape(len(part), length)


@dataclass(frozen=True)
class Shards:
    """Blocks of the filters of all lengths, numbered one after the other."""

    first: np.ndarray
    blocks: np.ndarray

    @classmethod
    def of(cls, words_per_length: dict[int, int], bits_per_word: int) -> "Shards":
        blocks = np.zeros(LONGEST_SHARD + 1, np.int64)
        for length, n in words_per_length.items():
            blocks[length] = -(-n * bits_per_word // (64 * BLOCK_WORDS))
        return cls(np.cumsum(blocks) - blocks, blocks)

    def block(self, length: int, keys: np.ndarray) -> np.ndarray:
        shard = min(length, LONGEST_SHARD)
        inside = ((keys >> _U(32)) * _U(int(self.blocks[shard]))) >> _U(32)
        return inside.astype(np.int64) + self.first[shard]

    def held(self, length: int) -> tuple[int, int]:
        shard = min(length, LONGEST_SHARD)
        return int(self.first[shard]), int(self.first[shard] + self.blocks[shard])


def _nth_bit(spread: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the block, bit in it) of the k-th bit of each key."""
    nine = (spread >> _U(9 * k)) & _U(511)
    return (nine >> _U(6)).astype(np.int64), _U(1) << (nine & _U(63))


def filter_blocks(vocabulary: DataFrame, shards: Shards) -> DataFrame:
    """``(block, w0 ... w7)``: the blocks that have a bit set, merged over all words."""
    names = [f"w{i}" for i in range(BLOCK_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            for at, codes in _by_length(words):
                keys = word_keys(codes)
                made = np.zeros((len(at), BLOCK_WORDS), _U)
                spread = mix(keys ^ _ODD)
                for k in range(KEY_BITS):
                    word, bit = _nth_bit(spread, k)
                    made[np.arange(len(at)), word] |= bit
                columns = [shards.block(codes.shape[1], keys), *made.view(np.int64).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["block", *names])

    rows = vocabulary.select("word").mapInArrow(run, ", ".join(f"{c} long" for c in ["block", *names]))
    return rows.groupBy("block").agg(*[F.bit_or(c).alias(c) for c in names])


@dataclass(frozen=True)
class Filter:
    """The blocks ``[low, high)`` of all filters."""

    shards: Shards
    low: int
    high: int
    words: np.ndarray

    def may_hold(self, length: int, keys: np.ndarray) -> np.ndarray:
        """Places of the keys whose word may be in the vocabulary and whose block is among these."""
        first, end = self.shards.held(length)
        if first == end or first >= self.high or end <= self.low:
            return np.zeros(0, np.int64)
        block = self.shards.block(length, keys)
        at = np.flatnonzero((block >= self.low) & (block < self.high))
        block, spread = block[at] - self.low, mix(keys[at] ^ _ODD)
        for k in range(KEY_BITS):
            word, bit = _nth_bit(spread, k)
            hit = (self.words[block, word] & bit) != 0
            at, block, spread = at[hit], block[hit], spread[hit]
        return at


def likely_edits(words: list[bytes], letters: np.ndarray, held: Filter) -> tuple[list[int], list[bytes]]:
    """(place of the word, edit) for every edit that the filters may hold.

    A word is probed with one letter left out and with one letter replaced by a larger one. So each pair of near words
    is found from one side only: an insertion is an omission seen from the longer word. Of equal letters in a row only
    the last is left out, so no edit comes twice.
    """
    whose: list[int] = []
    edits: list[bytes] = []
    for rows, codes in _by_length(words):
        count, length = codes.shape
        places = np.arange(length)
        here = _letter_hash(places[None, :], codes)
        total = here.sum(1, dtype=_U)
        # one letter left out: what follows moves up by a place
        moved = _letter_hash(np.maximum(places - 1, 0)[None, :], codes)
        after = moved[:, ::-1].cumsum(1, dtype=_U)[:, ::-1] - moved
        ahead = here.cumsum(1, dtype=_U) - here
        last = np.ones(codes.shape, bool)
        last[:, :-1] = codes[:, :-1] != codes[:, 1:]
        r, i = np.nonzero(last)
        for j in held.may_hold(length - 1, mix(ahead[r, i] + after[r, i])).tolist():
            word = words[rows[r[j]]]
            whose.append(int(rows[r[j]]))
            edits.append(word[: i[j]] + word[i[j] + 1 :])
        # one letter replaced, by larger ones only
        step = max(1, PROBED // max(len(letters), 1))
        flat_rows, flat_places = np.repeat(np.arange(count), length), np.tile(places, count)
        for s in range(0, len(flat_rows), step):
            r, i = flat_rows[s : s + step], flat_places[s : s + step]
            near, letter = np.nonzero(letters[None, :] > codes[r, i][:, None])
            r, i, letter = r[near], i[near], letters[letter]
            keys = mix(total[r] - here[r, i] + _letter_hash(i, letter))
            for j in held.may_hold(length, keys).tolist():
                word = words[rows[r[j]]]
                whose.append(int(rows[r[j]]))
                edits.append(word[: i[j]] + bytes([letter[j]]) + word[i[j] + 1 :])
    return whose, edits


def near_words(vocabulary: DataFrame, how: Variants) -> DataFrame:
    """``(a, b)``: every two words that one inserted, deleted or replaced code point tells apart, once."""
    spark = vocabulary.sparkSession
    shard = F.least(F.length("word"), F.lit(LONGEST_SHARD))
    sizes = {r["shard"]: r["n"] for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    shards = Shards.of(sizes, how.bits_per_word)
    found = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").distinct().collect()
    letters = np.array(sorted(ord(r["letter"]) for r in found), np.uint8)
    blocks = written(filter_blocks(vocabulary, shards), "filter-blocks")
    total, step = int(shards.blocks.sum()), max(1, how.filter_bytes // (8 * BLOCK_WORDS))
    pairs = None
    for low in range(0, total, step):
        high = min(low + step, total)
        table = blocks.where(F.col("block").between(low, high - 1)).toArrow()  # at most filter_bytes
        bits = np.zeros((high - low, BLOCK_WORDS), np.int64)
        at = np.asarray(table.column("block")) - low
        for i in range(BLOCK_WORDS):
            bits[at, i] = np.asarray(table.column(f"w{i}"))
        sent = spark.sparkContext.broadcast(Filter(shards, low, high, bits.view(_U)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("word")
                whose, edits = likely_edits([w.encode("latin-1") for w in column.to_pylist()], letters, sent.value)
                yield pa.RecordBatch.from_arrays(
                    [column.take(pa.array(whose, pa.int64())), pa.array([e.decode("latin-1") for e in edits], pa.string())], ["a", "b"]
                )

        dealt = vocabulary.select("word").repartition(-(-sum(sizes.values()) // WORDS_PER_TASK), "word")
        likely = dealt.mapInArrow(run, "a string, b string")
        real = written(likely.join(vocabulary.select(F.col("word").alias("b")), "b", "left_semi").select("a", "b"), "near-words")
        pairs = real if pairs is None else pairs.unionByName(real)
    if pairs is None:
        return vocabulary.sparkSession.createDataFrame([], "a string, b string")
    return pairs


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word with a form. Each round doubles the way walked, and a way is short: counts grow on it."""
    walked = written(links.select("word", F.col("form").alias("root")), "roots", lookup=True)
    while True:
        on = walked.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = walked.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        new = written(new, "roots", lookup=True)
        walked = new.select("word", "root")
        if new.where("moved").isEmpty():
            return walked


def spelling_forms(df: DataFrame, how: Variants = Variants(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the texts that is long and frequent enough.

    Words are runs of Latin-1 letters, A-Z lower-cased. A word's form is the most frequent word one edit away (ties:
    the smallest), if frequent enough by ``how.ratio``; its root is the last of the forms from form to form, itself if
    it has none. Exact: filters only save the shuffle of edits that no word has.

    Null and empty texts have no words; texts and words are taken whole, whatever their length. Repeated rows count
    each; a null id counts as an empty one. An empty table gives an empty table. Other columns are not read.
    """
    vocabulary = written(word_counts(df, how, id_col, text_col), "vocabulary")
    pairs = near_words(vocabulary, how)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = F.min(F.struct((-F.col("m")).alias("rank"), F.col("b").alias("form"))).alias("best")
    around = other.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.rank") >= how.ratio * F.col("n")
    forms = written(
        vocabulary.join(around, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.rank")).alias("form_n"),
        ), "forms",
    )
    roots = _roots(forms.where("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
