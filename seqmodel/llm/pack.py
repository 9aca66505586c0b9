"""Packing tokenised documents into windows by non-negative least squares over the histogram of piece lengths."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqmodel.llm.ragged import _BYTE, _ODD, mix, slices, utf8
from seqmodel.llm.token_count import _NOT_PLAIN, _PLAIN, BytePairs
from seqmodel.sources.scratch import written

#: Ids of so many different pre-tokens are remembered between batches of a task, then forgotten.
REMEMBERED = 400_000
#: Pieces that are widened and placed at once: 16 MB of ids at most in windows of 2048.
PLACED_ROWS = 2_000
#: Texts of at most so many bytes are cut and looked up in blocks of about as many, as arrays; longer ones one by one.
BLOCK_BYTES = 1 << 19
_WIDTH = 4
# Pre-tokens of more bytes are told apart by a cryptographic hash, shorter ones by a polynomial of their bytes.
_LONG = 64
_LETTER, _DIGIT, _SIGN, _SPACE = range(4)
# Classes of the bytes of plain texts, in which every byte above 127 is part of a letter, and bytes that are in no plain text.
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 13, 32]] = _SPACE
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[*range(32), 127, 0xC0, 0xC1, 0xC2, *range(0xCB, 256)]] = True
_ODD_BYTE[[9, 10, 13]] = False
# Above any rank within a length, so that (length, rank) fits one number.
_RANKS = 1 << 48


@dataclass(frozen=True)
class Packing:
    """Windows of ``size`` ids, a power of two; ``end_id`` follows every document.

    ``partners``: how many of the most frequent lengths are tried as the second length of a combination of three.
    """

    size: int = 2048
    end_id: int = 1
    partners: int = 4
    rounds: int = 200


def plain_rows(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts have only printable ASCII, tabs, line ends and letters U+00C0-U+02AF, as the pattern of plain texts expects."""
    odd = _ODD_BYTE[flat]
    high = np.flatnonzero(flat[:-1] >= 0xC3)
    lead, follow = flat[high], flat[high + 1]
    odd[high[((lead == 0xC3) & ((follow == 0x97) | (follow == 0xB7))) | ((lead == 0xCA) & (follow >= 0xB0))]] = True
    return ~_hit(np.flatnonzero(odd), at)


def _hit(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold one of these bytes."""
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at, places, side="right") - 1] = True
    return out


def pretokens(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of plain texts, as the vocabulary's pattern cuts them.

    A run of blanks before something else gives its last character away: a space goes with what follows, another blank
    stands alone. Letters, digits and other signs are cut where they meet. A contraction counts where its apostrophe begins a
    pre-token.
    """
    n = len(flat)
    kind = _CLASS[flat]
    first = np.zeros(n + 3, bool)  # of a text; what follows the last text counts as one
    first[at] = True
    blank = kind == _SPACE
    begins = first[:n].copy()
    begins[1:] |= (kind[1:] != kind[:-1]) & (flat[:-1] != 32)
    # after a space: only blanks begin nothing, and what follows goes with the space
    last = blank.copy()
    last[:-1] &= ~blank[1:]
    last &= ~first[1 : n + 1]
    begins |= last
    begins[1:] |= blank[1:] & ~blank[:-1]
    quote = np.flatnonzero((flat == 39) & begins)
    padded = np.concatenate((flat, np.zeros(3, np.uint8)))
    one, two = padded[quote + 1], padded[quote + 2]
    same, longer = ~first[quote + 1], ~first[quote + 1] & ~first[quote + 2]
    short = same & ((one == 115) | (one == 116) | (one == 109) | (one == 100))
    long = longer & (((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)))
    for hits, size in ((quote[short], 2), (quote[long], 3)):
        begins[hits + 1] = False
        after = hits + size
        begins[after[after < n]] = True
    return np.flatnonzero(begins)


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * BLOCK_BYTES, base, np.uint64))))


class TokenIds(BytePairs):
    """Ids of whole texts as the library gives them, by merging each different pre-token once."""

    def __init__(self, path: str):
        super().__init__(path)
        spec = self.spec
        self.kind = np.dtype("<u2" if self.width <= 1 << 16 else "<u4")
        self.fixed = {t["content"]: np.array([t["id"]], self.kind).tobytes() for t in spec.get("added_tokens", [])}
        self.ids: dict[str, bytes] = dict(self.fixed)
        self.special_bytes = re.compile(b"|".join(re.escape(c.encode()) for c in self.fixed)) if self.fixed else None
        self.up, self.down = _powers(int(_ODD)), _powers(pow(int(_ODD), -1, 1 << 64))
        self._forget()

    def _forget(self) -> None:
        """Empties the table of pre-tokens of plain texts: sorted hashes with their places, place to the ids' first and number, ids."""
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.sizes, self.table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _surviving(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all byte strings end to end, number of ids of each)."""
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = self.merged_lengths(tokens, ends)
        owner, symbols = (np.concatenate(x) for x in zip(*ends, strict=True))
        return symbols[np.argsort(owner, kind="stable")].astype(self.kind), sizes

    def _merged(self, tokens: list[str]) -> list[bytes]:
        ids, sizes = self._surviving([t.encode() for t in tokens])
        flat = ids.tobytes()
        at = np.concatenate(([0], np.cumsum(sizes))) * self.kind.itemsize
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, in 16 bits where the vocabulary allows. A special string inside a text is its own id."""
        parts = []
        for text in texts:
            text = text or ""
            find = (self.pattern if _NOT_PLAIN.search(text) else _PLAIN).findall
            at, found = 0, []
            for special in self.special.finditer(text) if self.special else ():
                found += find(text[at : special.start()])
                found.append(special.group())
                at = special.end()
            parts.append(found + find(text[at:]) if at else find(text))
        new = list({t for found in parts for t in found}.difference(self.ids))
        if new:
            if len(self.ids) + len(new) > REMEMBERED:
                self.ids = dict(self.fixed)
                new = list({t for found in parts for t in found}.difference(self.ids))
            self.ids.update(zip(new, self._merged(new), strict=True))
        get = self.ids.__getitem__
        return [b"".join(map(get, found)) for found in parts]

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the remembered ones of sorted ``hashes``, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.places[at], -1)

    def _of_plain(self, flat: np.ndarray, at: np.ndarray) -> list[bytes]:
        """As ``of``, for a block of plain texts without special strings."""
        if not len(flat):
            return [b""] * (len(at) - 1)
        starts = pretokens(flat, at)
        ends = np.concatenate((starts[1:], [len(flat)]))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[flat] * self.up[: len(flat)])))
        size = ends - starts
        hashed = mix((sums[ends] - sums[starts]) * self.down[starts] ^ (size.astype(np.uint64) << np.uint64(40)))
        raw = flat.tobytes()
        for i in np.flatnonzero(size > _LONG).tolist():
            hashed[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
        distinct, seen, which = np.unique(hashed, return_index=True, return_inverse=True)
        place = self._known(distinct)
        if (place < 0).any() and len(self.hashes) + (place < 0).sum() > REMEMBERED:
            self._forget()
            place = self._known(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            at_new = seen[new]
            ids, sizes = self._surviving([raw[a:b] for a, b in zip(starts[at_new].tolist(), ends[at_new].tolist(), strict=True)])
            place[new] = np.arange(len(new)) + len(self.sizes)
            into = np.searchsorted(self.hashes, distinct[new])
            self.hashes, self.places = np.insert(self.hashes, into, distinct[new]), np.insert(self.places, into, place[new])
            self.first = np.concatenate((self.first, len(self.table) + np.cumsum(sizes) - sizes))
            self.sizes, self.table = np.concatenate((self.sizes, sizes)), np.concatenate((self.table, ids))
        place = place[which]
        many = self.sizes[place]
        until = np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))
        ids = self.table[np.repeat(self.first[place] - until[:-1], many) + np.arange(until[-1])].tobytes()
        cuts = (until[np.searchsorted(starts, at)] * self.kind.itemsize).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def of_column(self, column: pa.Array) -> list[bytes]:
        """As ``of``. Plain texts are cut, looked up and put together as arrays, block by block."""
        flat, at = utf8(column)
        sizes = np.diff(at)
        easy = plain_rows(flat, at) & (sizes <= BLOCK_BYTES)
        if self.special_bytes:
            easy &= ~_hit(np.array([m.start() for m in self.special_bytes.finditer(flat.tobytes())], np.int64), at)
        out: list[bytes] = [b""] * len(sizes)
        rest = np.flatnonzero(~easy)
        if len(rest):
            for i, ids in zip(rest.tolist(), self.of(column.take(pa.array(rest)).to_pylist()), strict=True):
                out[i] = ids
        rows = np.flatnonzero(easy)
        flat, at = (flat, at) if not len(rest) else utf8(column.take(pa.array(rows)))
        group = (at[1:] - 1) // BLOCK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(rows)] if len(rows) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            found = self._of_plain(flat[at[a] : at[b]], at[a : b + 1] - at[a])
            for i, ids in zip(rows[a:b].tolist(), found, strict=True):
                out[i] = ids
        return out


_LOADED: dict[str, TokenIds] = {}


def _token_ids(path: str) -> TokenIds:
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]


def pieces(df: DataFrame, path: str, how: Packing, id_col: str, text_col: str) -> DataFrame:
    """``(id, start, length, doc_tokens, part, nth, ids)``: full windows of each document and what is left of it.

    ``nth`` counts the pieces of one length within one task's part, so that ranks need no sort. ``ids`` take 16 bits each
    where the vocabulary allows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "doc_tokens", "part", "nth", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0] * (how.size + 1)
        part, known = TaskContext.get().partitionId(), _token_ids(path)
        width = known.kind.itemsize
        end = np.array([how.end_id], known.kind).tobytes()
        for batch in batches:
            for rows in slices(batch, text_col):
                whose, starts, lengths, totals, nth, found = [], [], [], [], [], []
                for i, ids in enumerate(known.of_column(rows.column(text_col))):
                    ids += end
                    for at in range(0, len(ids), how.size * width):
                        piece = ids[at : at + how.size * width]
                        n = len(piece) // width
                        whose.append(i)
                        starts.append(at // width)
                        lengths.append(n)
                        totals.append(len(ids) // width)
                        nth.append(seen[n])
                        found.append(piece)
                        seen[n] += 1
                columns = [rows.column(id_col).take(pa.array(whose, pa.int64())), *[pa.array(c, pa.int64()) for c in (starts, lengths, totals)]]
                columns += [pa.array([part] * len(whose), pa.int64()), pa.array(nth, pa.int64()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, start long, length long, doc_tokens long, part long, nth long, ids binary"
    return df.select(*{c: F.col(f"`{c}`") for c in (id_col, text_col)}.values()).mapInArrow(run, schema)


def combinations(counts: np.ndarray, how: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Lengths (m x 3) and repeats (m x 3) of combinations that fill a window exactly.

    Every present length leads, repeated as often as fits; the rest of the window is one present length, or one of the
    most frequent ones, repeated, and one more.
    """
    size = how.size
    present = np.zeros(size + 1, bool)
    present[1:size] = counts[1:size] > 0
    lengths = np.flatnonzero(present)
    frequent = lengths[np.argsort(-counts[lengths], kind="stable")][: how.partners]
    rows: list[np.ndarray] = []

    def add(a, m, b, k, c, j):
        rows.append(np.stack(np.broadcast_arrays(a, b, c, m, k, j), 1))

    for a in lengths.tolist():
        most = np.arange(1, min(size // a, int(counts[a])) + 1)
        rest = size - a * most
        add(a, most[rest == 0], 0, 0, 0, 0)
        single = present[rest] & (rest != a)
        add(a, most[single], rest[single], 1, 0, 0)
        for b in frequent.tolist():
            if b == a:
                continue
            times = np.arange(1, min(size // b, int(counts[b])) + 1)
            left = rest[:, None] - b * times[None, :]
            ok = (left > 0) & present[np.clip(left, 0, size)] & (left != a) & (left != b)
            i, j = np.nonzero(ok)
            add(a, most[i], b, times[j], left[i, j], 1)
    table = np.unique(np.concatenate([r for r in rows if len(r)] or [np.zeros((0, 6), np.int64)]).astype(np.int64), axis=0)
    return table[:, :3], table[:, 3:]


def repeats(lengths: np.ndarray, times: np.ndarray, counts: np.ndarray, how: Packing) -> np.ndarray:
    """How often each combination is wanted: least squares of the used lengths against ``counts``, none negative.

    Accelerated projected gradient steps on columns scaled to unit length.
    """
    goal = counts.astype(float).copy()
    goal[[0, how.size]] = 0.0
    norm = np.sqrt((times.astype(float) ** 2).sum(1))
    share = times / norm[:, None]
    flat = lengths.ravel()
    used = lambda y: np.bincount(flat, (share * y[:, None]).ravel(), how.size + 1)
    columns = [(np.ascontiguousarray(share[:, k]), np.ascontiguousarray(lengths[:, k])) for k in range(lengths.shape[1])]
    back = lambda r: sum(a * r.take(n) for a, n in columns)
    probe = np.ones(len(lengths))
    for _ in range(20):
        probe = back(used(probe))
        probe /= np.linalg.norm(probe)
    step = 1.0 / (1.05 * np.linalg.norm(back(used(probe))))
    x = ahead = np.zeros(len(lengths))
    pace = 1.0
    for _ in range(how.rounds):
        new = np.maximum(ahead - step * back(used(ahead) - goal), 0.0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, x, pace = new + (pace - 1) / faster * (new - x), new, faster
    return x / norm


@dataclass(frozen=True)
class Plan:
    """Where the ``rank``-th piece of a length goes; arrays of a size that the window bounds, whatever the corpus.

    A slot is a run of ranks of one length: ``first`` rank, ``times`` pieces in each of its sequences from ``sequence``
    on, at ``offset``. Pieces of a rank from ``placed`` on are laid end to end, the longest first, and cut where a
    window is full; what does not fill the last window goes into shorter sequences, of powers of two.
    """

    how: Packing
    counts: np.ndarray
    slots: np.ndarray  # length, first rank, times, sequence, offset; sorted by length and rank
    placed: np.ndarray
    sequences: int

    @classmethod
    def of(cls, counts: np.ndarray, how: Packing) -> "Plan":
        size = how.size
        lengths, times = combinations(counts, how)
        left = counts.astype(np.int64).copy()
        next_rank = np.zeros(size + 1, np.int64)
        sequence = int(counts[size])
        slots = [(size, 0, 1, 0, 0)] if sequence else []
        if len(lengths):
            wanted = repeats(lengths, times, counts, how)
            order = np.argsort(-wanted, kind="stable")
            lengths, times, wanted = lengths[order], times[order], wanted[order]
            recipe = lambda p: [(n, t) for n, t in zip(lengths[p].tolist(), times[p].tolist(), strict=True) if t]
            taken = np.zeros(len(order), np.int64)
            # rounded first, then whatever still fits
            for limit in (np.rint(wanted).astype(np.int64), np.full(len(order), 1 << 60)):
                for p in np.flatnonzero((limit > 0) & (left[lengths] >= times).all(1)).tolist():
                    n = min(int(limit[p]), *[int(left[a]) // t for a, t in recipe(p)])
                    if n > 0:
                        taken[p] += n
                        for a, t in recipe(p):
                            left[a] -= n * t
            for p in np.flatnonzero(taken).tolist():
                offset = 0
                for a, t in recipe(p):
                    slots.append((a, int(next_rank[a]), t, sequence, offset))
                    next_rank[a] += taken[p] * t
                    offset += a * t
                sequence += int(taken[p])
        next_rank[size] = counts[size]
        table = np.array(sorted(slots), np.int64).reshape(-1, 5)
        return cls(how, counts.astype(np.int64), table, next_rank, sequence)

    @cached_property
    def begins(self) -> np.ndarray:
        """Place of the first residual piece of each length among all residual ids."""
        tokens = (self.counts - self.placed) * np.arange(len(self.counts))
        return tokens[::-1].cumsum()[::-1] - tokens

    @cached_property
    def residual(self) -> int:
        return int(((self.counts - self.placed) * np.arange(len(self.counts))).sum())

    @cached_property
    def tail(self) -> tuple[np.ndarray, np.ndarray]:
        """(places where the sequences after the last full residual window begin, their end included)."""
        rest, at = self.residual % self.how.size, self.residual - self.residual % self.how.size
        lengths = [1 << k for k in reversed(range(self.how.size.bit_length())) if rest >> k & 1]
        return at + np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), np.array(lengths, np.int64)

    def placed_at(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces that are in a combination."""
        at = np.searchsorted(self.slots[:, 0] * _RANKS + self.slots[:, 1], length * _RANKS + rank, side="right") - 1
        _, first, times, sequence, offset = self.slots[at].T
        nth = rank - first
        return sequence + nth // times, offset + nth % times * length

    def cut(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the parts of a residual piece."""
        size, (edges, _) = self.how.size, self.tail
        low = int(self.begins[length] + (rank - self.placed[length]) * length)
        high, at, out = low + length, low, []
        while at < high:
            if at < edges[0]:
                begin = at // size * size
                end, sequence = begin + size, at // size
            else:
                k = int(np.searchsorted(edges, at, side="right")) - 1
                begin, end, sequence = int(edges[k]), int(edges[k + 1]), int(edges[0]) // size + k
            out.append((at - low, min(high, end) - at, self.sequences + sequence, at - begin))
            at = min(high, end)
        return out


def _widened(column: pa.Array, length: np.ndarray) -> pa.Array:
    """The ids of each piece in 32 bits."""
    data = b"".join(column.to_pylist())
    kind = np.dtype("<u4" if len(data) == length.sum() * _WIDTH else "<u2")
    flat, at = np.frombuffer(data, kind).astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(length))) * _WIDTH
    return pa.array([flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` of ``pieces`` with ``rank`` among all pieces of their length; one row per (length, part) is counted."""
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    first = written(first, "first-ranks", lookup=True)
    return rows.join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))


def packed(df: DataFrame, path: str, how: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, length, ids, doc_tokens, sequence_id, offset)``: every piece of every document and its place.

    ``path`` names a byte-level BPE vocabulary in the ``tokenizers`` JSON form that every executor can open. ``ids`` are
    the piece's ids, little-endian, 32 bits each. No sequence has padding: all are full but a few shorter ones of
    powers of two. Only residual pieces are cut, besides documents longer than a window.

    Null and empty texts are the end id alone. Texts are taken whole, whatever their length. Rows of equal or null id
    are packed each; other columns, whatever their names, are not read. An empty table gives an empty table. Which of
    two pieces of equal length goes where follows the order of the input files.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = written(pieces(df, path, how, id_col, text_col), "pieces")
    counts = np.zeros(how.size + 1, np.int64)
    for length, n in rows.groupBy("length").agg(F.count("*")).collect():  # at most one row per length
        counts[length] = n
    plan = Plan.of(counts, how)
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, PLACED_ROWS) for whole in batches for i in range(0, whole.num_rows, PLACED_ROWS)):
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            fits = rank < plan.placed[length]
            at = np.flatnonzero(fits)
            if len(at):
                whole = batch.take(pa.array(at))
                where = plan.placed_at(length[at], rank[at])
                ids = _widened(whole.column("ids"), length[at])
                yield pa.RecordBatch.from_arrays(
                    [*[whole.column(c) for c in ("id", "start", "length")], ids, whole.column("doc_tokens"), *map(pa.array, where)], names
                )
            at = np.flatnonzero(~fits)
            if len(at):
                rest = batch.take(pa.array(at))
                starts, ids = rest.column("start").to_pylist(), _widened(rest.column("ids"), length[at]).to_pylist()
                parts = [(i, *part) for i in range(len(at)) for part in plan.cut(int(length[at[i]]), int(rank[at[i]]))]
                take = pa.array([p[0] for p in parts], pa.int64())
                numbers = [pa.array(c, pa.int64()) for c in zip(*[(starts[i] + s, n, q, o) for i, s, n, q, o in parts], strict=True)]
                cut = pa.array([ids[i][s * _WIDTH : (s + n) * _WIDTH] for i, s, n, _, _ in parts], pa.binary())
                columns = [rest.column("id").take(take), *numbers[:2], cut, rest.column("doc_tokens").take(take), *numbers[2:]]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    columns = ["id", "start", "length", "doc_tokens", "ids", "rank"]
    return ranked(rows).select(*columns).mapInArrow(run, schema)
