"""Token counts of byte-level BPE by rank-synchronous array merging."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqmodel.llm.ragged import map_texts, utf8

# Fixed value: how the byte-level pre-tokenizer of the vocabulary cuts a text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same cut for texts of printable ASCII, line ends and U+00C0-U+02AF, where the standard library is faster.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
_PLAIN = re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile(rf"[^{_LETTERS}\x20-\x7e\t\n\r]")
_NONE = np.iinfo(np.int32).max
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Counts of so many different pre-tokens are remembered between batches of a task, then forgotten.
REMEMBERED = 400_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A byte-level BPE vocabulary: merge ranks in sorted arrays, special strings, pre-token pattern."""

    def __init__(self, path: str):
        spec = self.spec = json.loads(open(path, encoding="utf-8").read())
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        self.width = max(vocab.values()) + 1
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        self.slot_bits = max(16, (4 * len(pairs)).bit_length())
        self._slots = self._dealt()
        self.byte_ranks = self._rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        self.pattern = regex.compile(PRETOKEN)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def _dealt(self) -> np.ndarray:
        """A table from hashes of pairs to their number + 1, 0 where there is none; who finds a place taken goes on to the next."""
        slots = np.zeros(1 << self.slot_bits, np.int32)
        rest, at = np.arange(len(self.keys), dtype=np.int32), self._slot(self.keys)
        while len(rest):
            free = slots[at] == 0
            slots[at[free]] = rest[free] + 1
            late = slots[at] != rest + 1
            rest, at = rest[late], (at[late] + 1) & (len(slots) - 1)
        return slots

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _SPREAD >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = self._slot(key)
        found = self._slots[at]
        fits = (found > 0) & (self.keys[found - 1] == key)
        out = np.where(fits, self.ranks[found - 1], _NONE)
        rest = np.flatnonzero(~fits & (found > 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self._slots) - 1)
            found = self._slots[at[rest]]
            fits = (found > 0) & (self.keys[found - 1] == key[rest])
            out[rest[fits]] = self.ranks[found[fits] - 1]
            rest = rest[~fits & (found > 0)]
        return out

    def merged_lengths(self, tokens: list[bytes], ends: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """How many symbols survive in each byte string; ``ends`` gathers (string, symbol) arrays of the surviving ones.

        In every round each string's lowest-rank pair is merged wherever it stands, in all strings at once.
        A merge can only make pairs of higher rank, so this ends where merging one pair at a time would.
        """
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = lengths.copy()
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        ids = self.byte_ids[flat]
        owner = np.repeat(np.arange(len(tokens), dtype=np.int32), lengths)
        rank = np.full(len(ids), _NONE, np.int32)  # of the pair that starts here
        if len(ids) > 1:
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.byte_ranks[flat[:-1], flat[1:]], _NONE)
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.concatenate((starts, [len(ids)])))
            low = np.minimum.reduceat(rank, starts)
            out[owner[starts]] = size
            low = np.repeat(low, size)
            if not (low < _NONE).all():  # strings without a mergeable pair leave
                live = low < _NONE
                if ends is not None:
                    ends.append((owner[~live], ids[~live]))
                ids, owner, rank, low = ids[live], owner[live], rank[live], low[live]
                if not len(ids):
                    break
            hit = rank == low
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))  # x x x: every second pair
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate((run, [len(at)]))))
            at = at[nth % 2 == 0]
            ids[at] = self.made[rank[at]]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            moved = np.cumsum(stays) - 1
            at = moved[at]
            ids, owner, rank = ids[stays], owner[stays], rank[stays]
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(ids) - 1)
                rank[i] = np.where((j > i) & (owner[i] == owner[j]), self._rank(ids[i], ids[j]), _NONE)
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. A special string inside a text is one token."""
        special = self.special
        parts, extra = [], []
        for text in texts:
            pieces = special.split(text) if special and text else [text or ""]
            extra.append(len(pieces) - 1)
            find = (self.pattern if _NOT_PLAIN.search(text or "") else _PLAIN).findall
            found = find(pieces[0])
            for piece in pieces[1:]:
                found += find(piece)
            parts.append(found)
        known = self.known
        new = list({t for found in parts for t in found}.difference(known))
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list({t for found in parts for t in found})
            known.update(zip(new, self.merged_lengths([t.encode() for t in new]).tolist(), strict=True))
        get = known.__getitem__
        return [n + sum(map(get, found)) for n, found in zip(extra, parts, strict=True)]


_LOADED: dict[str, BytePairs] = {}


def byte_pairs(path: str) -> BytePairs:
    """The vocabulary at ``path``, read once per task."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def token_counts(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row, without a shuffle.

    ``path`` names a byte-level BPE vocabulary in the ``tokenizers`` JSON form that every executor can open.
    Null and empty texts have 0 tokens. Texts are counted whole. Equal or null ids give one row each; other
    columns, whatever their names, are not read. An empty table gives an empty table.
    """

    def counted(batch: pa.RecordBatch) -> dict:
        texts = batch.column(text_col)
        n = np.array(byte_pairs(path).count(texts.to_pylist()), np.int64)
        return {"n_bytes": np.diff(utf8(texts)[1]), "n_tokens": n, "over_limit": n > limit}

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, [id_col], text_col, counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
