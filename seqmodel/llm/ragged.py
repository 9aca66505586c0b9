"""Batches of texts as flat byte and word arrays, for the operators that run numpy inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Texts of a batch are worked on in slices of about so many bytes, so that the arrays stay small.
SLICE_BYTES = 4 << 20
#: For work that shares nothing between the texts of a slice: its arrays, 8 bytes and more for each byte of text, set the
#: memory of a Python worker, which keeps it while it waits for its next task.
SMALL_SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces that begin less than ``most`` bytes of text apart, or of one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts in them. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, and how many words each text has."""
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    inside = ~_BLANK[flat]
    before = np.concatenate(([False], inside))[:-1]
    after = np.concatenate((inside, [False]))[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, A-Z lower-cased on demand, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = _BYTE[_LOWER[flat] if lower else flat]
    length = ends - starts
    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(-length, kind="stable")
    by_length = -length[order]
    step, live = 0, len(order)
    while live and step < 64:  # the k-th byte of every word that has one
        rows = order[:live]
        out[rows] = out[rows] * _ODD + values[starts[rows] + step]
        step += 1
        live = int(np.searchsorted(by_length, -step, side="left"))
    for row in order[:live]:  # the few words beyond 64 bytes, one by one
        rest = values[starts[row] + step : ends[row]]
        powers = np.cumprod(np.full(len(rest), _ODD, np.uint64))
        out[row] = out[row] * powers[-1] + (rest[::-1] * np.concatenate((np.ones(1, np.uint64), powers[:-1]))).sum(dtype=np.uint64)
    return mix(out ^ (length.astype(np.uint64) * _ODD))


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of ``size`` words.

    A-Z are lower-cased. With fewer words the whole sequence is the one shingle; without words there is none.
    """
    starts, ends, counts = words(flat, offsets)
    hashes = word_hashes(flat, starts, ends, lower=True)
    last = np.cumsum(counts)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _ODD + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    for a, b in zip(last - counts, last, strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                whole = whole * _ODD + h
            yield mix(whole ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def map_texts(df: DataFrame, keep: list[str], text: str, fn: Callable, schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """``fn(batch) -> dict of columns`` over slices of ``keep`` and ``text``; ``keep`` comes first in ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, most):
                made = fn(batch)
                columns = {c: batch.column(c) for c in keep} | made
                yield pa.RecordBatch.from_pydict(columns)

    return df.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])]).mapInArrow(run, schema)
