"""Vectorised words of Arrow string columns.

A batch's texts lie in one byte buffer. Words, their 64-bit hashes and the hashes of word windows come
from numpy operations over that buffer, so no Python object is made for a word. Blocks end at a byte that
belongs to no word; memory is bounded by the block, and by the longest word or document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers = np.ones(1, U)
_inverses = np.ones(1, U)

SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, _ROOT, U)]))
            _inverses = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, _INVERSE, U)]))
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes nothing in place."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a slab of documents, in order. ``doc`` counts documents within the slab."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each document's first word; one more entry than documents

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words, and which of them lie within one document."""
        return window_hashes(self.hash, self.doc, n)


def window_hashes(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    out = np.full(m, n, U)
    for k in range(n):
        out = out * U(0xD1342543DE82EF95) + hashes[k : k + m]
    return mix(out), doc[:m] == doc[n - 1 :]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slabs(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of whole documents of about ``limit`` bytes."""
    if len(column) == 0:
        return
    data, offsets = text_buffer(column)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    """Words of a slab. kind: SPACE or ALNUM, which bytes belong to words."""
    if lower:
        buf = LOWER[buf]
    inside = kind[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    if len(buf):
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    hashes, at, low = np.empty(len(start), U), 0, 0
    while at < len(start):  # blocks of whole words
        low = start[at]
        stop = max(at + 1, int(np.searchsorted(end, low + BLOCK, "right")))
        high = end[stop - 1]
        powers, inverses = _power_tables(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, U)
        np.cumsum(_BYTES[buf[low:high]] * powers[: high - low], out=sums[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        hashes[at:stop] = (sums[e] - sums[s]) * inverses[s] + (e - s).astype(U)
        at = stop
    first = np.searchsorted(start, offsets, "left")
    return Words(buf, offsets, start, end, doc, mix(hashes), first)


def per_doc(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Sums of non-negative integers (or counts of true values) by document."""
    return np.bincount(doc, weights=values, minlength=docs).astype(np.int64)


def repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (doc, value) pairs: which occur twice or more in their document, and which equal an earlier one."""
    n = len(value)
    many, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return many, later
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    many[order[1:]] |= same
    many[order[:-1]] |= same
    later[order[1:]] = same  # lexsort is stable: within equal pairs, positions ascend
    return many, later
