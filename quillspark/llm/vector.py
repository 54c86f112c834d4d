"""Vectorised byte-level text primitives shared by the document operators.

Texts stay in their Arrow buffers; words, word hashes and word shingles are
computed for a slice of documents at once. A word is a maximal run of
``[^\\x20\\x09-\\x0D]``; A-Z are lower-cased, other characters are kept.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: One odd multiplier for each place of a word in a shingle.
_PLACE = np.array([(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) | 1 for k in range(16)], dtype=np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_libc = ctypes.CDLL(None)


class Kept:
    """A table of a worker that is made once and stays while task after task uses it."""

    def __init__(self, make):
        self.make, self.held, self.used = make, {}, False
        KEPT.append(self)

    def get(self, key):
        self.used = True
        if key not in self.held:
            self.held[key] = self.make(key)
        return self.held[key]

    def end_of_task(self) -> None:
        if not self.used:
            self.held.clear()
        self.used = False


KEPT: list[Kept] = []


def tidy() -> None:
    """Gives freed memory back to the system; every task of a Python worker ends with it.

    From then on the worker's arrays of 16 MiB or more are mapped on their own and go
    back when they are freed. Nothing is changed in the driver or by an import. Tables
    that the task did not use are dropped: a worker serves many operators in its life.
    """
    for table in KEPT:
        table.end_of_task()
    if hasattr(_libc, "mallopt"):
        _libc.mallopt(-3, 16 << 20)
    trim()


def trim() -> None:
    """Gives freed memory back to the system; for the driver, after it held a large table."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(size: int) -> list[np.ndarray]:
    out = []
    for b in (_BASE, _BASE_INV):
        t = np.full(size, b, dtype=np.uint64)
        t[0] = 1
        out.append(np.multiply.accumulate(t))
    return out


_tables = Kept(_powers)


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each; those of a longer text are made for it alone."""
    size = SLICE_BYTES + (SLICE_BYTES >> 2)
    return _tables.get(size) if n <= size else _powers(n)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first, end, bytes, offsets) of consecutive texts, about ``limit`` bytes at a time.

    A text longer than the limit is a slice of its own. Null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def word_bounds(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more at the end).

    ``apart`` marks the bytes that separate words.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = ~apart[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offs] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Cumulative polynomial sums; :func:`span_hash` turns differences into hashes of spans."""
    pw = _power_tables(len(data) + 1)[0]
    acc = np.empty(len(data) + 1, dtype=np.uint64)
    acc[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=acc[1:])
    return acc


def span_hash(acc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inv = _power_tables(len(acc))[1]
    h = (acc[ends] - acc[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and each document's first word."""
    starts, ends, first = word_bounds(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return span_hash(prefix_hash(_LOWER[data]), starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``n``-word shingles in document order, and each document's first shingle.

    A document of fewer words has one shingle, its whole sequence; without words it has none.
    """
    count = np.diff(first)
    per = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(at[-1], dtype=np.uint64)
    if len(words) >= n:
        m = len(words) - n + 1
        acc = words[:m] * _PLACE[0]
        for k in range(1, n):
            acc += words[k : k + m] * _PLACE[k]
        acc += np.uint64(n)
        doc = np.repeat(np.arange(len(count)), count)
        whole = doc[:m] == doc[n - 1 :]
        long_docs = np.flatnonzero(count >= n)
        if len(long_docs):
            where = np.repeat(at[:-1][long_docs] - np.concatenate([[0], np.cumsum(per[long_docs])[:-1]]), per[long_docs])
            out[where + np.arange(len(where))] = acc[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        acc = count[short].astype(np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            acc[has] += words[first[short[has]] + k] * _PLACE[k]
        out[at[:-1][short]] = acc
    return mix(out), at


def distinct_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for lo, hi, data, offs in text_slices(column):
        words, first = word_hashes(data, offs)
        sh, at = shingle_hashes(words, first, n)
        for d in range(hi - lo):
            s = np.sort(sh[at[d] : at[d + 1]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield lo + d, s


def ragged_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return shift + np.arange(total)
