"""Texts of an Arrow batch as flat numpy arrays.

Python tasks of this package work on whole slices of a batch instead of on
single rows: the UTF-8 bytes of all texts lie in one buffer, and words are
(start, end) positions in it. A slice holds whole texts of about
``SLICE_BYTES`` bytes together (a longer text is a slice of its own), which
bounds the memory of a task whatever the size of Spark's batches.

Null texts count as empty. Words are maximal runs of bytes other than space
and 0x09-0x0D; only A-Z is lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def is_space_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_SPACE = is_space_table()
_LOWER = lower_table()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@dataclass
class Texts:
    """Consecutive rows of a batch: ``buf[off[i]:off[i + 1]]`` is text i."""
    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.off)

    def raw(self, i: int) -> bytes:
        return self.buf[self.off[i]:self.off[i + 1]].tobytes()


def text_slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a string column, in slices of about ``slice_bytes``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + slice_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Texts(lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        lo = hi


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._row(_BASE, n)
            self.down = self._row(pow(_BASE, -1, 1 << 64), n)
        return self.up, self.down

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        row = np.full(n, base, np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)


@dataclass
class Words:
    """Words of a slice: text index, byte range and hash of each."""
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray  # running polynomial sums, for hashes of other byte ranges

    def per_doc(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n)


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the byte ranges [start, end); equal bytes give equal hashes."""
    _, down = powers.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words_of(t: Texts, powers: Powers, lower: bool = True) -> Words:
    buf = _LOWER[t.buf] if lower else t.buf
    n = len(buf)
    up, _ = powers.upto(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * up[:n], out=prefix[1:])
    solid = ~_SPACE[buf]
    first = np.zeros(n + 1, bool)  # a text starts here (n: the end of all)
    first[t.off] = True
    before = np.ones(n, bool)
    before[1:] = ~solid[:-1]
    start = np.flatnonzero(solid & (before | first[:n]))
    after = np.ones(n, bool)
    after[:-1] = ~solid[1:]
    end = np.flatnonzero(solid & (after | first[1:])) + 1
    doc = np.searchsorted(t.off, start, side="right") - 1
    return Words(doc, start, end, range_hash(prefix, start, end, powers), prefix)


def window_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text: index of the
    first word of each run, and its hash."""
    n = len(words.hash)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = n - width + 1
    h = np.zeros(m, np.uint64)
    for k in range(width):
        h = h * _U(_BASE) + words.hash[k:k + m]
    at = np.flatnonzero(words.doc[:m] == words.doc[width - 1:])
    return at, mix(h[at])
