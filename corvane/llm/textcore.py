"""Whole-batch word splitting and hashing over the UTF-8 bytes of Arrow string columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. All separators are ASCII, so
splitting bytes and splitting code points give the same words. Hashes are 64 bit: equal words
have equal hashes everywhere, and different ones collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = U64(0x9E3779B97F4A7C55)
_RI = U64(pow(0x9E3779B97F4A7C55, -1, 2**64))
_Q = U64(0xD1B54A32D192ED03)
_QI = U64(pow(0xD1B54A32D192ED03, -1, 2**64))
_tables: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table only grows."""
    t = _tables.get(int(base))
    if t is None or len(t) < n:
        t = np.full(max(n, 1 << 16), base, U64)
        t[0] = 1
        t = np.multiply.accumulate(t)
        _tables[int(base)] = t
    return t[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@dataclass
class Words:
    """Words of consecutive documents. ``first[d]:first[d+1]`` are the words of document d."""

    data: np.ndarray  # bytes of all documents, one after another
    offs: np.ndarray  # document d is data[offs[d]:offs[d+1]]
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    prefix: np.ndarray  # running polynomial sums of the bytes
    raw_prefix_pow: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes in each span, whatever its place."""
        inv = powers(_RI, len(self.prefix))
        h = (self.prefix[end] - self.prefix[start]) * inv[start]
        return mix(h + (end - start).astype(U64) * U64(0xA24BAED4963EE407))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def split(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> Words:
    offs = offs.astype(np.int64)
    data = data[offs[0] : offs[-1]]
    offs = offs - offs[0]
    if lower:
        data = LOWER[data]
    n = len(data)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
    start = np.flatnonzero(word & (edge[:-1] | ~before))
    end = np.flatnonzero(word & (edge[1:] | ~after)) + 1
    prefix = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_R, n), out=prefix[1:])
    return Words(data, offs, start, end, np.searchsorted(start, offs), prefix, powers(_R, 1))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values of h, by differences of one running sum."""
    if len(h) < n:
        return np.zeros(0, U64)
    s = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(_Q, len(h)), out=s[1:])
    return mix((s[n:] - s[:-n]) * powers(_QI, len(h) - n + 1) + U64(n))


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offs.astype(np.int64)


def slices(offs: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most so many bytes, or of one document."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def trim() -> None:
    """Give memory that finished arrays leave behind back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def docs_words(col: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for slices of a text column."""
    data, offs = strings(col)
    for a, b in slices(offs):
        yield a, b, split(data, offs[a : b + 1], lower)
    if len(data) > 1 << 20:
        trim()
