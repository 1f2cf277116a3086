"""Vectorised word hashing over Arrow string batches.

A batch is taken as one byte buffer: words, their 64-bit hashes and the hashes of word
shingles come from whole-array numpy operations, so the cost per document is small and the
memory is a multiple of ``CHUNK_BYTES`` (or of one text, where a single text is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 17  # what is made of it stays in the processor's cache
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_LOWER = bytes(range(256)).lower()
_WORD_BYTES = np.array([x != 32 and not 9 <= x <= 13 for x in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES * 16
    while size < n:
        size *= 2
    return _powers(size)


class Words:
    """Words of consecutive texts: ``hash``, byte span ``start``/``end`` and ``first[d]:first[d+1]`` per text."""

    __slots__ = ("hash", "start", "end", "first", "data", "base")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool, word_bytes: np.ndarray | None) -> None:
        """data: bytes; bounds: n+1 offsets into it; word_bytes: 256 flags of bytes that belong to words
        (null: all but ASCII white space)."""
        if lower:
            data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
        inside = np.frombuffer(data.tobytes().translate((_WORD_BYTES if word_bytes is None else word_bytes).tobytes()), bool)
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        flag = np.zeros(n + 2, bool)
        flag[1:-1] = inside
        here, before = flag[1:], flag[:-1]
        self.start = np.flatnonzero(here[:n] & (~before[:n] | edge[:n]))
        self.end = np.flatnonzero(before & (~here | edge))
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        each = data.astype(np.uint64)
        each += np.uint64(1)
        each *= up[:n]
        np.cumsum(each, out=total[1:])
        raw = (total[self.end] - total[self.start]) * down[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * _M2)
        self.first = np.searchsorted(self.start, bounds)
        self.data, self.base = data, bounds

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they all lie in the word's own text.
        A text with 1 to k-1 words has its whole sequence as its only shingle, at its first word."""
        n = len(self.hash)
        out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
        counts = np.diff(self.first)
        left = np.repeat(self.first[1:], counts) - np.arange(n)
        for size in range(1, k + 1):
            at = np.flatnonzero(left >= k) if size == k else np.repeat(self.first[:-1], counts == size)
            acc = np.full(len(at), size, np.uint64)
            for j in range(size):
                acc = mix(acc * _M1 + self.hash[at + j])
            out[at] = acc
            ok[at] = True
        return out, ok


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, past-the-last row, bytes, offsets) of at most ``limit`` bytes, or of one text."""
    data, at = buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, to, data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def words(column: pa.Array, lower: bool = True, word_bytes: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    for row, to, data, at in chunks(column):
        yield row, to, Words(data, at, lower, word_bytes)
