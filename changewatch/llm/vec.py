"""Vectorised text helpers for functions that run inside Spark tasks.

Texts arrive as Arrow string columns. They are looked at as one byte array with row
offsets, in slices of bounded size, so that words and n-grams of many documents are
hashed by a few numpy calls.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values."""
    x = x.astype(np.uint64) + np.uint64(MULTIPLIER)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_table() -> np.ndarray:
    """Byte to byte: A-Z to lower case, everything else as it is."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_table() -> np.ndarray:
    """True for the bytes of ``[\\x20\\x09-\\x0D]``."""
    t = np.zeros(256, dtype=bool)
    t[[9, 10, 11, 12, 13, 32]] = True
    return t


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) of consecutive rows; null is empty.

    A slice holds at most ``limit`` bytes, or one row that is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        base = offsets[row]
        yield row, data[base : offsets[end]], offsets[row : end + 1] - base
        row = end


def freed() -> None:
    """Give memory that is not in use back to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def freed_after(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``rows``, a function of batches that runs in tasks, which ends with ``freed``.

    Spark keeps a worker for later tasks, several for each core; what an idle one holds adds to the executor's memory.
    """

    @functools.wraps(rows)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from rows(batches)
        finally:
            freed()

    return run


class Hasher:
    """Hashes of arbitrary sub-strings of a byte array, by prefix sums modulo 2**64."""

    def __init__(self, seed: int):
        self.table = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000003 & MASK))
        self.base = (seed * 2862933555777941757 + 3037000493) & MASK | 1
        self.size = 0
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, SLICE)
            steps = np.full(self.size + 1, self.base, np.uint64)
            steps[0] = 1
            self.power = np.cumprod(steps, dtype=np.uint64)
            steps = np.full(self.size + 1, pow(self.base, -1, 1 << 64), np.uint64)
            steps[0] = 1
            self.inverse = np.cumprod(steps, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of data[start:end], for arrays of starts and ends."""
        h = (sums[end] - sums[start]) * self.inverse[start]
        return splitmix(h ^ (end - start).astype(np.uint64) * np.uint64(MULTIPLIER))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_break: np.ndarray):
    """(start, end, row) of maximal runs of bytes that are no breaks; runs end with their row."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~is_break[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_row = offsets[:-1][offsets[:-1] < len(data)]
    first[starts_row] = inside[starts_row]
    start = np.flatnonzero(first)
    # a run ends at the next break, or where the next row starts
    stop = ~inside
    stop[offsets] = True
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, side="right")]
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def shingle_hashes(word_hash: np.ndarray, row: np.ndarray, n_rows: int, width: int = 5):
    """(hash, row) of each run of ``width`` words within a row; a row of fewer words
    (but not none) has one hash of its whole sequence."""
    count = np.bincount(row, minlength=n_rows)
    mult = splitmix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(word_hash)
    hashes, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= width:
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h += word_hash[k : n - width + 1 + k] * mult[k]
        same = row[: n - width + 1] == row[width - 1 :]
        hashes, rows = splitmix(h[same]), row[: n - width + 1][same]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(row, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] += word_hash[begin[has] + k] * mult[k]
        extra = splitmix(extra ^ count[short].astype(np.uint64))
        hashes, rows = np.concatenate([hashes, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows
