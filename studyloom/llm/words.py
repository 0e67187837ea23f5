"""Words, bytes and hashes of an Arrow text column, as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All arrays describe a block of
documents of a few megabytes, so a task's memory depends on the block size and on its
longest single document, never on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Powers that are kept between blocks; higher ones are products of two kept or short-lived ones.
FINE = 1 << 14
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64's last steps)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


@lru_cache(8)
def _fine(base: int) -> np.ndarray:
    out = np.full(FINE, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    coarse = np.full(max(1, -(-n // FINE)), pow(base, FINE, 1 << 64), np.uint64)
    coarse[0] = 1
    return (np.cumprod(coarse, dtype=np.uint64)[:, None] * _fine(base)).ravel()[:n]


def powers_at(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64."""
    coarse = np.full(int(at.max(initial=0)) // FINE + 1, pow(base, FINE, 1 << 64), np.uint64)
    coarse[0] = 1
    return np.cumprod(coarse, dtype=np.uint64)[at // FINE] * _fine(base)[at % FINE]


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp value of codes[start:end] for every pair, from one running sum.

    The value is sum(codes[start + j] * base**j) modulo 2**64, whatever the start is.
    """
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    weighted = powers(base, n)
    weighted *= codes
    np.cumsum(weighted, dtype=np.uint64, out=sums[1:])
    del weighted
    return (sums[end] - sums[start]) * powers_at(pow(base, -1, 1 << 64), start)


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for size[i] places, for each i in turn."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - first, size)


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, example, which) of the distinct byte strings data[start:end]; bytes are compared, so it's exact."""
    size = end - start
    hashes = mix(span_hashes(byte_codes()[data], start, end) + size.astype(np.uint64))
    distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    twin = example[which]
    if np.array_equal(size, size[twin]) and np.array_equal(data[places(start, size)], data[places(start[twin], size)]):
        return distinct, example, which
    # two strings share a hash: tell them apart by their bytes
    raw, names = data.tobytes(), {}
    which = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
    example = np.full(len(names), len(start))
    np.minimum.at(example, which, np.arange(len(start)))
    return hashes[example], example, which


class SpanMemory:
    """Ids of byte strings that a task has met, at most `limit` bytes of them; then it starts anew.

    Strings are found by hash and compared byte by byte.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text_at, self.ids_at = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of each string, -1 where it isn't known."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        row = np.where(self.known[at] == hashes, self.row[at], -1)
        ok = np.flatnonzero(row >= 0)
        size = (end - start)[ok]
        ok = ok[size == np.diff(self.text_at)[row[ok]]]
        size = (end - start)[ok]
        same = data[places(start[ok], size)] == self.text[places(self.text_at[row[ok]], size)]
        good = ok[np.add.reduceat(~same, np.cumsum(size) - size) == 0] if len(ok) else ok
        out = np.full(len(hashes), -1)
        out[good] = row[good]
        return out

    def add(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        size = end - start
        if 32 * (len(self.known) + len(hashes)) + len(self.text) + 4 * len(self.ids) + int(size.sum()) + 4 * len(ids) > self.limit:
            self.forget()
        known = np.concatenate([self.known, hashes])
        row = np.concatenate([self.row, len(self.row) + np.arange(len(hashes))])
        order = np.argsort(known, kind="stable")
        self.known, self.row = known[order], row[order]
        self.text = np.concatenate([self.text, data[places(start, size)]])
        self.ids = np.concatenate([self.ids, ids])
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.cumsum(size)])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum(count)])

    def ids_of(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each row in turn, and how many each has."""
        count = np.diff(self.ids_at)[row]
        return self.ids[places(self.ids_at[row], count)], count


@dataclass
class Block:
    """Consecutive documents: bytes, their bounds, and the bounds of their words."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each document's words, then their number

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return mix(span_hashes(byte_codes()[data], self.start, self.end) + (self.end - self.start).astype(np.uint64))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the bounds of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def split(data: np.ndarray, bounds: np.ndarray, rows: slice) -> Block:
    space = SPACE[data]
    opens, closes = ~space, ~space
    opens[1:] &= space[:-1]
    closes[:-1] &= space[1:]
    full = np.diff(bounds) > 0
    opens[bounds[:-1][full]] = ~space[bounds[:-1][full]]
    closes[bounds[1:][full] - 1] = ~space[bounds[1:][full] - 1]
    start = np.flatnonzero(opens)
    return Block(rows, data, bounds, start, np.flatnonzero(closes) + 1, np.searchsorted(start, bounds))


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of about limit bytes; a longer document is one block."""
    data, bounds = utf8(column)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1)
        yield split(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], slice(lo, hi))
        lo = hi


def window_starts(block: Block, width: int) -> np.ndarray:
    """Indices of the words that begin a window of width words inside one document."""
    counts = np.maximum(block.n_words - width + 1, 0)
    total = int(counts.sum())
    return np.arange(total) + np.repeat(block.first[:-1] - (np.cumsum(counts) - counts), counts)


def covered(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n_words words lie in a window that begins at one of starts."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]
