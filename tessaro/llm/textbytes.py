"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Everything here takes whole Arrow batches and splits them at document
boundaries into chunks of about ``CHUNK`` bytes, so memory does not depend on
the batch size that Spark chooses. A single longer document is a chunk alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: The first n of eight bytes that are read as one little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: The white space of the word contracts: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; ``x`` is uint64 and is not changed."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes; the order within a pair counts."""
    return mix(a * _ODD + b)


def places(n: int, seed: int = 0) -> np.ndarray:
    """A random-looking number for each place below ``n``, to tell equal values at different places apart."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + _U(seed))


def sequences(hashes: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each run ``hashes[first[i] : first[i + 1]]`` of hashes, order and number included."""
    size = np.diff(first)
    at = np.arange(len(hashes)) - np.repeat(first[:-1], size)
    run = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ places(int(size.max(initial=0)), seed)[at]), out=run[1:])
    return mix(run[first[1:]] - run[first[:-1]] + size.astype(np.uint64) * _ODD)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents."""
    data, offs = column_bytes(col)
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` hashes from each on, built by doubling; 0 for the last ``k - 1``."""

    def build(m: int) -> np.ndarray:
        if m == 1:
            return hashes
        half = build(m // 2)
        out = join(half[: len(half) - m // 2], half[m // 2 :])
        return join(out[:-1], hashes[m - 1 :]) if m % 2 else out

    out = np.zeros(len(hashes), np.uint64)
    if k <= len(hashes):
        out[: len(hashes) - k + 1] = build(k)
    return out


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run ``data[start[i] : end[i]]`` of at least one byte."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    n = (size + 7) >> 3
    first = np.cumsum(n) - n
    k = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(start, n) + 8 * k
    part = eight[at] & _FIRST[np.minimum(np.repeat(end, n) - at, 8)]
    total = np.add.reduceat(mix(part ^ places(int(n.max()), seed)[k]), first)
    return mix(total + size.astype(np.uint64) * _ODD)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a chunk.

    start, end: byte positions; first: n + 1 offsets of the documents' words.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        n = len(data)
        inside = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)

    def take(self, rows: np.ndarray) -> Words:
        """The words of some of the documents, without a copy of the bytes."""
        out = object.__new__(Words)
        some = np.zeros(len(self.count), bool)
        some[rows] = True
        words = np.repeat(some, self.count)
        out.data, out.offs = self.data, self.offs
        out.start, out.end, out.count = self.start[words], self.end[words], self.count[some]
        out.first = np.concatenate([[0], np.cumsum(out.count)])
        return out

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process; other seeds give independent ones.

        Eight bytes at a time are mixed with their place in the word before they
        are summed up, so no choice of letters makes long words collide.
        """
        return run_hashes(LOWER[self.data] if lower else self.data, self.start, self.end, seed)

    def windows(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """:func:`grams`; right only where :meth:`starts` says so."""
        return grams(hashes, k)

    def starts(self, k: int) -> np.ndarray:
        """Whether ``k`` words of the same document begin at each word."""
        last = np.repeat(self.first[1:], self.count)
        return np.arange(len(last)) + k <= last


def as_long(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 with the same bits."""
    return x.view(np.int64)
