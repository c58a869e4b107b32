"""Vectorised kernels over Arrow text columns: words, word hashes, windows and shingle sets.

A batch's texts lie in one byte buffer, so words are found and hashed for all texts at once. Work is
done in chunks of about `CHUNK` bytes (one text at least), which bounds memory by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

_U = np.uint64


def _table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, n, dtype=np.uint64)


#: One random number for each byte value; the lower-casing twin maps A-Z to a-z.
_BYTES = _table(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _table(2, 64) | _U(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = max(n, CHUNK + 65536)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        if size <= 2 * CHUNK + 65536:
            _powers[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets of the texts in them, one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of the texts of a chunk: byte positions, and for text i words ptr[i] to ptr[i + 1]."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        space = _IS_SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if n:
            left = edge[:-1].copy()
            left[0] = True
            left[1:] |= space[:-1]
            right = edge[1:].copy()
            right[-1] = True
            right[:-1] |= space[1:]
            np.logical_not(space, out=space)
            self.starts = np.flatnonzero(left & space)
            self.ends = np.flatnonzero(right & space) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.ptr = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.ptr)

    def hashes(self, lower: bool) -> np.ndarray:
        """64-bit hashes of the words, from prefix sums over the bytes."""
        n = len(self.buf)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTES)[self.buf] * powers(_BASE, n), out=sums[1:], dtype=np.uint64)
        return mix((sums[self.ends] - sums[self.starts]) * powers(_BASE_INV, n)[self.starts])


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k words in a row, at the index of the first; runs over two texts too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 12:
        out = words[:n] * _STEP[seed]
        for j in range(1, k):
            out += words[j : j + n] * _STEP[seed + j]
        return mix(out)
    base = int(_STEP[seed])
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_U(base), len(words)), out=sums[1:], dtype=np.uint64)
    return mix((sums[k:] - sums[:-k]) * powers(_U(pow(base, -1, 2**64)), n))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the lower-cased k-word shingles of each text, and where each set begins.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    words = Words(buf, offsets)
    w = words.hashes(lower=True)
    every = window_hashes(w, k)
    parts, sizes = [], np.zeros(len(words.counts), np.int64)
    for i, (a, n) in enumerate(zip(words.ptr[:-1].tolist(), words.counts.tolist())):
        if n >= k:
            s = every[a : a + n - k + 1]
            s.sort()
        elif n:
            s = mix(np.array([(w[a : a + n] * _STEP[40 : 40 + n]).sum(dtype=np.uint64) + _U(n)], np.uint64))
        else:
            continue
        parts.append(s)
        sizes[i] = len(s)
    ptr = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ptr[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[ptr[:-1][sizes > 0]] = True
    before = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return flat[keep], before[ptr]
