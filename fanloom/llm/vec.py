"""Vectorised text primitives over Arrow string columns (numpy on the raw UTF-8 bytes).

Nothing here loops over characters or words in Python: words are found with byte classes, and a word's 64-bit
hash comes from one running polynomial sum modulo 2**64, so the cost per byte does not depend on word lengths.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes; upper case is folded for ASCII and Latin-1.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, 1 << 21)
        for_base = np.full(size, _BASE, np.uint64)
        for_base[0] = 1
        for_inv = np.full(size, _INV, np.uint64)
        for_inv[0] = 1
        _POW, _IPOW = np.multiply.accumulate(for_base), np.multiply.accumulate(for_inv)
    return _POW[:n], _IPOW[:n]


def release() -> None:
    """Gives freed memory back to the system: a worker that is kept for the next stage keeps its heap otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """Makes a function over batches release memory when its task ends."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = 1 << 21):
    """Row ranges of at most so many bytes each (a longer row stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters."""
    low = _LOWER[buf]
    if len(buf) > 1:
        up = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        low[up] += 32
    return low


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they are."""
    p, q = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * p[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts])


def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a byte mask, cut at row offsets."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first word of each row ... and the end): the words of the rows in order."""
    low = fold(buf)
    s, e = edges(_WORD[low], offsets)
    return hashes(low, s, e), s, e, np.searchsorted(s, offsets)


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word shingles and where each row's begin; a shorter row that has words has one, of all its words."""
    size = np.diff(first)
    m = len(h)
    total = np.zeros(max(m - n + 1, 0), np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(total)]
    total = mix(total)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begin[-1], np.uint64)
    row = np.repeat(np.arange(len(size)), count)
    at = np.arange(begin[-1]) - begin[row] + first[row]
    long = size[row] >= n
    out[long] = total[at[long]]
    for r in np.flatnonzero((size > 0) & (size < n)):
        x = np.uint64(0)
        with np.errstate(over="ignore"):
            for v in h[first[r] : first[r + 1]]:
                x = x * np.uint64(0xD6E8FEB86659FD93) + v
        out[begin[r]] = mix(np.array([x]))[0]
    return out, begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, without repeats."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, row))
    v = values[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(begin) - 1))]).astype(np.int64)
