"""Numpy kernels over Arrow string columns: byte chunks, words, shingles, hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so UTF-8 text
never splits inside a character.  Hashes are 64 bits wide: bytes go through a
table of random numbers before the polynomial, and the sum is mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)
SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
CHUNK = 2 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, with a salt."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay near the limit; one row is never split."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and row numbers of all words."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    own = ~SEP[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    starts = own.copy()
    starts[1:] &= ~own[:-1] | edge[1:-1]
    ends = own.copy()
    ends[:-1] &= ~own[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        p = np.full(max(n, 1024), BASE, np.uint64)
        p[0] = 1
        _POWERS[0] = np.multiply.accumulate(p)
    return _POWERS[0]


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A hash of each disjoint, ascending byte span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    inside = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    value = table[buf[inside + np.repeat(starts, lens)]] * powers(int(lens.max()))[inside]
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * STEP)


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each row's first word (one more at the end)."""
    starts, ends, row = words(buf, offs)
    return spans_hash(buf, starts, ends, BYTE_LOWER if lower else BYTE), np.searchsorted(row, np.arange(len(offs)), "left")


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries, row borders ignored; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = h[:n].copy()
    for j in range(1, k):
        s *= STEP
        s += h[j : n + j]
    return mix(s, k)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingle hashes of all rows, in order and with repeats, and each row's first index.

    A row of fewer than k words, but some, has its whole sequence as one
    shingle if short is set and none otherwise.
    """
    n = np.diff(first)
    count = np.maximum(n - k + 1, (n > 0) * 1 if short else 0)
    ptr = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(ptr[-1]), np.uint64)
    g = grams(h, k)
    full = n >= k
    inside = np.arange(int(ptr[-1]), dtype=np.int64) - np.repeat(ptr[:-1], count)
    at = np.repeat(first[:-1], count) + inside
    ok = np.repeat(full, count)
    out[ok] = g[at[ok]]
    if short:
        for i in np.flatnonzero(~full & (n > 0)):
            out[ptr[i]] = grams(h[first[i] : first[i + 1]], int(n[i]))[0]
    return out, ptr


def unique_rows(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row."""
    out = [np.unique(values[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    return (np.concatenate(out) if out else values[:0]), np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)]).astype(np.int64)


def shingle_sets(column: pa.Array, k: int = 5, short: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: lo, hi, distinct shingle hashes (A-Z lower-cased), and each row's first index."""
    buf, offs = raw(column)
    for lo, hi in chunks(offs):
        h, first = word_hashes(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], True)
        yield lo, hi, *unique_rows(*shingles(h, first, k, short))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of many ranges, in one flat array."""
    total = int(lens.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts, lens)
