"""Vectorised text primitives on the UTF-8 bytes of an Arrow string column.

Rolling prefix sums modulo 2**64 give the hash of any byte range in constant time, so words and
shingles of thousands of documents are hashed by a few numpy passes without a Python loop a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes that are handled at once; a longer single document makes a longer block.
BLOCK_BYTES = 1 << 18

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((BASE, BASE_INV)):
            step = np.full(size, base, U)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about ``size`` bytes; every row is in one run."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b
        a = b


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true; runs stop at the ends of rows."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` and each row's first word (n + 1 offsets)."""
    starts, ends = runs(IS_WORD[data], off)
    hashes = range_hashes(LOWER[data] if lower else data, starts, ends)
    return hashes, np.searchsorted(starts, off)


SHINGLE = 5
_STEP = [U(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(1, SHINGLE + 1)]


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its 5-word shingles (ASCII lower case); fewer words
    make one shingle of the whole sequence, none make an empty set."""
    w, at = words(data, off)
    whole = np.zeros(0, U)
    if len(w) >= SHINGLE:
        n = len(w) - SHINGLE + 1
        whole = w[:n] * _STEP[0]
        for k in range(1, SHINGLE):
            whole += w[k : k + n] * _STEP[k]
        whole = mix(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(whole[a : b - SHINGLE + 1]))
        elif b > a:
            short = U(b - a)
            with np.errstate(over="ignore"):
                for k in range(a, b):
                    short = short * U(0x100000001B3) + w[k]
            out.append(mix(np.array([short], U) ^ U(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, U))
    return out
