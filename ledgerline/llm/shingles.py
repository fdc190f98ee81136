"""Sets of word shingles as sorted 64-bit hashes, computed on flat numpy arrays of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ledgerline.llm.common import row_chunks

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
R = np.uint64(0x9E3779B97F4A7C15 | 1)
R_INVERSE = np.uint64(pow(int(R), -1, 1 << 64))
BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, R), np.full(n, R_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words stand before each text (n + 1 numbers)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text's end is a word's end
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    up, down = _powers(1 << max(21, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[LOWER[data]] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles of k words, sorted; a text of fewer words has one of all its words, or none."""
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    out: list[np.ndarray] = []
    for lo, hi in row_chunks(offsets):
        at = offsets[lo : hi + 1]
        w, before = words(data[at[0] : at[-1]], at - at[0])
        m = max(0, len(w) - k + 1)
        full = np.full(m, np.uint64(k))
        for j in range(k):
            full += w[j : j + m] * factors[j]
        full = mix(full)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(full[a : b - k + 1]))
            elif b > a:
                out.append(mix(np.array([(w[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sets that are not empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
