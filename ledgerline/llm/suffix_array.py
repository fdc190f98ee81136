"""Suffix arrays by two-stage sorting, in numpy.

Only the suffixes that are smaller than their successors are sorted directly, here by their first `depth` bytes. All
others are induced: character by character in ascending order, a finished bucket is scanned and each suffix in it
places its predecessor, if that one is larger than it, behind those already placed in the predecessor's bucket. As one
scan of a bucket is one stable sort of its predecessors by their first byte, the work stays in numpy.
"""

from __future__ import annotations

import numpy as np


def keys8(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position, its next eight bytes as a number that sorts like them; behind the end come `depth` zeros and more."""
    padded = np.concatenate([text, np.zeros(16 + depth, np.uint8)])
    return np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,)).astype(np.uint64)


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the last one is not."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    up = np.zeros(n, bool)
    # Within a run of equal bytes the byte after the run decides; the run at the end falls off.
    ends = np.append(change, n - 1)
    rising = np.append(text[change] < text[change + 1], False)
    up[:] = np.repeat(rising, np.diff(np.append(-1, ends)))
    return up


def sort_directly(at: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Positions `at` in the order of their first `depth` bytes; rounds of eight bytes touch only what is still tied."""
    order = at[np.argsort(keys[at], kind="stable")]
    first = keys[order]
    group = np.concatenate([[0], np.cumsum(first[1:] != first[:-1])]) if len(order) else np.zeros(0, np.int64)
    open_ = np.arange(len(order))
    for shift in range(8, depth, 8):
        g = group[open_]
        same = np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        open_ = open_[same[1:] | same[:-1]]
        if not len(open_):
            break
        g, k = group[open_], keys[order[open_] + shift]
        new = np.lexsort((k, g))
        order[open_] = order[open_][new]
        k = k[new]
        start = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        group[open_] = open_[np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))]
    return order


def suffix_array(text: np.ndarray, depth: int, keys: np.ndarray | None = None) -> np.ndarray:
    """All positions of `text` (uint8) in suffix order, exact in the first `depth` bytes: suffixes that agree so far count as equal."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    up = smaller_than_successor(text)
    direct = sort_directly(np.flatnonzero(up), keys8(text, depth) if keys is None else keys, depth)
    heads = text[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    down = ~up
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in np.unique(text).tolist():
        placed = np.concatenate(queues[c]) if queues[c] else np.zeros(0, np.int64)
        wave, scanned = placed, []
        while len(wave):  # within a run of c, each suffix places the one before it
            scanned.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        larger = np.concatenate(scanned) if scanned else placed
        bucket = np.concatenate([larger, direct[bounds[c] : bounds[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[down[before] & (text[before] > c)]
        head = text[before]
        before = before[np.argsort(head, kind="stable")]
        cuts = np.searchsorted(text[before], np.arange(257))
        for d in np.unique(head).tolist():
            queues[d].append(before[cuts[d] : cuts[d + 1]])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, sa: np.ndarray, keys: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many bytes each suffix of `sa` but the first has in common with the one before it.

    stop: where the suffix at each position of `text` ends, e.g. with its segment; no common prefix goes beyond. Rounds of eight bytes touch
    only what is still equal.
    """
    a, b = sa[:-1], sa[1:]
    room = np.minimum(stop[a] - a, stop[b] - b)
    common = np.zeros(len(room), np.int64)
    open_ = np.arange(len(room))
    while len(open_):
        x = keys[a[open_] + common[open_]] ^ keys[b[open_] + common[open_]]
        # The leading zero bytes of the difference.
        same = np.zeros(len(x), np.int64)
        for byte in range(8):
            same += (x >> np.uint64(56 - 8 * byte)) == 0
        common[open_] = np.minimum(common[open_] + same, room[open_])
        open_ = open_[(same == 8) & (common[open_] < room[open_])]
    return common
