"""Repeated substrings of one shard by threshold-bounded interval expansion.

Over the suffix order of the shard's segments, the intervals of suffixes that
start with a string are widened by one byte to the left at a time, breadth first,
on the Burrows-Wheeler transform. An interval of strings of length ``k + 1`` that
ends where no common prefix is known yet ends a common prefix of length ``k``;
so common prefixes come out by increasing value, and the search stops at the
length asked for. What is still unknown is at least that long.
"""

from __future__ import annotations

import numpy as np

#: Most bytes (with one end mark a segment) of a shard.
MOST = 1 << 20


def _suffixes(symbols: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and its inverse; a suffix ends at its segment's end mark, equal
    suffixes stand in the order of their places (as if the marks differed)."""
    n = len(symbols)
    low = np.uint64(20)
    room = ends - np.arange(n, dtype=np.int32)
    wide = np.concatenate([symbols, np.zeros(4, symbols.dtype)])
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key <<= np.uint64(9)
        key |= np.where(room >= k, wide[k : k + n], np.uint16(0))
    h = 4
    # One array of 64 bits is sorted in place; the others have 32 bits.
    while True:
        key <<= low
        key |= np.arange(n, dtype=np.uint64)
        key.sort()
        order = (key & np.uint64(MOST - 1)).astype(np.int32)
        key >>= low
        step = np.cumsum(np.append(False, key[1:] != key[:-1]), dtype=np.uint32)
        rank = np.empty(n, np.uint32)
        rank[order] = step
        if h > longest or int(step[-1]) == n - 1:
            inverse = np.empty(n, np.int32)
            inverse[order] = np.arange(n, dtype=np.int32)
            return order, inverse
        key[:] = rank
        key <<= low
        at = np.flatnonzero(room >= h)
        key[at] |= np.minimum(rank[at + h] + np.uint32(1), np.uint32(MOST - 1))
        h *= 2


def repeated_starts(segments: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each segment the starts whose next ``least`` bytes, all within the
    segment, also start at another place of the shard."""
    sizes = np.array([len(s) + 1 for s in segments], np.int64)
    n = int(sizes.sum())
    if n > MOST - 2:
        raise ValueError("the shard is too large")
    close = np.cumsum(sizes) - 1
    symbols = np.zeros(n, np.uint16)
    inner = np.ones(n, bool)
    inner[close] = False
    symbols[inner] = np.concatenate(segments) + np.uint16(1)
    order, inverse = _suffixes(symbols, np.repeat(close.astype(np.int32), sizes), int(sizes.max()))
    before = order - 1
    bwt = np.where(before >= 0, symbols[before], 0).astype(np.int16)
    lf = np.where(bwt > 0, inverse[before], np.int32(0))
    count = np.concatenate([[0], np.cumsum(np.bincount(symbols.astype(np.int16), minlength=257))]).astype(np.int32)
    # The next and the previous place of the same byte in the transform.
    real = np.flatnonzero(bwt)
    back = np.full(n + 1, -1, np.int32)
    back[lf[real]] = real
    up, down = lf + 1, lf - 1
    nxt = np.where((up < count[bwt + 1]) & (bwt > 0), back[np.minimum(up, n)], np.int32(n))
    nxt[nxt < 0] = n
    prv = np.where((down >= count[bwt]) & (bwt > 0), back[np.maximum(down, 0)], np.int32(-1))
    del up, down, back, before, inverse
    # Known from the start: the borders between end marks, and between first bytes.
    far = np.zeros(n + 1, bool)
    far[: len(segments) + 1] = True
    far[n] = True
    used = np.flatnonzero(np.diff(count[1:])) + 1
    marks = np.arange(len(segments), dtype=np.int32)
    lo, hi = np.concatenate([marks, count[used]]), np.concatenate([marks + 1, count[used + 1]])
    far[hi] = True
    for _ in range(1, least):
        if not len(lo):
            break
        wide = hi - lo
        at = np.repeat(lo - (np.cumsum(wide, dtype=np.int32) - wide), wide)
        at += np.arange(len(at), dtype=np.int32)
        solid = bwt[at] > 0
        start = lf[at[(prv[at] < np.repeat(lo, wide)) & solid]]
        stop = lf[at[(nxt[at] >= np.repeat(hi, wide)) & solid]] + 1
        start.sort()
        stop.sort()
        new = ~far[stop]
        lo, hi = start[new], stop[new]
        far[hi] = True
    twice = ~far[:-1] | ~far[1:]
    flag = np.zeros(n, bool)
    flag[order[twice]] = True
    return [np.flatnonzero(flag[a : a + k]) for a, k in zip(close + 1 - sizes, sizes, strict=True)]
