"""Classes of equal fixed-length strings in a block of bytes, from its Burrows-Wheeler transform.

Common prefixes of neighbouring suffixes are found by increasing value: a breadth-first search starts with
the interval of all suffixes and extends intervals backwards, one byte a level, by the transform's mapping
from last to first column; an interval whose right border has no value yet gets the level, and only such
intervals go on. The search stops at the minimum length: borders without a value then stand between suffixes
that share at least that much.
"""

from __future__ import annotations

import numpy as np


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Place of each suffix in sorted order, by prefix doubling from packed keys of 7 symbols; only ties go on."""
    n = len(text)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, dtype=np.int64)])
    for k in range(7):
        key = key << 9 | padded[k : k + n]
    order = np.argsort(key)
    new = np.empty(n, dtype=bool)
    new[:1] = True
    s = key[order]
    new[1:] = s[1:] != s[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.repeat(start, size)
    open_ = order[np.repeat(size > 1, size)]
    h = 7
    while len(open_):
        key = (rank[open_] << 32) + rank[np.minimum(open_ + h, n)] + 1
        o = np.argsort(key)
        open_, key = open_[o], key[o]
        old = key >> 32
        new = np.empty(len(key), dtype=bool)
        new[0] = True
        new[1:] = key[1:] != key[:-1]
        group = np.empty(len(key), dtype=bool)
        group[0] = True
        group[1:] = old[1:] != old[:-1]
        at = np.arange(len(key))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        first = np.maximum.accumulate(np.where(group, at, 0))
        rank[open_] = old + np.repeat(start, size) - first
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return rank[:n]


def long_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, joined): suffixes in sorted order, and whether each shares at least `least` symbols with the one before it."""
    n = len(text)
    rank = suffix_ranks(text)
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    last = text[order - 1]
    lf = rank[order - 1]
    known = np.zeros(n + 1, dtype=bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        one = size == 1
        a = lf[low[one]]
        many_low, many_size = low[~one], size[~one]
        pos = np.repeat(many_low - (np.cumsum(many_size) - many_size), many_size) + np.arange(int(many_size.sum()))
        # within one interval, equal symbols map to a run of neighbouring places
        key = np.repeat(np.arange(len(many_low)) << 32, many_size) | lf[pos]
        o = np.argsort(key)
        to, symbol, which = key[o] & 0xFFFFFFFF, last[pos][o], key[o] >> 32
        cut = np.ones(len(to), dtype=bool)
        cut[1:] = (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])
        start = np.flatnonzero(cut)
        low = np.concatenate([a, to[start]])
        high = np.concatenate([a + 1, to[np.append(start[1:], len(to)) - 1] + 1]) if len(to) else a + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
        high, first = np.unique(high, return_index=True)
        low = low[first]
    return order, ~known[:n]


def equal_classes(text: np.ndarray, least: int) -> np.ndarray:
    """A number for each place; places have the same number if the next `least` symbols are the same."""
    order, joined = long_prefixes(text, least)
    out = np.empty(len(text), dtype=np.int64)
    out[order] = np.cumsum(~joined) - 1
    return out
