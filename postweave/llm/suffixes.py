"""Suffix arrays and common prefixes of integer sequences, in numpy.

No Python statement runs per symbol: each round of the refinement and each block of
comparisons is one array operation over all suffixes that are still open.
"""

from __future__ import annotations

import numpy as np

#: Symbols compared at once, over all pairs that are still equal.
_BLOCK = 1 << 20
_WIDEST = 4096


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in sorted order, by Larsson-Sadakane refinement.

    The first ranks are those of as many symbols as fit into 63 bits.  Then the groups
    of equal rank, and only those, are sorted by the rank of what follows, over
    twice as many symbols each round, until every suffix has its own rank.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    bits = (int(symbols.max()) + 1).bit_length()
    reach = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for t in range(reach):
        key <<= bits
        key[: max(n - t, 0)] += symbols[t:].astype(np.int64) + 1
    order = np.argsort(key)
    key = key[order]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    while True:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        open_ = ~new
        open_[:-1] |= ~new[1:]
        slots = slots[open_]
        if not len(slots):
            return order
        start = order[slots]
        after = start + reach
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[start] * (n + 1) + second
        turn = np.argsort(key)
        key = key[turn]
        order[slots] = start[turn]
        reach *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in ``order``.

    By Kasai's rule, taken in text order: a suffix that follows the same symbol as its
    predecessor in ``order`` shares exactly one symbol less than the suffix before it in the
    text.  Only the others are compared, all at once.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    derived = np.zeros(n, bool)
    derived[1:] = (before[1:] > 0) & (symbols[:-1] == symbols[np.maximum(before[1:] - 1, 0)])
    compared = np.flatnonzero(~derived & (before >= 0))
    shared = np.zeros(n, np.int64)
    shared[compared] = _matching(symbols, compared, before[compared])
    place = np.arange(n)
    base = np.maximum.accumulate(np.where(derived, 0, place))
    return (shared[base] - (place - base))[order]


def _matching(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from ``a[i]`` and from ``b[i]`` on are equal; ``a[i] != b[i]``."""
    padded = np.concatenate([symbols.astype(np.int16 if symbols.dtype == np.uint8 else np.int64), np.full(_WIDEST, -1)])
    out = np.zeros(len(a), np.int64)
    live, width = np.arange(len(a)), 16
    while len(live):
        views = np.lib.stride_tricks.sliding_window_view(padded, width)
        equal = []
        for at in range(0, len(live), max(1, _BLOCK // width)):
            some = live[at : at + max(1, _BLOCK // width)]
            same = views[a[some] + out[some]] == views[b[some] + out[some]]
            whole = same.all(axis=1)
            out[some] += np.where(whole, width, same.argmin(axis=1))
            equal.append(some[whole])
        live, width = np.concatenate(equal), min(2 * width, _WIDEST)
    return out
