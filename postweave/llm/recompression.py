"""Recompression of word sequences: names for runs and pairs that equal substrings share.

A round names every run of equal symbols and every pair of neighbours whose first
symbol is in the left half of the alphabet and second in the right half.  Halves and
names come from hashes of what is named, so all tasks of all documents give the same
names without exchanging anything.  Inside equal substrings the symbols are equal; only
those at the rim depend on what lies around.  For each symbol the words that decide it
are kept, so a caller knows which symbols any two occurrences of a window share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from postweave.llm.words import mix


@dataclass
class Symbols:
    """Names, the words ``start .. end`` each stands for, and the words ``low .. high`` that decide it."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray


def symbols(hashes: np.ndarray, owner: np.ndarray, rounds: int) -> Symbols:
    """Symbols after ``rounds`` rounds; none crosses from one text into the next.

    What lies beyond a text's edge counts as deciding too: elsewhere the same words may
    go on there.
    """
    at = np.arange(len(hashes))
    s = Symbols(hashes, at, at + 1, at, at + 1, owner)
    for k in range(rounds):
        s = _pairs(_runs(s), k)
    return s


def _joined(s: Symbols, first: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
    end = np.append(s.end[first[1:] - 1], s.end[-1:])
    return Symbols(name, s.start[first], end, low, high, s.text[first])


def _neighbours(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """``low`` of the symbol before and ``high`` of the one after; past an edge, one word on."""
    low, high = s.start - 1, s.end + 1
    same = s.text[1:] == s.text[:-1]
    low[1:] = np.where(same, np.minimum(s.low[:-1], low[1:]), low[1:])
    high[:-1] = np.where(same, np.maximum(s.high[1:], high[:-1]), high[:-1])
    return low, high


def _runs(s: Symbols) -> Symbols:
    if not len(s.name):
        return s
    new = np.ones(len(s.name), bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s.name)) - 1
    length = last - first + 1
    before, after = _neighbours(s)
    low = np.minimum(np.minimum.reduceat(s.low, first), before[first])
    high = np.maximum(np.maximum.reduceat(s.high, first), after[last])
    name = s.name[first].copy()
    run = length > 1
    name[run] = mix(name[run] * np.uint64(31) + length[run].astype(np.uint64))
    return _joined(s, first, name, low, high)


def _pairs(s: Symbols, salt: int) -> Symbols:
    if not len(s.name):
        return s
    left = (mix(s.name + np.uint64(salt + 1)) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(s.name), bool)  # the symbol opens a pair
    pair[:-1] = left[:-1] & ~left[1:] & (s.text[1:] == s.text[:-1])
    second = np.zeros(len(s.name), bool)
    second[1:] = pair[:-1]
    first = np.flatnonzero(~second)
    before, after = _neighbours(s)
    opened = pair[first]
    follower = np.minimum(first + 1, len(s.name) - 1)
    # A symbol that stays single was decided by the neighbour it might have joined.
    low = np.where(opened, np.minimum(s.low[first], s.low[follower]), np.where(left[first], s.low[first], np.minimum(s.low[first], before[first])))
    high = np.where(opened, np.maximum(s.high[first], s.high[follower]), np.where(left[first], np.maximum(s.high[first], after[first]), s.high[first]))
    name = s.name[first].copy()
    name[opened] = mix(name[opened] * np.uint64(0x9E3779B97F4A7C15) + s.name[follower][opened])
    return _joined(s, first, name, low, high)


def anchors(
    s: Symbols, windows: np.ndarray, at: np.ndarray, width: int, phrase: int
) -> np.ndarray:
    """For each window of ``width`` words that begins at ``at``: the name of one phrase of
    ``phrase`` symbols which any equal window has too, or the window's own hash where
    no phrase is decided inside it.  Of several phrases the one of least hash.
    """
    out = windows.copy()
    n = len(s.name) - phrase + 1
    if n <= 0 or not len(at):
        return out
    name = np.zeros(n, np.uint64)
    low, high = s.low[:n].copy(), s.high[:n].copy()
    for k in range(phrase):
        name = name * np.uint64(0x9E3779B97F4A7C15) + s.name[k : k + n]
        low = np.minimum(low, s.low[k : k + n])
        high = np.maximum(high, s.high[k : k + n])
    name = mix(name)
    best = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    # All symbols that begin in the window: at most one a word.
    first = np.searchsorted(s.start, at)
    for k in range(width):
        i = np.minimum(first + k, n - 1)
        fits = (first + k < n) & (low[i] >= at) & (high[i] <= at + width)
        best = np.where(fits & (name[i] < best), name[i], best)
    found = best != np.iinfo(np.uint64).max
    out[found] = best[found]
    return out
