"""Sets of word shingles and their min-hash signatures, for whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from postweave.llm.words import mix, window_starts, windows, words

WIDTH = 5


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the ``n + 1`` edges.

    Words are folded A-Z.  A text of fewer than ``width`` words is one shingle,
    one without words has none.
    """
    w = words(texts, lower=True)
    at = window_starts(w.first, width)
    hashes = windows(w.hash, width)[at] if len(at) else np.zeros(0, np.uint64)
    owner = w.owner[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            has = w.counts[short] > i
            whole[has] = mix(whole[has] + w.hash[w.first[short[has]] + i]) + np.uint64(i + 1)
        hashes = np.concatenate([hashes, mix(whole)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, edges: np.ndarray, slots: int) -> np.ndarray:
    """``slots`` min-hashes of 16 bits for each set that is not empty."""
    begins = edges[:-1][np.diff(edges) > 0]
    out = np.empty((len(begins), slots), np.uint16)
    seeds = mix(np.arange(1, 2 * slots + 1, dtype=np.uint64))
    for k in range(slots):
        least = np.minimum.reduceat((hashes ^ seeds[k]) * (seeds[slots + k] | np.uint64(1)), begins)
        out[:, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out
