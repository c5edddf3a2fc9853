"""Words of Arrow text columns with exact ids, and texts put together from kept words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from postweave.llm.words import raw

_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


@dataclass
class WordIds:
    """Byte spans of words, an id of each (equal ids: equal bytes), and the ``n + 1`` edges of
    the documents among the words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ids: np.ndarray
    first: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_ids(texts: pa.Array) -> WordIds:
    """Words of a batch of texts; ids come from a dictionary of the words themselves."""
    data, offsets = raw(texts)
    inside = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # Words end to end, without what is between them, are an Arrow column as they stand.
    stops = np.concatenate([[0], np.cumsum(end - start)])
    column = pa.Array.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(data[inside])]
    )
    ids = column.dictionary_encode().indices.to_numpy().astype(np.int64)
    return WordIds(data, start, end, ids, np.searchsorted(start, offsets))


def joined(w: WordIds, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, with one space between them."""
    n = len(w.first) - 1
    owner, start, size = w.owner[keep], w.start[keep], (w.end - w.start)[keep] + 1
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    source = np.arange(total) + np.repeat(start - (stop - size), size)
    # One byte after each word is a space; the one after a document's last word goes.
    out = np.append(w.data, np.uint8(32))[source] if total else np.zeros(0, np.uint8)
    out[stop - 1] = 32
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    stay = np.ones(total, bool)
    stay[stop[last] - 1] = False
    lengths = np.bincount(owner, size, minlength=n).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(lengths - 1, 0))]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out[stay])])
    return texts.cast(pa.string()) if offsets[-1] < 1 << 31 else texts
