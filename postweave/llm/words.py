"""Words of whole Arrow text columns, as arrays.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``.  Every such
byte is below 128, so cutting UTF-8 bytes cuts whole code points.  A batch is
handled as one byte buffer: no Python statement runs per word or per document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: An odd base for the hashes of a few words in turn.
_BASE = 0x9E3779B97F4A7C15
_PLACE, _SIZE = np.uint64(0xD1342543DE82EF95), np.uint64(0xA24BAED4963EE407)
#: What of eight bytes stays when 0 to 8 of them belong to a span.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and the ``n + 1`` offsets of a text column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of a batch: byte spans, hashes, and where each document begins."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1: words of document i are first[i] .. first[i + 1]

    @cached_property
    def hash(self) -> np.ndarray:
        return _hashes(self.data, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Cut a text column into words; ``lower`` folds A-Z first."""
    data, offsets = raw(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SEPARATOR[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A document's first byte begins a word even when the one before it is another's.
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, first)


#: Bytes hashed at once; a longer word is hashed alone.
_BLOCK = 1 << 19


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span; spans are in order.  It does not depend on the span's place, so
    blocks of spans are hashed one after the other in little memory.

    Eight bytes at a time are spread together with their number in the span and added up.
    Unlike a polynomial, that has no regular words which agree by construction.
    """
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        first = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, first + _BLOCK, side="right")))
        out[at:to] = _block_hashes(data[first : int(end[to - 1])], start[at:to] - first, end[at:to] - first)
        at = to
    return out


def _block_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    out = mix((eights[start] & _MASKS[np.minimum(size, 8)]) + _PLACE)
    long = np.flatnonzero(size > 8)
    if len(long):
        pieces = (size[long] - 1) >> 3
        begins = np.cumsum(pieces) - pieces
        number = np.arange(int(pieces.sum())) - np.repeat(begins, pieces) + 1
        place = np.repeat(start[long], pieces) + 8 * number
        inside = np.minimum(np.repeat(end[long], pieces) - place, 8)
        spread = mix((eights[place] & _MASKS[inside]) + (number + 1).astype(np.uint64) * _PLACE)
        out[long] += np.add.reduceat(spread, begins)
    return mix(out + size.astype(np.uint64) * _SIZE)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hashes of all ``width`` consecutive words (across documents too:
    callers leave out those that cross an edge)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(_BASE)
        out += hashes[i : i + n]
    return mix(out)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Positions where a window of ``width`` words lies inside one document."""
    n = int(first[-1])
    inside = np.zeros(n + 1, np.int64)
    counts = np.diff(first)
    long = counts >= width
    np.add.at(inside, first[:-1][long], 1)
    np.add.at(inside, first[1:][long] - width + 1, -1)
    return np.flatnonzero(np.cumsum(inside)[:n] > 0)
