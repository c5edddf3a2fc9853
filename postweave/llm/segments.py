"""Encode texts by their distinct segments.

A segment is a stretch of text between two places where a tokenizer provably
cuts, so the ids of a text are the ids of its segments in turn.  Equal segments
are encoded once, which matters because a text's words repeat.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from postweave.llm.words import raw, words

#: Distinct segments kept per Python worker before the memory of them starts anew.
MEMORY = 800_000
#: Their bytes, too: a text without white space is one segment.
MEMORY_BYTES = 32 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13, 28, 29, 30, 31]] = True
# Lead bytes of characters among which are white space beyond ASCII.
_SPACE_LEAD = np.zeros(256, bool)
_SPACE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def before_single_spaces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut before each lone space that stands between two visible characters.

    A byte-level pattern gives a space to the word after it, and no word holds
    white space: such a place is always an edge of its pieces.  Next to a
    character that might be wide white space nothing is cut.
    """
    data, offsets = raw(texts)
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        space = np.flatnonzero(data[1:-1] == 32) + 1
        before, after = data[space - 1], data[space + 1]
        # Before: ASCII, or a two-byte letter whose lead byte is C3.
        safe = ~_SEPARATOR[before] & ~_SEPARATOR[after] & ~_SPACE_LEAD[after]
        safe &= (before < 128) | ((space > 1) & (data[space - 2] == 0xC3))
        cut[space[safe]] = True
    cut[offsets[:-1]] = True
    cut[n] = False
    start = np.flatnonzero(cut[:n])
    # Empty texts begin nothing of their own.
    first = np.searchsorted(start, offsets)
    end = np.append(start[1:], n) if len(start) else start
    return data, start, end, first


def at_white_space(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut at ASCII white space and leave it out: for tokenizers that drop it."""
    w = words(texts)
    return w.data, w.start, w.end, w.first


@lru_cache(maxsize=2)
def _ranked(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
    )


class Encoder:
    """Ids of segments, remembered between batches of one worker.

    ``ranks`` names the same vocabulary as a rank file.  Its reader merges by the
    same order in half the time; segments that may hold a special token's string
    (``<|``) always go to the tokenizer itself.
    """

    def __init__(self, path: str, ids: bool, ranks: str | None = None):
        self._path, self._keep, self._ranks = path, ids, ranks
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._bytes = 0
        self._counts = np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.uint32)

    def _learn(self, texts: list[str]) -> None:
        model, counts, found = tokenizer(self._path), [], [self._flat]
        ranked = _ranked(self._ranks).encode_ordinary if self._ranks else None
        for i in range(0, len(texts), 20_000):
            some = texts[i : i + 20_000]
            if ranked:
                ids = [
                    ranked(t) if "<|" not in t else model.encode(t, add_special_tokens=False).ids
                    for t in some
                ]
            else:
                ids = model.encode_batch_fast(some, add_special_tokens=False)
                ids = [e.ids for e in ids] if self._keep else ids
            counts.extend(map(len, ids))
            if self._keep:
                found.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        self._counts = np.concatenate([self._counts, np.asarray(counts, np.int64)])
        self._flat = np.concatenate(found)

    def encode(self, cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per segment the number of ids, per text its first segment, and all ids in turn."""
        data, start, end, first = cut
        codes, found = _distinct(data, start, end)
        if len(self._known) > MEMORY or self._bytes > MEMORY_BYTES:
            self._forget()
        fresh = [s for s in found if s not in self._known]
        if fresh:
            self._learn([s.decode("utf-8", "replace") for s in fresh])
            self._known.update(zip(fresh, range(len(self._counts) - len(fresh), len(self._counts))))
            self._bytes += sum(map(len, fresh))
        which = np.fromiter(map(self._known.__getitem__, found), np.int64, len(found))[codes]
        sizes = self._counts[which]
        if not self._keep:
            return sizes, first, np.zeros(0, np.uint32)
        begins = np.cumsum(self._counts) - self._counts
        total = np.cumsum(sizes)
        n = int(total[-1]) if len(total) else 0
        ids = self._flat[np.repeat(begins[which] - (total - sizes), sizes) + np.arange(n)]
        return sizes, first, ids


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of each span its place among the distinct ones, and these as bytes."""
    size = end - start
    edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    if len(start) and (start[1:] == end[:-1]).all():
        joined = data[start[0] : end[-1]]
    else:
        # What is between the spans is left out.
        step = np.zeros(len(data) + 1, np.int8)
        step[start] += 1
        step[end] -= 1
        joined = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    buffers = [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(joined))]
    spans = pa.Array.from_buffers(pa.large_binary(), len(start), buffers).dictionary_encode()
    return spans.indices.to_numpy(), spans.dictionary.to_pylist()


@lru_cache(maxsize=4)
def encoder(path: str, ids: bool, ranks: str | None = None) -> Encoder:
    return Encoder(path, ids, ranks)


def per_text(sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of segment sizes per text."""
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[first])
