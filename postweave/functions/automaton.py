"""Phrases found in whole Arrow text columns by an automaton in flat arrays.

A ``PhraseTable`` is a prefix tree over the bytes of its keys: one sorted array of edges
``node * 256 + byte``, whose ``k``-th entry leads to node ``k + 1``.  A key that no other key
shares a prefix with any more ends in a leaf, and its rest is compared in one piece, so the
tree has a few nodes a key however long keys are.  All start positions of a batch walk
the tree together, one array operation per byte of depth.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column, end to end, and the ``n + 1`` offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start .. start + length - 1`` of all spans, end to end."""
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    return np.arange(total) + np.repeat(starts - (stops - lengths), lengths)


@dataclass
class PhraseTable:
    """Keys in sorted order, with a rank each (of several at one place the least counts) and a value."""

    edges: np.ndarray  # node * 256 + byte, sorted
    end: np.ndarray  # per node: the key that ends there, or -1
    leaf: np.ndarray  # per node: the one key that goes on below it, or -1
    key_data: np.ndarray
    key_start: np.ndarray
    key_rank: np.ndarray
    value_data: np.ndarray
    value_start: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in vars(self).values())

    @classmethod
    def build(cls, keys: pa.Array, values: pa.Array, ranks: np.ndarray) -> "PhraseTable":
        """Of distinct keys, none of them empty."""
        order = pc.array_sort_indices(keys.cast(pa.large_binary()))
        data, start = text_buffer(keys.take(order))
        value_data, value_start = text_buffer(values.take(order))
        ranks = np.asarray(ranks, np.int64)[order.to_numpy()]
        n = len(ranks)
        length = np.diff(start)
        node, alive = np.zeros(n, np.int64), np.arange(n)
        edges, ended, leaves, nodes, depth = [], [], [], 1, 0
        while len(alive):
            byte = data[start[alive] + depth]
            step = node[alive] * 256 + byte
            new = np.ones(len(alive), bool)
            new[1:] = step[1:] != step[:-1]
            edges.append(step[new])
            child = nodes - 1 + np.cumsum(new)
            node[alive] = child
            nodes += len(edges[-1])
            alone = new & np.append(new[1:], True)
            leaves.append((child[alone], alive[alone]))
            alive, depth = alive[~alone], depth + 1
            done = length[alive] == depth
            ended.append((node[alive[done]], alive[done]))
            alive = alive[~done]
        end, leaf = np.full(nodes, -1, np.int32), np.full(nodes, -1, np.int32)
        for at, key in ended:
            end[at] = key
        for at, key in leaves:
            leaf[at] = key
        joined = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        return cls(joined, end, leaf, data, start, ranks, value_data, value_start)

    def best(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where keys begin, and of those at each the one of least rank, the shorter of equals.

        ``stops[i]`` is where the text of place ``i`` ends.
        """
        root = np.zeros(256, np.int64)
        top = self.edges[: np.searchsorted(self.edges, 256)]
        root[top] = np.arange(1, len(top) + 1)
        at = np.flatnonzero(root[data])
        node, found = root[data[at]], []
        depth = 1
        while len(at):
            ends = self.end[node] >= 0
            found.append((at[ends], self.end[node[ends]]))
            key = self.leaf[node]
            single = key >= 0
            found.append(self._rests(data, stops, at[single], key[single], depth))
            at, node = at[~single], node[~single]
            on = at + depth < stops[at]
            at, node = at[on], node[on]
            step = node * 256 + data[at + depth]
            place = np.minimum(np.searchsorted(self.edges, step), max(len(self.edges) - 1, 0))
            on = self.edges[place] == step if len(self.edges) else np.zeros(0, bool)
            at, node, depth = at[on], place[on] + 1, depth + 1
        at, key = (np.concatenate(c) for c in zip(*found)) if found else (at, np.zeros(0, np.int32))
        # Found by depth, and the sort is stable: shorter keys come first.
        order = np.lexsort((self.key_rank[key], at))
        at, key = at[order], key[order]
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        return at[first], key[first].astype(np.int64)

    def _rests(self, data, stops, at, key, depth) -> tuple[np.ndarray, np.ndarray]:
        """Of places that have come to a leaf, those where the rest of its key follows."""
        length = self.key_start[key + 1] - self.key_start[key]
        fits = at + length <= stops[at]
        at, key, rest = at[fits], key[fits], length[fits] - depth
        same = data[spans_index(at + depth, rest)] == self.key_data[spans_index(self.key_start[key] + depth, rest)]
        wrong = np.concatenate([[0], np.cumsum(~same)])
        edge = np.concatenate([[0], np.cumsum(rest)])
        good = wrong[edge[1:]] == wrong[edge[:-1]]
        return at[good], key[good]


def leftmost(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of matches in order of place, those that stand when each takes its bytes from left to right."""
    following = np.searchsorted(at, at + length).tolist()
    taken, i = [], 0
    while i < len(following):
        taken.append(i)
        i = following[i]
    return np.array(taken, np.int64)


def replaced(data, offsets, at, length, values, value_start, value_length) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``data[at:at + length]`` replaced by spans of ``values``; bytes and offsets."""
    begin = np.concatenate([[0], at + length])
    gap = np.append(at, len(data)) - begin
    starts, lengths = np.empty(2 * len(at) + 1, np.int64), np.empty(2 * len(at) + 1, np.int64)
    starts[0::2], lengths[0::2] = begin, gap
    starts[1::2], lengths[1::2] = value_start + len(data), value_length
    out = np.concatenate([data, values])[spans_index(starts, lengths)]
    grown = np.concatenate([[0], np.cumsum(value_length - length)])
    return out, offsets + grown[np.searchsorted(at, offsets)]
