"""A hierarchical navigable small-world graph over one shard, in flat neighbour arrays.

Nodes are inserted in blocks and searched in blocks: every numpy statement serves all
queries of a block at once.  Nearness is the inner product; vectors get one more
component that makes all of them equally long, so the nearest by inner product are the
nearest in space and the graph is a proper one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS = 16
BUILD_WIDTH, SEARCH_WIDTH = 80, 160
BLOCK = 256
#: Nodes that a query opens at once.
OPENED = 4


@dataclass
class Graph:
    """``vectors`` (n, d + 1); per level the ``nodes`` on it and their ``neighbours``, rows of
    node numbers padded with -1.  Level 0 holds all nodes."""

    vectors: np.ndarray
    nodes: list[np.ndarray]
    neighbours: list[np.ndarray]


def lengthened(x: np.ndarray) -> np.ndarray:
    square = np.square(x, dtype=np.float64).sum(1)
    rest = np.sqrt(np.maximum(square.max(initial=0) - square, 0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def build(x: np.ndarray, seed: int = 1) -> Graph:
    """Insert all rows of ``x``, which should be distinct, from the top level down."""
    vectors, n = lengthened(x), len(x)
    level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
    nodes, neighbours = [], []
    for at in range(int(level.max(initial=0)), -1, -1):
        here = np.flatnonzero(level >= at)
        if at and len(here) < 2 * LINKS:
            continue
        # Nodes of upper levels go in first: they are the long ways through the level.
        here = here[np.argsort(-level[here], kind="stable")]
        graph = _level(vectors[here], 2 * LINKS if at == 0 else LINKS)
        nodes.insert(0, here)
        neighbours.insert(0, graph)
    # Level 0 in the order of the rows.
    if nodes:
        order, links = nodes[0], neighbours[0]
        flat = np.where(links >= 0, order[links], -1)
        out = np.empty_like(flat)
        out[order] = flat
        nodes[0], neighbours[0] = np.arange(n), out.astype(np.int32)
    return Graph(vectors, nodes, neighbours)


def _level(x: np.ndarray, width: int) -> np.ndarray:
    """Neighbours of one level, by inserting its nodes block by block."""
    n = len(x)
    links = np.full((n, width), -1, np.int32)
    done = 0
    while done < n:
        block = np.arange(done, min(n, done + max(LINKS, min(done, BLOCK))))
        inner = x[block] @ x[block].T
        np.fill_diagonal(inner, -np.inf)
        inner[np.triu_indices(len(block))] = -np.inf
        take = min(len(block), LINKS)
        best = np.argpartition(-inner, take - 1, axis=1)[:, :take]
        near = np.take_along_axis(inner, best, 1)
        ids = np.where(np.isfinite(near), block[best], -1)
        if done:
            entries = np.zeros((len(block), 1), np.int64)
            found, sims = beam(x, links[:done], x[block], entries, BUILD_WIDTH)
            ids, near = np.concatenate([found, ids], 1), np.concatenate([sims, near], 1)
        chosen = _diverse(x, ids, near, LINKS)
        links[block, : chosen.shape[1]] = chosen
        _link_back(x, links, block, chosen)
        done = int(block[-1]) + 1
    return links


def _diverse(x: np.ndarray, ids: np.ndarray, near: np.ndarray, many: int) -> np.ndarray:
    """Of each row's candidates up to ``many``: those nearer to the row than to any chosen
    before them, then the nearest of the rest."""
    order = np.argsort(-np.where(ids >= 0, near, -np.inf), axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    valid = (ids >= 0) & np.isfinite(near)
    points = x[np.maximum(ids, 0)]
    between = points @ points.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    for i in range(ids.shape[1]):
        hidden = (chosen[:, :i] & (between[:, i, :i] > near[:, i : i + 1])).any(1)
        chosen[:, i] = valid[:, i] & ~hidden & (chosen[:, :i].sum(1) < many)
    rank = np.where(chosen, 0, np.where(valid, 1, 2))
    first = np.argsort(rank, axis=1, kind="stable")[:, :many]
    return np.where(np.take_along_axis(rank, first, 1) < 2, np.take_along_axis(ids, first, 1), -1).astype(np.int32)


def _link_back(x: np.ndarray, links: np.ndarray, block: np.ndarray, chosen: np.ndarray) -> None:
    """Let the chosen neighbours know the new nodes; a full row keeps a diverse choice."""
    width = links.shape[1]
    to, new = chosen.ravel(), np.repeat(block, chosen.shape[1])
    to, new = to[to >= 0], new[to >= 0]
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    nodes, first, many = np.unique(to, return_index=True, return_counts=True)
    if not len(nodes):
        return
    wide = np.full((len(nodes), int(many.max())), -1, np.int32)
    wide[np.repeat(np.arange(len(nodes)), many), np.arange(len(to)) - np.repeat(first, many)] = new
    every = np.concatenate([links[nodes], wide], axis=1)
    free = (every >= 0).sum(1) <= width
    packed = np.take_along_axis(every[free], np.argsort(every[free] < 0, axis=1, kind="stable"), 1)
    links[nodes[free]] = packed[:, :width]
    full = np.flatnonzero(~free)
    for at in range(0, len(full), 1024):
        some = full[at : at + 1024]
        ids = every[some]
        used = int((ids >= 0).sum(1).max())
        ids = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)[:, :used]
        near = np.einsum("nd,nkd->nk", x[nodes[some]], x[np.maximum(ids, 0)])
        links[nodes[some]] = _diverse(x, ids, np.where(ids >= 0, near, -np.inf), width)


def beam(
    x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all ``queries`` side by side: ``(ids, nearness)``, best first,
    padded with -1."""
    q, n = len(queries), len(links)
    rows = np.arange(q)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # where the padding goes
    ids = np.full((q, width), -1, np.int64)
    near = np.full((q, width), -np.inf, np.float32)
    opened = np.zeros((q, width), bool)
    k = entries.shape[1]
    ids[:, :k] = entries
    near[:, :k] = np.einsum("qd,qkd->qk", queries, x[entries])
    seen[rows[:, None], entries] = True
    while len(rows):
        # The best nodes not opened yet, of the queries that still have one.
        waiting = np.where(opened | (ids < 0), -np.inf, near)
        pick = np.argpartition(-waiting, OPENED - 1, axis=1)[:, :OPENED]
        live = np.isfinite(np.take_along_axis(waiting, pick, 1))
        active = live.any(1)
        if not active.any():
            break
        pick, live, at = pick[active], live[active], np.flatnonzero(active)
        opened[at[:, None], pick] = True
        next_ = np.where(live[:, :, None], links[np.maximum(ids[at[:, None], pick], 0)], -1).reshape(len(at), -1)
        next_ = np.where(next_ < 0, n, next_)
        next_.sort(axis=1)
        fresh = ~seen[at[:, None], next_]
        fresh[:, 1:] &= next_[:, 1:] != next_[:, :-1]
        seen[at[:, None], next_] = True
        sims = np.full(next_.shape, -np.inf, np.float32)
        who, which = np.nonzero(fresh)
        target = next_[who, which]
        sims[who, which] = np.einsum("nd,nd->n", queries[at[who]], x[target])
        all_near = np.concatenate([near[at], sims], 1)
        all_ids = np.concatenate([ids[at], np.where(fresh, next_, -1)], 1)
        all_open = np.concatenate([opened[at], ~fresh], 1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        ids[at] = np.take_along_axis(all_ids, best, 1)
        near[at] = np.take_along_axis(all_near, best, 1)
        opened[at] = np.take_along_axis(all_open, best, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.where(np.isfinite(np.take_along_axis(near, order, 1)), np.take_along_axis(ids, order, 1), -1), np.take_along_axis(near, order, 1)


def search(graph: Graph, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
    """Row numbers of up to ``width`` near vectors for each query, best first, padded with -1."""
    queries = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    out = []
    for at in range(0, len(queries), BLOCK):
        some = queries[at : at + BLOCK]
        entry = np.zeros((len(some), 1), np.int64)
        if len(graph.nodes) > 1:
            entry[:] = graph.nodes[-1][0]
        for nodes, links in reversed(list(zip(graph.nodes[1:], graph.neighbours[1:]))):
            # A node of the level above is on this level too; it may stand elsewhere in it.
            place = np.full(len(graph.vectors), 0, np.int64)
            place[nodes] = np.arange(len(nodes))
            found, _ = beam(graph.vectors[nodes], links, some, place[entry], 2 * OPENED)
            entry = nodes[np.maximum(found[:, :1], 0)]
        out.append(beam(graph.vectors, graph.neighbours[0], some, entry, width)[0])
    return np.concatenate(out) if out else np.zeros((0, width), np.int64)
