"""Periodic runs of words in whole texts, and texts without the repeats, by descending LCP.

A run is a stretch of words with a smallest period that no neighbouring word extends.
Suffixes of a text fall into classes that share a prefix; classes are united
by decreasing length of it (Kruskal's order over the edges of the suffix array),
with union-find over ordered sets of positions.  Two positions that become neighbours in
a united class at a distance of at most the shared prefix lie one period apart: the
period is smallest, since a smaller one would have put a third position between them,
and the shared prefix tells how far the run reaches.  The pair whose left position no
equal word extends is where the run begins, so every run is found once.

Texts are handled inside the row; nothing is shuffled.  A text in which no
sequence of half the least length is repeated has no run and is not sorted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import WORD_GAP, read_table, slices
from postweave.llm.exact_words import joined, word_ids
from postweave.llm.suffixes import common_prefixes, suffix_array
from postweave.llm.words import mix, window_starts, windows

#: Words of the shortest run.
LEAST = 12

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Positions:
    """An ordered set of numbers in chunks, so that no insertion moves more than one chunk."""

    CHUNK = 1024

    def __init__(self, value: int):
        self.size, self._chunks, self._last = 1, [[value]], [value]

    def __iter__(self) -> Iterator[int]:
        return (value for chunk in self._chunks for value in chunk)

    def around(self, value: int) -> tuple[int | None, int | None]:
        """The neighbours that a value not in the set would have."""
        c = bisect_left(self._last, value)
        if c == len(self._chunks):
            return self._last[-1], None
        chunk = self._chunks[c]
        k = bisect_left(chunk, value)
        if k:
            return chunk[k - 1], chunk[k]
        return (self._last[c - 1] if c else None), chunk[0]

    def add(self, value: int) -> None:
        c = min(bisect_left(self._last, value), len(self._chunks) - 1)
        chunk = self._chunks[c]
        chunk.insert(bisect_left(chunk, value), value)
        self._last[c] = chunk[-1]
        self.size += 1
        if len(chunk) > 2 * self.CHUNK:
            self._chunks[c : c + 1] = [chunk[: self.CHUNK], chunk[self.CHUNK :]]
            self._last[c : c + 1] = [chunk[self.CHUNK - 1], chunk[-1]]


def _united(one: Positions, other: Positions) -> tuple[Positions, list[tuple[int, int]]]:
    """The smaller set put into the larger, and the pairs that are neighbours only now."""
    small, large = sorted((one, other), key=lambda p: p.size)
    values, pairs = list(small), []
    for k, value in enumerate(values):
        left, right = large.around(value)
        if left is not None and (not k or values[k - 1] < left):
            pairs.append((left, value))
        if right is not None and (k + 1 == len(values) or values[k + 1] > right):
            pairs.append((value, right))
    for value in values:
        large.add(value)
    return large, pairs


def _kruskal(positions: list[int], shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """``i, j, prefix``: neighbours in a class of suffixes at the longest prefix they share.

    ``positions`` are in suffix order, ``shared[r]`` is what ``r - 1`` and ``r`` share.
    """
    parent = list(range(len(positions)))
    sets: list[Positions | None] = [Positions(p) for p in positions]

    def root(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    for r in sorted(range(1, len(positions)), key=lambda r: -shared[r]):
        a, b = root(r - 1), root(r)
        keep, drop = (a, b) if sets[a].size >= sets[b].size else (b, a)
        sets[keep], pairs = _united(sets[a], sets[b])
        sets[drop], parent[drop] = None, keep
        for i, j in pairs:
            yield i, j, shared[r]


def _repeating(ids: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Documents in which some sequence of ``width`` words may occur twice (hashes: none is missed)."""
    at = window_starts(first, width)
    if not len(at):
        return at
    owner = np.searchsorted(first, at, side="right") - 1
    keys = mix(windows(mix(ids.astype(np.uint64)), width)[at] + mix(owner.astype(np.uint64)))
    order = np.argsort(keys)
    again = keys[order[1:]] == keys[order[:-1]]
    return np.unique(owner[order[1:][again]])


def maximal_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows ``document, start, length, period`` of all runs, sorted, of documents whose words
    are ``ids[first[d]:first[d + 1]]``."""
    need = max(1, -(-least // 2))
    docs = _repeating(ids, first, need)
    if not len(docs):
        return np.zeros((0, 4), np.int64)
    sizes = first[docs + 1] - first[docs]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    local = np.repeat(np.arange(len(docs)), sizes)
    spot = np.arange(int(begins[-1])) - begins[local]
    # Ids of different documents differ, so no shared prefix leaves its document.
    symbols = local * (int(ids.max()) + 1) + ids[first[docs][local] + spot]
    order = suffix_array(symbols)
    shared = common_prefixes(symbols, order)
    klass = np.cumsum(shared < need)
    size = np.bincount(klass)
    rows = np.flatnonzero(size[klass] > 1)
    found = []
    for a, b in _worth_uniting(order, shared, klass, rows, symbols):
        for i, j, prefix in _kruskal(order[a:b].tolist(), shared[a:b].tolist()):
            if j - i <= prefix and j - i + prefix >= least and (i == 0 or symbols[i - 1] != symbols[j - 1]):
                found.append((local[i], spot[i], j - i + prefix, j - i))
    out = np.array(found, np.int64).reshape(-1, 4)
    out[:, 0] = docs[out[:, 0]]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _worth_uniting(order, shared, klass, rows, symbols) -> Iterator[tuple[int, int]]:
    """Rows ``a:b`` of the classes where a run can begin: some positions are as near as
    the longest prefix, and not all of them follow the same word."""
    if not len(rows):
        return
    edges = np.flatnonzero(np.append(True, klass[rows][1:] != klass[rows][:-1]))
    ends = np.append(edges[1:], len(rows))
    inner = np.where(klass[rows] == np.append(-1, klass[rows][:-1]), shared[rows], 0)
    longest = np.maximum.reduceat(inner, edges)
    place = np.sort(klass[rows] * len(order) + order[rows])
    gap = np.append(len(order), np.diff(place))
    gap[edges] = len(order)
    nearest = np.minimum.reduceat(gap, edges)
    before = np.where(order[rows] > 0, symbols[np.maximum(order[rows] - 1, 0)], -1)
    varied = np.minimum.reduceat(before, edges) != np.maximum.reduceat(before, edges)
    for k in np.flatnonzero((nearest <= longest) & varied):
        yield int(rows[edges[k]]), int(rows[ends[k] - 1]) + 1


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    ``runs``: ``start, length, period`` of each run of at least ``least`` words and two
    periods, by start and period.  ``collapsed``: the words that no run contains after its
    first period, joined by one space.

    Null and empty texts have no words and no runs.  Repeated rows are handled alike,
    each by itself; the id is only passed on, null or not.  A very long text is handled
    whole, in memory in proportion to its length.  Other columns are not read; an empty table
    gives no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = word_ids(part.column(1))
                runs = maximal_runs(w.ids, w.first, least)
                cover = np.zeros(len(w.ids) + 1, np.int64)
                at = w.first[runs[:, 0]] + runs[:, 1]
                np.add.at(cover, at + runs[:, 3], 1)
                np.add.at(cover, at + runs[:, 2], -1)
                edges = np.searchsorted(runs[:, 0], np.arange(len(w.first)))
                values = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(w.first)),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values),
                        joined(w, np.cumsum(cover[:-1]) == 0),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts, by id, with a period from some word on; the others as they are."""
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    parts = F.struct(words.alias("words"), F.size(words).cast("long").alias("n"), F.floor(h / 10).alias("g"))

    def repeat(p: Column) -> Column:
        a = p["g"] % p["n"]
        period = F.lit(1) + F.floor((p["n"] - a) / (F.lit(3) + p["g"] % 8))
        again = F.transform(
            p["words"], lambda w, i: F.when(i < a, w).otherwise(F.get(p["words"], (a + (i - a) % period).cast("int")))
        )
        return F.array_join(again, " ")

    made = F.transform(F.array(parts), lambda p: F.when(p["n"] > 0, repeat(p)).otherwise(text))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(ranked)
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
