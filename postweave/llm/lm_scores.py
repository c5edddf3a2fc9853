"""Language-model scores from a log-bilinear neural model.

Words are counted over all training documents.  The most frequent words are classes of
their own, other words share a class by their first two bytes, and the text's end is a
class.  Every word with a count of at least ``tokens / HEAD``, and of two at least, is a
symbol of the network: it has its own vector as context, and inside its class it is a
leaf of a binary tree whose turns depend on the context.  The rarer words of a class are
one more leaf, the rest, and have their smoothed share of its counts.  A log-bilinear
network predicts after the three symbols before:

    P(word | context) = P(class | context) * P(leaf | class, context) * share
    share = (c + 1) / (N_rest + V_rest + 1)

with the second factor only for shared classes and the third only for their rests; all
words of a class plus one unseen sum to one.

The classes are trained by noise-contrastive estimation and the turns by their
likelihood, on every training token.  Texts are dealt to shares by their content, as many
shares as the tokens make; a share starts from the same weights as any other and passes
once over its texts, in the order of their hashes.  The weights of all shares are averaged,
those of a symbol or turn by how often a share has met it, all others by tokens.  So the
layout of the input has no part in a score.  Scoring normalises exactly: the classes by
products of whole blocks of contexts with all classes, the turns because two of them
sum to one.

Counts of the most frequent words, at most ``HEAD`` of them, are looked up in the task; all
others are joined.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import fold, read_table, slices, small_batches, written
from postweave.llm.words import Words, mix, words

FOLDS, HELD_OUT = 7, 2
FREQUENT, SHARED = 127, 64
CLASSES = FREQUENT + SHARED + 1
END = CLASSES - 1
CONTEXT, WIDTH = 3, 16
#: So many words are looked up in the task; those of a count of at least N / HEAD are symbols.
HEAD = 500_000
BATCH, NOISE, RATE = 2048, 64, 0.15
#: Exponents up to this are safe in single precision, over all classes.
EXPONENT = 60
#: Training tokens of one share, about: enough to learn from, whatever the input's files are.
SHARE_TOKENS = 1 << 23
#: Equal contexts with equal targets of a batch count as one row, up to this many.
ALIKE = 16
#: Rows of weights that are averaged at once.
BLOCK = 256
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 1_000_000

#: Stands for the end of a text among word hashes.
END_WORD = np.uint64(0x45F7A1D93C0B2E61)


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its place among the distinct ones; their hashes and shared classes."""
    codes, found = pd.factorize(w.hash)
    if not len(codes):
        return codes, found, np.zeros(0, np.int64)
    one = np.empty(len(found), np.int64)
    one[codes] = np.arange(len(codes))
    first = w.data[w.start[one]].astype(np.uint64)
    second = w.data[np.minimum(w.start[one] + 1, len(w.data) - 1)].astype(np.uint64)
    second = np.where(w.end[one] - w.start[one] > 1, second, 0).astype(np.uint64)
    return codes, found, FREQUENT + (mix(first * np.uint64(256) + second) % np.uint64(SHARED)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, class, n``: words of all texts by hash, A-Z folded, and the texts' ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                codes, found, classes = distinct(words(part.column(0), lower=True))
                ends = (np.array([END_WORD]), np.array([END]), np.array([part.num_rows]))
                held += [(found, classes, np.bincount(codes, minlength=len(found))), ends]
                if sum(len(h[0]) for h in held) > HELD_WORDS:
                    held = [_summed(held)]
                    if len(held[0][0]) > HELD_WORDS // 2:
                        yield _counts(held.pop())
        if held:
            yield _counts(_summed(held))

    counted = docs.select("text").mapInArrow(count, "word long, class int, n long")
    return counted.groupBy("word", "class").agg(F.sum("n").alias("n"))


def _summed(held):
    keys, classes, n = (np.concatenate(x) for x in zip(*held))
    codes, found = pd.factorize(keys)
    out = np.empty(len(found), np.int64)
    out[codes] = classes
    return found, out, np.bincount(codes, n, len(found)).astype(np.int64)


def _counts(summed) -> pa.RecordBatch:
    keys, classes, n = summed
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(classes.astype(np.int32)), pa.array(n)], names=["word", "class", "n"]
    )


@dataclass
class Leaves:
    """The symbols as leaves of binary trees.  A symbol below ``CLASSES`` is a class, or the
    rest of a shared one; the others are words.  Symbol ``s`` is reached by the turns
    ``starts[s] .. starts[s + 1]`` of ``nodes`` and ``signs``."""

    outer: np.ndarray  # the class of each symbol
    starts: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray
    odds: np.ndarray  # of each node, by the counts below it

    def turns(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in ``symbols`` and the place in ``nodes`` of every turn."""
        first = self.starts[symbols]
        many = self.starts[symbols + 1] - first
        owner = np.repeat(np.arange(len(symbols)), many)
        ends = np.cumsum(many)
        return owner, np.arange(len(owner)) + np.repeat(first - ends + many, many)


def leaves(classes: np.ndarray, counts: np.ndarray, rests: np.ndarray) -> Leaves:
    """Huffman trees: one for each class that has words, over these and its rest."""
    symbols = CLASSES + len(classes)
    outer = np.append(np.arange(CLASSES), classes).astype(np.int64)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
    odds: list[float] = []
    by_class = np.argsort(classes, kind="stable")
    edges = np.searchsorted(classes[by_class], np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(edges)):
        own = by_class[edges[c] : edges[c + 1]]
        weights = [float(rests[c]) + 1, *counts[own].astype(float)]
        names = [int(c), *(own + CLASSES).tolist()]
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        up: list[tuple[int, int]] = [(-1, 0)] * (2 * len(names) - 1)
        for parent in range(len(names), len(up)):
            (x, left), (y, right) = heapq.heappop(heap), heapq.heappop(heap)
            up[left], up[right] = (parent, 1), (parent, -1)
            odds.append(float(np.log(x / y)))
            heapq.heappush(heap, (x + y, parent))
        shift = len(odds) - len(up)
        for k, name in enumerate(names):
            at = k
            while up[at][0] >= 0:
                at, sign = up[at]
                paths[name].append((at + shift, sign))
    starts = np.append(0, np.cumsum([len(p) for p in paths])).astype(np.int64)
    flat = np.array([t for p in paths for t in p], np.int64).reshape(-1, 2)
    return Leaves(outer, starts, flat[:, 0], flat[:, 1].astype(np.float32), np.array(odds, np.float32))


NO_WORDS = leaves(np.zeros(0, np.int64), np.zeros(0), np.zeros(CLASSES))


@dataclass
class Vocabulary:
    """Bounded facts about the counted words; arrays are sorted by word hash."""

    head: np.ndarray  # hashes
    head_counts: np.ndarray
    head_symbols: np.ndarray  # a word of the head that is no symbol has -1
    class_counts: np.ndarray  # N of each class
    rest_counts: np.ndarray  # N and V of the words of each class that are no symbols
    rest_words: np.ndarray
    leaves: Leaves
    tokens: int
    distinct: int

    def looked_up(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its place among the distinct ones; their hashes, symbols and counts,
        0 where the count is not at hand."""
        codes, found, symbols = distinct(w)
        if not len(self.head):
            return codes, found, symbols, np.zeros(len(found))
        at = np.minimum(np.searchsorted(self.head, found), len(self.head) - 1)
        here = self.head[at] == found
        own = np.where(here, self.head_symbols[at], -1)
        return codes, found, np.where(own >= 0, own, symbols), np.where(here, self.head_counts[at], 0)

    def symbols(self, w: Words) -> np.ndarray:
        codes, _, symbols, _ = self.looked_up(w)
        return symbols[codes]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From a written table of word counts."""
    totals = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    tokens, distinct = totals["tokens"] or 0, totals["distinct"]
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_counts, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in by_class:
        class_counts[row["class"]], class_words[row["class"]] = row["n"], row["v"]
    real = counts.where(F.col("class") != END)
    top = real.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    for k, row in enumerate(top):
        class_counts[row["class"]] -= row["n"]
        class_words[row["class"]] -= 1
        class_counts[k], class_words[k] = row["n"], 1
    # The lowest power of two that at most HEAD words reach; a count of N / HEAD always does.
    steps = [2**k for k in range(int(np.log2(max(1, tokens / HEAD))) + 1)]
    reached = real.agg(*(F.count_if(F.col("n") >= k).alias(str(k)) for k in steps)).first()
    least = min((k for k in steps if reached[str(k)] <= HEAD), default=tokens / HEAD)
    head = real.where(F.col("n") >= least).select("word", "class", "n").toArrow()
    words_ = head.column(0).to_numpy().view(np.uint64)
    by_hash = np.argsort(words_)
    words_, classes, n = (x[by_hash] for x in (words_, head.column(1).to_numpy().astype(np.int64), head.column(2).to_numpy()))
    symbols = np.full(len(words_), -1, np.int64)
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    top_at = np.minimum(np.searchsorted(words_, hashes), max(len(words_) - 1, 0))
    inside = words_[top_at] == hashes if len(words_) else np.zeros(len(hashes), bool)
    symbols[top_at[inside]] = np.flatnonzero(inside)
    own = np.flatnonzero((symbols < 0) & (n >= max(2, tokens / HEAD)))
    symbols[own] = CLASSES + np.arange(len(own))
    rest_counts = class_counts - np.bincount(classes[own], n[own], CLASSES)
    rest_words = class_words - np.bincount(classes[own], minlength=CLASSES)
    trees = leaves(classes[own], n[own], rest_counts)
    return Vocabulary(words_, n, symbols, class_counts, rest_counts, rest_words, trees, tokens, distinct)


@dataclass
class Model:
    """``seen`` (S, d) of context symbols, a map (d, d) per place before, ``said`` (K, d) and
    ``bias`` of predicted classes, ``turned`` (M, d + 1) of the trees' nodes, odds last."""

    seen: np.ndarray
    maps: np.ndarray
    said: np.ndarray
    bias: np.ndarray
    turned: np.ndarray
    leaves: Leaves

    @property
    def odds(self) -> np.ndarray:
        return self.turned[:, WIDTH]

    def tables(self) -> np.ndarray:
        return np.einsum("kd,jde->jke", self.seen, self.maps).astype(np.float32)

    def rows(self) -> np.ndarray:
        """All weights as rows of ``WIDTH + 1``: seen, turned, said, maps."""
        zeros = lambda x: np.zeros((len(x), 1), np.float32)
        flat = self.maps.reshape(-1, WIDTH)
        parts = [(self.seen, zeros(self.seen)), (self.turned,), (self.said, self.bias[:, None]), (flat, zeros(flat))]
        return np.concatenate([np.hstack(p) for p in parts])

    def with_rows(self, rows: np.ndarray) -> Model:
        seen, turned, said, maps = np.split(rows, np.cumsum([len(self.seen), len(self.turned), CLASSES]))
        maps = np.ascontiguousarray(maps[:, :WIDTH]).reshape(self.maps.shape)
        seen, words_ = (np.ascontiguousarray(x[:, :WIDTH]) for x in (seen, said))
        return Model(seen, maps, words_, said[:, WIDTH].copy(), np.ascontiguousarray(turned), self.leaves)


def new_model(shares: np.ndarray, trees: Leaves = NO_WORDS, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    seen = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
    maps = np.repeat(np.eye(WIDTH, dtype=np.float32)[None] / CONTEXT, CONTEXT, axis=0)
    said = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
    # A word starts as its class does, so that one met a few times is no worse known.
    seen = seen[trees.outer]
    turned = np.zeros((len(trees.odds), WIDTH + 1), np.float32)
    turned[:, WIDTH] = trees.odds
    return Model(seen, maps, said, np.log(shares).astype(np.float32), turned, trees)


def sequence(w: Words, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all tokens with each text's end, and the text of each."""
    n = len(w.first) - 1
    return np.insert(symbols, w.first[1:], END), np.insert(w.owner, w.first[1:], np.arange(n))


def contexts(tokens: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(places, tokens): the symbols before each token; before a text stands an end."""
    out = np.full((CONTEXT, len(tokens)), END)
    for j in range(1, CONTEXT + 1):
        same = text[j:] == text[:-j]
        out[j - 1, j:][same] = tokens[:-j][same]
    return out


class Trainer:
    """Noise-contrastive estimation with noise shared by a batch, and the likelihood of the
    trees' turns, stepped by Adagrad; ``met`` counts uses of the rows of weights."""

    def __init__(self, model: Model, shares: np.ndarray, seed: int = 5):
        self.model, self._rng, self.seen = model, np.random.default_rng(seed), 0
        self._noise = np.log(shares * NOISE).astype(np.float32)
        self._edges = np.cumsum(shares)[:-1]
        self._whole = [model.maps, model.said, model.bias]
        self._parts = [model.seen, model.turned]
        self._squares = [np.full(x.shape, 1e-3, np.float32) for x in self._whole]
        # One step width for all weights of a symbol or turn.
        self._part_squares = [np.full(len(x), 1e-3, np.float32) for x in self._parts]
        self.met_symbols, self.met_nodes = np.zeros(len(model.seen)), np.zeros(len(model.turned))

    def step(self, before: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        """One step on rows of contexts and targets that weigh ``weight``."""
        m, n = self.model, len(target)
        symbols, target = target, m.leaves.outer[target]
        share = (weight / weight.sum()).astype(np.float32)
        rows = [m.seen.take(b, 0) for b in before]
        guess = np.ones((n, WIDTH + 1), np.float32)
        guess[:, :WIDTH] = sum(r @ c for r, c in zip(rows, m.maps))
        wide, guess = guess, np.ascontiguousarray(guess[:, :WIDTH])
        noise = np.searchsorted(self._edges, self._rng.random(NOISE))
        said = m.said.take(target, 0)
        real = np.einsum("ij,ij->i", guess, said) + (m.bias - self._noise)[target]
        false = guess @ m.said[noise].T + (m.bias - self._noise)[noise]
        g_real = (0.5 * np.tanh(0.5 * real) - 0.5).astype(np.float32) * share
        false *= np.float32(0.5)
        g_false = np.tanh(false, out=false)
        g_false += np.float32(1)
        g_false *= (np.float32(0.5) * share)[:, None]
        g_guess = g_real[:, None] * said + g_false @ m.said[noise]
        g_said = _scatter(target, g_real[:, None] * guess, CLASSES)
        np.add.at(g_said, noise, g_false.T @ guess)
        g_bias = np.bincount(target, g_real, CLASSES)
        np.add.at(g_bias, noise, g_false.sum(0))
        owner, at = m.leaves.turns(symbols)
        if len(owner):
            node, sign = m.leaves.nodes[at], m.leaves.signs[at]
            mine, turned = wide.take(owner, 0), m.turned.take(node, 0)
            way = np.einsum("ij,ij->i", mine, turned)
            way *= sign
            way *= np.float32(0.5)
            g_way = np.tanh(way, out=way)
            g_way -= np.float32(1)
            g_way *= np.float32(0.5) * sign * share.take(owner)
            turned *= g_way[:, None]
            # The turns of one token stand together.
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            g_guess[owner[first]] += np.add.reduceat(turned, first)[:, :WIDTH]
            mine *= g_way[:, None]
            codes, some = pd.factorize(node)
            self.met_nodes[some] += np.bincount(codes, weight.take(owner))
            self._move(1, some, _scatter(codes, mine, len(some)))
        g_maps = np.stack([r.T @ g_guess for r in rows])
        codes, some = pd.factorize(before.ravel())
        self.met_symbols[some] += np.bincount(codes, np.tile(weight, CONTEXT))
        self._move(0, some, _scatter(codes, np.concatenate([g_guess @ c.T for c in m.maps]), len(some)))
        for x, g, s in zip(self._whole, (g_maps, g_said, g_bias), self._squares):
            g = g.astype(np.float32)
            s += g * g
            x -= RATE * g / np.sqrt(s)
        self.seen += weight.sum()

    def _move(self, part: int, some: np.ndarray, g: np.ndarray) -> None:
        g = g.astype(np.float32)
        squares = self._part_squares[part].take(some) + np.einsum("ij,ij->i", g, g) / np.float32(WIDTH)
        self._part_squares[part][some] = squares
        g *= (np.float32(RATE) / np.sqrt(squares))[:, None]
        x = self._parts[part]
        x[some] = x.take(some, 0) - g

    def met(self) -> np.ndarray:
        """How much each of the model's ``rows`` weighs among those of other tasks."""
        others = np.full(CLASSES + CONTEXT * WIDTH, float(self.seen))
        return np.concatenate([self.met_symbols, self.met_nodes, others])

    def learn(self, tokens: np.ndarray, text: np.ndarray, copies: np.ndarray | None = None) -> None:
        """One pass in shuffled batches of ``BATCH`` tokens; ``copies`` says how often each
        text counts."""
        before = contexts(tokens, text)
        weight = np.ones(len(tokens)) if copies is None else copies[text].astype(float)
        first, rows = _alike(before, tokens)
        weight, size = np.add.reduceat(weight[rows], first), np.diff(np.append(first, len(rows)))
        rows = rows[first]
        order = self._rng.permutation(len(rows))
        ends = np.cumsum(size[order])
        cuts = np.searchsorted(ends, np.arange(BATCH, ends[-1] + BATCH, BATCH), side="left") + 1
        for at, to in zip([0, *cuts.tolist()], cuts.tolist()):
            some = order[at:to]
            if len(some):
                self.step(before[:, rows[some]], tokens[rows[some]], weight[some])


def _alike(before: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows, those with equal context and target side by side, and where groups of at
    most ``ALIKE`` of these begin."""
    codes, wide = target, CLASSES + int(max(before.max(), target.max()))
    for b in before:
        codes, found = pd.factorize(codes * wide + b)
    rows = np.argsort(codes, kind="stable")
    codes = codes[rows]
    new = np.append(True, codes[1:] != codes[:-1])
    nth = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return np.flatnonzero(nth % ALIKE == 0), rows


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (k, d) by row of ``n``."""
    out = np.empty((n, values.shape[1]))
    for k, column in enumerate(np.ascontiguousarray(values.T)):
        out[:, k] = np.bincount(rows, column, n)
    return out


def class_shares(voc: Vocabulary) -> np.ndarray:
    shares = voc.class_counts + 1
    return shares / shares.sum()


def dealt(docs: DataFrame, shares: int) -> DataFrame:
    """``text, n``: the distinct texts and how often each occurs, one partition a share, in
    an order of their own.  Copies are counted before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["text", "n"])

    counted = docs.select("text").mapInArrow(count, "text string, n long").repartition(shares, "text")
    return counted.groupBy("text").agg(F.sum("n").alias("n")).sortWithinPartitions(F.xxhash64("text"), "text")


def train(docs: DataFrame, voc: Vocabulary) -> Model:
    """Every share's task passes over its texts once; the weights are averaged in Spark."""
    shares = class_shares(voc)
    start = new_model(shares, voc.leaves)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(new_model(shares, voc.leaves), shares)
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(0), lower=True)
                trainer.learn(*sequence(w, voc.symbols(w)), part.column(1).to_numpy())
        if trainer.seen:
            share = TaskContext.get().partitionId()
            rows, met = trainer.model.rows(), trainer.met()
            for block in range(0, len(rows), BLOCK):
                some = block + np.flatnonzero(met[block : block + BLOCK])
                if len(some):
                    yield _weights(block, share, some, rows[some], met[some])

    def average(key: tuple, parts: pa.Table) -> pa.Table:
        total, met = np.zeros((BLOCK, WIDTH + 1)), np.zeros(BLOCK)
        # Sums of fractions depend on the order.
        parts = parts.sort_by("share")
        for some, rows, weight in zip(*(parts.column(c) for c in ("some", "weights", "met"))):
            some = np.frombuffer(some.as_py(), np.int64) - key[0].as_py()
            weight = np.frombuffer(weight.as_py())
            total[some] += np.frombuffer(rows.as_py(), np.float32).reshape(-1, WIDTH + 1) * weight[:, None]
            met[some] += weight
        some = np.flatnonzero(met)
        mean = (total[some] / met[some, None]).astype(np.float32)
        return pa.Table.from_batches([_weights(key[0].as_py(), -1, some + key[0].as_py(), mean, met[some])])

    with small_batches(docs.sparkSession):
        learned = dealt(docs, max(1, round(voc.tokens / SHARE_TOKENS))).mapInArrow(learn, _WEIGHTS)
        parts = learned.groupBy("block").applyInArrow(average, _WEIGHTS).toArrow()
    rows = start.rows()
    for some, mean in zip(parts.column("some").to_pylist(), parts.column("weights").to_pylist()):
        rows[np.frombuffer(some, np.int64)] = np.frombuffer(mean, np.float32).reshape(-1, WIDTH + 1)
    return start.with_rows(rows)


_WEIGHTS = "block long, share long, some binary, weights binary, met binary"


def _weights(block: int, share: int, some: np.ndarray, rows: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    """Rows ``some`` of the weights, all in one block, with what they weigh."""
    data = (some.astype(np.int64), rows.astype(np.float32), met.astype(float))
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([share], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in data)],
        names=["block", "share", "some", "weights", "met"],
    )


def class_log10(model: Model, tables: np.ndarray, before: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Exactly normalised log10 probabilities of each token's symbol: of its class, and in a
    shared class of the turns to its leaf."""
    out = np.empty(len(target))
    said = np.concatenate([model.said.T, model.bias[None]])
    # No sum of products is larger, so exponents below the bound need no shift.
    widest, highest = np.sqrt(np.square(model.said).sum(1).max()), np.abs(model.bias).max()
    for at in range(0, len(target), BATCH):
        b, t = before[:, at : at + BATCH], target[at : at + BATCH]
        guess = np.ones((len(t), WIDTH + 1), np.float32)
        guess[:, :WIDTH] = sum(table.take(c, 0) for table, c in zip(tables, b))
        logits = guess @ said
        if np.sqrt(np.square(guess).sum(1).max()) * widest + highest > EXPONENT:
            logits -= logits.max(axis=1, keepdims=True)
        chosen = logits[np.arange(len(t)), model.leaves.outer[t]]
        np.exp(logits, out=logits)
        log = chosen - np.log(logits.sum(axis=1))
        owner, turn = model.leaves.turns(t)
        node = model.leaves.nodes[turn]
        way = np.einsum("ij,ij->i", guess.take(owner, 0), model.turned.take(node, 0))
        log = log - np.bincount(owner, np.logaddexp(0, -model.leaves.signs[turn] * way), len(t))
        out[at : at + BATCH] = log / np.log(10)
    return out


_SCORED = "row long, doc_id {}, n_tokens long, n_known long, counted double, modelled double, word long, n long"


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The score of a text does not depend on how the rows are split over files.  Very long texts
    are scored whole, and learned whole.

    Null and empty texts are one token, the end; repeated rows are scored each; a null
    id counts as one that is trained on; only ``doc_id`` and ``text`` are read; an empty
    table gives no rows, and without training texts all words are unknown.
    """
    training = docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = written(word_counts(training), "word_counts")
    voc = vocabulary(counts)
    model = train(training, voc)
    tables = model.tables()
    inside = np.log10(voc.rest_counts + voc.rest_words + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                yield from _score(part, row, voc, model, tables, inside)
                row += part.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.select("doc_id", "text").mapInArrow(score, _SCORED.format(kind)), "scored")
    tail = rows.where("word is not null").select("row", "word", "n")
    known = counts.select(F.col("word").alias("known"), F.col("n").alias("c"))
    found = tail.join(known, F.col("word") == F.col("known")).groupBy(F.col("row").alias("of")).agg(
        F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_counted")
    )
    texts = rows.where("word is null").join(found, F.col("row") == F.col("of"), "left")
    counted = F.col("counted") + F.coalesce("tail_counted", F.lit(0.0))
    return texts.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * F.log10(F.lit(float(voc.tokens + voc.distinct + 1)))).alias("base_score"),
        (F.col("modelled") + F.coalesce("tail_counted", F.lit(0.0))).alias("score"),
    )


def _score(part, first_row: int, voc: Vocabulary, model: Model, tables, inside) -> Iterator[pa.RecordBatch]:
    """A row per text, and one per text and word whose count is not at hand."""
    n = part.num_rows
    w = words(part.column(1), lower=True)
    codes, found, symbols, count = voc.looked_up(w)
    symbols, near = symbols[codes], (count > 0)[codes]
    tokens, text = sequence(w, symbols)
    modelled = np.bincount(text, class_log10(model, tables, contexts(tokens, text), tokens), n)
    log_count = np.where(count > 0, np.log10(count + 1.0), 0.0)[codes]
    owner = w.owner
    rest = (symbols >= FREQUENT) & (symbols < CLASSES)
    modelled += np.bincount(owner, np.where(rest, log_count - inside[np.where(rest, symbols, 0)], 0.0), n)
    ends = voc.class_counts[END]
    counted = np.bincount(owner, log_count, n) + np.log10(ends + 1)
    n_known = np.bincount(owner, near, n).astype(np.int64) + (ends > 0)
    rows = np.arange(first_row, first_row + n)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(rows),
            part.column(0),
            pa.array(w.counts + 1),
            pa.array(n_known),
            pa.array(counted),
            pa.array(modelled),
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.int64()),
        ],
        names=["row", "doc_id", "n_tokens", "n_known", "counted", "modelled", "word", "n"],
    )
    far = ~near
    pairs, first, many = np.unique(
        codes[far].astype(np.int64) + owner[far] * np.int64(len(found) + 1), return_index=True, return_counts=True
    )
    k = len(pairs)
    if k:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[owner[far][first]]),
                pa.nulls(k, part.column(0).type),
                *(pa.nulls(k, pa.int64()) for _ in range(2)),
                *(pa.nulls(k, pa.float64()) for _ in range(2)),
                pa.array(w.hash[far][first].view(np.int64)),
                pa.array(many.astype(np.int64)),
            ],
            names=["row", "doc_id", "n_tokens", "n_known", "counted", "modelled", "word", "n"],
        )


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"))
