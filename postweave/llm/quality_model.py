"""Quality scores by a regularised quadratic discriminant.

Each document is a short vector of transformed statistics.  Per label the mean and
the covariance come from sums over all labelled rows outside the held-out fold, which
Spark adds up; a covariance is shrunk towards the pooled one and towards a multiple
of the identity.  A score is the logistic of the difference of the two log densities,
from Mahalanobis distances by cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import fold, read_table, slices, written
from postweave.llm.words import _hashes, mix, raw, window_starts, windows, words

FOLDS = 5
#: Shares of the pooled covariance and of the identity in each label's covariance.
POOLED, ROUND = 0.1, 0.02
THRESHOLD = 0.3

FEATURES = (
    "words", "word_bytes", "symbols", "upper", "shouts", "digits", "punctuation",
    "wide", "lines", "distinct", "dup_lines", "repeats",
)


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(characters.encode())] = 1
    return out


_COUNTED = [
    _table("#*$%&|<>"),
    _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _table("!"),
    _table("0123456789"),
    _table(".,;:?\"'()-"),
    np.repeat(np.array([0, 0, 0, 1], np.int32), 64),
    _table("\n"),
]


def features(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; an empty or null text is all zeros but
    for its lack of words."""
    w = words(texts)
    data, offsets = raw(texts)
    n = len(offsets) - 1
    sums = [np.diff(np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)])[offsets]) for t in _COUNTED]
    symbols, upper, shouts, digits, punctuation, wide, breaks = (x.astype(float) for x in sums)
    count = w.counts.astype(float)
    some = np.maximum(count, 1)
    size = np.maximum(np.bincount(w.owner, w.end - w.start, minlength=n), 1)
    at = window_starts(w.first, 5)
    grams = windows(w.hash, 5)[at] if len(at) else np.zeros(0, np.uint64)
    # Lines: cut at breaks and at the edges of texts; blank ones are left out by their words.
    cut = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    cut = cut[cut < len(data)]
    ends = np.append(cut[1:], len(data))
    inside = np.searchsorted(w.start, ends) > np.searchsorted(w.start, cut)
    cut, ends = cut[inside], ends[inside]
    line_owner = np.searchsorted(offsets, cut, side="right") - 1
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    out = np.stack(
        [
            np.log1p(count),
            np.log(size / some + 0.5),
            np.sqrt(symbols / some),
            np.sqrt(upper / size),
            np.sqrt(shouts / some),
            np.sqrt(digits / size),
            np.sqrt(punctuation / some),
            np.sqrt(wide / size),
            np.log1p(some / (breaks + 1)),
            np.log(_distinct(w.hash, w.owner, n) / some + 0.05),
            np.sqrt(1 - _distinct(_hashes(data, cut, ends), line_owner, n) / lines),
            np.sqrt(np.maximum(0, 1 - _distinct(grams, w.owner[at], n) / np.maximum(np.bincount(w.owner[at], minlength=n), 1))),
        ],
        axis=1,
    )
    out[count == 0] = 0
    return out.astype(np.float32)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    mixed = keys ^ mix(owner.astype(np.uint64) + np.uint64(17))
    order = np.argsort(mixed)
    new = np.ones(len(mixed), bool)
    new[1:] = mixed[order][1:] != mixed[order][:-1]
    found = np.bincount(owner[order[new]], minlength=n)
    return np.maximum(found, np.bincount(owner, minlength=n) == 0)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat = pa.array(features(part.column(1)).ravel())
                vectors = pa.FixedSizeListArray.from_arrays(flat, len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), vectors.cast(pa.list_(pa.float32()))], names=["doc_id", "features"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, features array<float>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log normalisers of the labels 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.logs):
            return np.full(len(x), 0.5)
        density = [
            log - 0.5 * np.square((x - mean) @ factor.T).sum(1)
            for mean, factor, log in zip(self.means, self.factors, self.logs)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(rows: DataFrame, labels: DataFrame, pooled: float = POOLED, round_: float = ROUND) -> Discriminant:
    """From all rows of ``rows(doc_id, features)`` that have a label of 0 or 1."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("labelled"), "quality")
    known = rows.join(known, F.col("doc_id") == F.col("labelled"))
    d = len(FEATURES)
    x = [F.col("features")[i].cast("double") for i in range(d)]
    firsts = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    seconds = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    found = {r["quality"]: r for r in known.groupBy("quality").agg(F.count("*").alias("n"), *firsts, *seconds).collect()}
    if len(found) < 2:
        return Discriminant(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0))
    means, scatters, counts = [], [], []
    for label in (0, 1):
        row = found[label]
        mean = np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
        second = np.array([[row[f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
        means.append(mean)
        scatters.append(second - row["n"] * np.outer(mean, mean))
        counts.append(row["n"])
    return discriminant(np.array(means), scatters, counts, pooled, round_)


def discriminant(means, scatters, counts, pooled: float, round_: float) -> Discriminant:
    total, d = sum(counts), means.shape[1]
    common = sum(scatters) / max(total - 2, 1)
    factors, logs = [], []
    for scatter, n in zip(scatters, counts):
        own = scatter / max(n - 1, 1)
        cov = (1 - pooled) * own + pooled * common
        cov = (1 - round_) * cov + round_ * (np.trace(cov) / d + 1e-9) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        logs.append(np.log(n / total) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(logs))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant]:
    """Features of all rows, written down, and the model of the rows outside the held-out fold."""
    rows = written(measured(docs), "features")
    return rows, fit(rows.where(fold(F.col("doc_id"), FOLDS) != 0), labels)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts are scored as texts without words; repeated rows are scored
    each; only ``doc_id`` and ``text`` are read; an empty table gives no rows; without
    labels of both kinds every score is 0.5.
    """
    rows, model = fitted(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(score, f"doc_id {kind}, score double")
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model rejects; texts are measured again where they
    are, so none is shuffled."""
    _, model = fitted(docs, labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.scores(features(part.column(at)).astype(float)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
