"""Scorers: windows of a text in, one mean probability vector per text out.

A scorer adds a column with the mean vector to a table that has an
``ARRAY<ARRAY<STRING>>`` column of token windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweave.functions.text import let
from postweave.functions.windows import words
from postweave.functions.vectors import mean_vector, mean_vectors, softmax
from postweave.operators.lookup import salted_join
from postweave.session import broadcast_if_small, scratch_path

# Lexicons up to this many tokens are part of the plan; larger ones are a join.
INLINE_TOKENS = 1_000

#: Bytes of tokens, hashes and weights that every executor may hold for one lexicon.
ARRAY_BYTES = 256 << 20

#: Tokens of the rows that are scored together where a lexicon is beyond that.
PART_TOKENS = 2_000_000


class Scorer:
    """Base: window vectors inside the row, mean inside the row, no shuffle."""

    n_classes: int

    def window_probs(self, windows: Column) -> Column:
        raise NotImplementedError

    def mean_probs(self, df: DataFrame, key: str, windows: str, out: str) -> DataFrame:
        scored = df.withColumn("__probs", self.window_probs(F.col(windows)))
        return scored.withColumn(out, mean_vectors(F.col("__probs"), self.n_classes)).drop(
            "__probs"
        )


class LexiconScorer(Scorer):
    """Linear scorer: sum of integer token weights per class, then softmax.

    ``weights`` is ``(token, class_id, weight)``.  A lexicon of at most
    ``INLINE_TOKENS`` tokens becomes a literal and scoring stays in the row.
    A larger one is joined: broadcast if its measured size allows, else salted;
    ``HashedLexiconScorer`` looks it up in the row instead.  Both forms give the same vectors; weights with a null or with a class outside
    ``0 .. n_classes - 1`` are refused before either is chosen.
    """

    def __init__(self, weights: DataFrame, n_classes: int, inline_tokens: int = INLINE_TOKENS):
        self.n_classes = n_classes
        self.weights = checked_weights(weights, n_classes)
        self.vectors: dict[str, list[int]] | None = None
        # One row per (token, class): reads no further than the bound.
        rows = self.weights.limit(inline_tokens * n_classes + 1).collect()
        if len(rows) <= inline_tokens * n_classes:
            vectors: dict[str, list[int]] = {}
            for token, class_id, weight in rows:
                vectors.setdefault(token, [0] * n_classes)[class_id] += weight
            if len(vectors) <= inline_tokens:
                self.vectors = vectors

    @property
    def inline(self) -> bool:
        return self.vectors is not None

    def window_probs(self, windows: Column) -> Column:
        if self.vectors is None:
            raise ValueError("lexicon too large to score inside the row")
        vectors = self.vectors
        known = list(vectors)

        def among(window: Column, wanted: list[str]) -> Column:
            return F.filter(window, lambda t: t.isin(wanted))

        # What zero logits give: the vector of a window without a known token.
        uniform = F.array(*[F.lit(1.0 / self.n_classes)] * self.n_classes)

        def probs(found: Column) -> Column:
            logits = F.array(*[total(found, k) for k in range(self.n_classes)])
            return F.when(F.size(found) == 0, uniform).otherwise(softmax(logits))

        def total(found: Column, class_id: int) -> Column:
            # Tokens of equal weight share a set, looked up by hash.
            by_weight: dict[int, list[str]] = {}
            for token, vector in vectors.items():
                if vector[class_id]:
                    by_weight.setdefault(vector[class_id], []).append(token)
            parts = [
                F.size(among(found, tokens)) * F.lit(weight)
                for weight, tokens in by_weight.items()
            ]
            return reduce(lambda a, b: a + b, parts, F.lit(0))

        return F.transform(windows, lambda w: let(among(w, known), probs))

    def mean_probs(self, df: DataFrame, key: str, windows: str, out: str) -> DataFrame:
        if self.inline:
            return super().mean_probs(df, key, windows, out)
        rows, distinct = by_content(df, windows)
        numbered = window_rows(distinct, [CONTENT], windows)
        hits = token_hits(numbered, self.weights, [CONTENT, "window_no"], "left")
        # A window without a known token has zero sums and so a uniform vector.
        probs = window_vectors(hits, [CONTENT, "window_no"], self.n_classes)
        means = mean_vector(probs, [CONTENT], "probs", out)
        return rows.drop(windows).join(means, CONTENT, "left").drop(CONTENT)


#: Digest of what a row's vector depends on.
CONTENT = "__content"


def by_content(df: DataFrame, windows: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with a digest of its windows, and the distinct windows by digest.

    A joined form groups by the digest, not by an id: rows that repeat an id keep their own
    result, a null id is no special case, and copies are scored once.
    """
    rows = df.withColumn(CONTENT, F.sha2(F.to_json(windows), 256))
    return rows, rows.where(F.col(CONTENT).isNotNull()).groupBy(CONTENT).agg(F.first(windows).alias(windows))


def checked_weights(weights: DataFrame, n_classes: int) -> DataFrame:
    """``token, class_id, weight``; a null or a class outside ``0 .. n_classes - 1`` is refused."""
    weights = weights.select("token", "class_id", "weight")
    good = F.col("class_id").between(0, n_classes - 1) & F.col("weight").isNotNull()
    bad = weights.where(F.col("token").isNull() | ~F.coalesce(good, F.lit(False))).first()
    if bad is not None:
        raise ValueError(f"weight with a null or a class outside 0..{n_classes - 1}: {bad.asDict()}")
    return weights


class HashedLexiconScorer(Scorer):
    """The vectors of ``LexiconScorer`` from arrays, for lexicons of millions of tokens.

    The lexicon becomes a sorted array of token hashes with the tokens and their weights
    beside it, read by every task.  The distinct tokens of an Arrow batch are looked up by
    binary search and compared byte by byte, so a hash decides nothing.  Nothing is grouped or
    joined and no id is needed: an append stream can use it.  A lexicon whose measured
    size is beyond ``max_bytes`` is refused; ``LexiconScorer`` joins it.

    With ``split`` such a lexicon stays a table of any size, in the shared scratch folder.  Rows
    that come together are a part of at most ``part_tokens`` tokens (a longer row is one of its own);
    the distinct tokens of each part are joined to the lexicon, and the part is looked up in arrays
    of those alone.  Rows and distinct tokens are shuffled for it; a stream is refused.
    """

    def __init__(
        self,
        weights: DataFrame,
        n_classes: int,
        max_bytes: int = ARRAY_BYTES,
        split: bool = False,
        part_tokens: int = PART_TOKENS,
    ):
        self.n_classes, self._part_tokens = n_classes, part_tokens
        weights = checked_weights(weights, n_classes)
        sums = [F.sum(F.when(F.col("class_id") == k, F.col("weight")).otherwise(0)).cast("long") for k in range(n_classes)]
        tokens = weights.groupBy("token").agg(F.array(*sums).alias("weights"))
        if split:
            # Measured and read from one evaluation.
            tokens = _stored(tokens, "lexicon")
        cost = F.octet_length("token") + 16 + 8 * n_classes
        size = tokens.agg(F.sum(cost)).first()[0] or 0
        self._table = tokens if size > max_bytes else None
        if self._table is not None:
            if split:
                return
            raise ValueError(f"a lexicon of {size} bytes is beyond {max_bytes}: LexiconScorer joins it")
        rows = tokens.toArrow()
        arrays = _lexicon_arrays(rows.column("token").combine_chunks(), rows.column("weights").combine_chunks(), n_classes)
        shared = weights.sparkSession.sparkContext.broadcast(arrays)

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def score(rows: pa.Array, _: pa.Array) -> pa.Array:
            return _lexicon_means(rows, shared.value, n_classes)

        self._score = score

    def mean_probs(self, df: DataFrame, key: str, windows: str, out: str) -> DataFrame:
        if self._table is not None:
            return self._mean_by_parts(df, windows, out)
        # As for ArrowScorer, the second argument keeps the windows a column of their own.
        return df.withColumn(out, self._score(F.col(windows), F.size(windows)))

    def _mean_by_parts(self, df: DataFrame, windows: str, out: str) -> DataFrame:
        if df.isStreaming:
            raise ValueError("a lexicon that is joined by parts of rows can't be used on a stream")
        n_classes, part_tokens = self.n_classes, self._part_tokens
        at, names = df.columns.index(windows), [f"__{k}" for k in range(len(df.columns))]
        fields = [T.StructField(name, f.dataType) for name, f in zip(names, df.schema)]
        extra = [T.StructField(PART, T.LongType()), T.StructField(VOCABULARY, T.ArrayType(T.StringType()))]

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows with the number of their part, and one row per part with its distinct tokens."""
            part = TaskContext.get().partitionId() << 32
            for batch in batches:
                for some in _token_slices(batch, at, part_tokens):
                    n, words_ = some.num_rows, some.column(at).flatten().flatten().unique().drop_null()
                    number = pa.array([part]).take(pa.array(np.zeros(n, np.int64)))
                    none = pa.nulls(n, pa.list_(words_.type))
                    yield pa.RecordBatch.from_arrays([*some.columns, number, none], names=[*names, PART, VOCABULARY])
                    nulls = [pa.nulls(1, c.type) for c in some.columns]
                    vocabulary = pa.ListArray.from_arrays(pa.array([0, len(words_)], pa.int32()), words_)
                    yield pa.RecordBatch.from_arrays([*nulls, pa.array([part]), vocabulary], names=[*names, PART, VOCABULARY])
                    part += 1

        def score(rows: pa.Table, known: pa.Table) -> pa.Table:
            tokens, weights = (known.column(c).combine_chunks() for c in ("token", "weights"))
            arrays = _lexicon_arrays(tokens, weights, n_classes)
            means = _lexicon_means(rows.column(names[at]).combine_chunks(), arrays, n_classes)
            return rows.drop_columns([names[at], PART]).append_column(MEAN, means)

        parts = _stored(df.toDF(*names).mapInArrow(numbered, T.StructType([*fields, *extra])), "lexicon-rows")
        words_of = parts.where(F.col(VOCABULARY).isNotNull())
        wanted = words_of.select(F.col(PART).alias("part"), F.explode(VOCABULARY).alias("token"))
        known = wanted.join(self._table, "token").select("part", "token", "weights")
        rows = parts.where(F.col(VOCABULARY).isNull()).drop(VOCABULARY)
        left = [f for k, f in enumerate(fields) if k != at]
        kind = T.StructType([*left, T.StructField(MEAN, T.ArrayType(T.DoubleType()))])
        scored = rows.groupBy(PART).cogroup(known.groupBy("part")).applyInArrow(score, kind)
        return scored.toDF(*[c for c in df.columns if c != windows], out)


#: Private columns of rows that are scored by parts.
PART, VOCABULARY, MEAN = "__part", "__vocabulary", "__mean"


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _token_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch cut where the tokens of its windows pass ``limit``; a longer row is a slice of its own."""
    per_row = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    per_window = pc.fill_null(pc.list_value_length(batch.column(column).flatten()), 0).to_numpy(zero_copy_only=False)
    windows, tokens = np.append(0, np.cumsum(per_row)), np.append(0, np.cumsum(per_window))
    sizes = np.diff(tokens[windows])
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def _hashes(tokens: pa.Array, salt: str) -> np.ndarray:
    return pd.util.hash_array(tokens.to_numpy(zero_copy_only=False).astype(object), hash_key=salt, categorize=False)


def _lexicon_arrays(tokens: pa.Array, weights: pa.Array, n_classes: int) -> tuple:
    """Tokens and weights in order of hashes that are distinct for them, and the salt of those."""
    table = weights.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_classes)
    for turn in range(100):
        salt = f"{turn:016d}"
        hashes = _hashes(tokens, salt)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) == len(hashes):
            return salt, hashes[order], tokens.take(pa.array(order)), table[order]
    raise AssertionError("no salt tells the tokens apart")


def _lexicon_means(rows: pa.Array, arrays: tuple, n_classes: int) -> pa.Array:
    """Mean vector of each row's windows; null for a row without one."""
    salt, hashes, known, table = arrays
    per_row = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
    windows = rows.flatten()
    per_window = pc.fill_null(pc.list_value_length(windows), 0).to_numpy()
    coded = windows.flatten().dictionary_encode()
    place = np.zeros(len(coded.dictionary), np.int64)
    found = np.zeros(len(coded.dictionary), bool)
    if len(hashes) and len(place):
        place = np.minimum(np.searchsorted(hashes, _hashes(coded.dictionary, salt)), len(hashes) - 1)
        same = pc.equal(known.take(pa.array(place)), coded.dictionary.cast(known.type))
        found = pc.fill_null(same, False).to_numpy(zero_copy_only=False)
    index = pc.fill_null(coded.indices, -1).to_numpy()
    window = np.repeat(np.arange(len(windows)), per_window)
    hit = (index >= 0) & found[index] if len(found) else np.zeros(len(index), bool)
    window, entry = window[hit], place[index[hit]]
    logits = np.empty((len(windows), n_classes))
    for k in range(n_classes):
        logits[:, k] = np.bincount(window, table[entry, k] if len(entry) else None, minlength=len(windows))
    scaled = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(logits) else logits
    probs = scaled / scaled.sum(axis=1, keepdims=True)
    row = np.repeat(np.arange(len(rows)), per_row)
    means = np.stack([np.bincount(row, probs[:, k], minlength=len(rows)) for k in range(n_classes)], axis=1)
    means /= np.maximum(per_row, 1)[:, None]
    offsets = np.arange(0, (len(rows) + 1) * n_classes, n_classes, dtype=np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(means.ravel()))
    return pc.if_else(pa.array(per_row > 0), out, pa.scalar(None, out.type))


def window_rows(df: DataFrame, keys: list[str], windows: str) -> DataFrame:
    """One row per window of an array column: keys, ``window_no``, ``tokens``.

    The outer form with a filter behind it: for the inner form Spark infers
    ``size(windows) > 0``, pushes it to the scan and so cuts all windows twice.
    """
    rows = df.select(*keys, F.posexplode_outer(windows).alias("window_no", "tokens"))
    return rows.where(F.col("window_no").isNotNull())


def token_hits(
    windows: DataFrame, weights: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """``(keys, class_id, score)`` for the tokens of windows that have a weight; with ``how``
    "left" also nulls for those that have none.

    Small weights are broadcast and tokens without one end in the task that read
    them.  For large weights equal tokens of a window are counted first, so that
    what is shuffled is one row per distinct token and window, salted.
    """
    tokens = windows.select(*keys, F.explode("tokens").alias("token"))
    table, small = broadcast_if_small(weights)
    if small:
        return tokens.join(table, "token", how).select(*keys, "class_id", F.col("weight").alias("score"))
    counted = tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"))
    return salted_join(counted, weights, ["token"], how, keys).select(
        *keys, "class_id", (F.col("n") * F.col("weight")).alias("score")
    )


def score_tokens(windows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weight sums ``(keys, class_id, score)`` of token windows."""
    hits = token_hits(windows, weights, keys)
    return hits.groupBy(*keys, "class_id").agg(F.sum("score").alias("score"))


def window_vectors(hits: DataFrame, keys: list[str], n_classes: int) -> DataFrame:
    """Probability vector per window with at least one hit: one shuffle of sums."""
    logits = [
        F.coalesce(F.sum(F.when(F.col("class_id") == k, F.col("score"))), F.lit(0))
        for k in range(n_classes)
    ]
    return hits.groupBy(*keys).agg(F.array(*logits).alias("logits")).select(
        *keys, softmax(F.col("logits")).alias("probs")
    )


class ArrowScorer(Scorer):
    """A model behind an Arrow function.

    ``make_model`` runs once per task and returns a function from a list of
    texts to an array of ``(texts, classes)`` probabilities.  The windows of an
    Arrow batch are scored ``batch_size`` at a time and go back to their rows,
    so averaging needs no shuffle.
    """

    def __init__(
        self,
        make_model: Callable[[], Callable[[list[str]], np.ndarray]],
        n_classes: int,
        batch_size: int = 16,
    ):
        self.n_classes = n_classes

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = make_model()
            for rows, _ in batches:
                yield _ordered_means(rows, model, n_classes, batch_size)

        self._score = score

    def mean_probs(self, df: DataFrame, key: str, windows: str, out: str) -> DataFrame:
        # Naming the column twice keeps the optimizer from folding the window
        # expression into the call: it must be a column of its own there.
        return df.withColumn(out, self._score(F.col(windows), F.size(windows)))


def _ordered_means(rows: pa.Array, model: Callable, n_classes: int, batch_size: int) -> pa.Array:
    """Only the texts of ``batch_size`` windows at a time become Python strings."""
    per_row = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
    windows = rows.flatten()
    probs = np.empty((len(windows), n_classes))
    for at in range(0, len(windows), batch_size):
        texts = pc.binary_join(windows.slice(at, batch_size), " ")
        probs[at : at + batch_size] = model(texts.to_pylist())
    return _row_means(probs, per_row)


def _row_means(probs: np.ndarray, per_row: np.ndarray) -> pa.Array:
    """Mean of the vectors of each row's windows; null for a row without one."""
    ends = np.cumsum(per_row)
    means = [probs[end - n : end].mean(axis=0).tolist() if n else None for end, n in zip(ends, per_row)]
    return pa.array(means, pa.list_(pa.float64()))


#: The last models of this worker process, by scorer.
_MODELS: dict[str, Callable] = {}


def worker_model(name: str, make_model: Callable[[], Callable], keep: int = 2) -> Callable:
    """The model of a scorer, made once per Python worker and kept for its later tasks."""
    if name not in _MODELS:
        while len(_MODELS) >= keep:
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[name] = make_model()
    return _MODELS[name]


class BatchScorer(Scorer):
    """``ArrowScorer`` for models that are slow to load and pad their batches.

    The model is made once per Python worker, not once per task.  The windows of an
    Arrow batch are scored in order of length, so a batch is padded to little more than
    its own windows, and the results go back to the places of their windows.  A batch holds
    at most ``batch_size`` windows and ``batch_tokens`` tokens with the padding; a longer
    window is a batch of its own.
    """

    def __init__(
        self,
        make_model: Callable[[], Callable[[list[str]], np.ndarray]],
        n_classes: int,
        batch_size: int = 64,
        batch_tokens: int = 16_384,
    ):
        self.n_classes = n_classes
        name = uuid.uuid4().hex

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = worker_model(name, make_model)
            for rows, _ in batches:
                yield _batched_means(rows, model, n_classes, batch_size, batch_tokens)

        self._score = score

    def mean_probs(self, df: DataFrame, key: str, windows: str, out: str) -> DataFrame:
        return df.withColumn(out, self._score(F.col(windows), F.size(windows)))


def length_batches(lengths: np.ndarray, batch_size: int, batch_tokens: int) -> Iterator[np.ndarray]:
    """Places of the windows of each batch: longest first, so that a first batch that fits means
    all fit; equal lengths keep their order."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = max(int(lengths[order[at]]), 1)
        size = max(1, min(batch_size, batch_tokens // longest))
        yield order[at : at + size]
        at += size


def _batched_means(rows: pa.Array, model: Callable, n_classes: int, batch_size: int, batch_tokens: int) -> pa.Array:
    per_row = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
    windows = rows.flatten()
    lengths = pc.fill_null(pc.list_value_length(windows), 0).to_numpy()
    texts = pc.binary_join(windows, " ")
    probs = np.empty((len(windows), n_classes))
    for places in length_batches(lengths, batch_size, batch_tokens):
        probs[places] = model(texts.take(pa.array(places)).to_pylist())
    return _row_means(probs, per_row)


class MLScorer(Scorer):
    """Spark ML: hashed term frequencies and logistic regression.

    Stands in for trained weights where only labelled rows exist.
    """

    def __init__(self, model, n_classes: int):
        self.model = model
        self.n_classes = n_classes

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        text: str,
        label: str,
        n_classes: int = 2,
        features: int = 1 << 14,
        few_words: bool = False,
    ) -> "MLScorer":
        """Train on labelled rows; ``label`` holds class ids.

        Labels that show in the mix of words go by weighed shares of words.  ``few_words`` is for
        labels that hang on a few words wherever they stand: presence of words alone
        counts, and an L1 penalty leaves most of them out.
        """
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

        # The tokens that windows hold, marks among them.
        rows = df.select(
            F.array_join(words(F.lower(text)), " ").alias("__text"), F.col(label).cast("double").alias("__label")
        ).where(F.col("__text").isNotNull() & F.col("__label").isNotNull())
        words_of = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"\s+", minTokenLength=1)
        counts = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features, binary=few_words)
        learn = LogisticRegression(featuresCol="__tf", labelCol="__label")
        if few_words:
            stages = [words_of, counts, learn.setParams(maxIter=100, regParam=0.02, elasticNetParam=1.0)]
        else:
            stages = [
                words_of,
                counts,
                IDF(inputCol="__tf", outputCol="__weighed", minDocFreq=2),
                Normalizer(inputCol="__weighed", outputCol="__features"),
                learn.setParams(featuresCol="__features", maxIter=50, regParam=0.001),
            ]
        return cls(Pipeline(stages=stages).fit(rows), n_classes)

    def mean_probs(self, df: DataFrame, key: str, windows: str, out: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        keyed, distinct = by_content(df, windows)
        rows = window_rows(distinct, [CONTENT], windows).select(
            # The tokenizer may run ahead of the filter behind the outer form, and takes no null.
            CONTENT,
            F.coalesce(F.array_join("tokens", " "), F.lit("")).alias("__text"),
        )
        scored = self.model.transform(rows).select(
            CONTENT, vector_to_array("probability").alias("__probs")
        )
        return keyed.join(mean_vector(scored, [CONTENT], "__probs", out), CONTENT, "left").drop(CONTENT)


def ranking(df: DataFrame, truth: str, score: str) -> DataFrame:
    """``n_test, n_positive, auc`` of scores against 0/1 labels.

    Equal scores are counted first, so the ordered sums run over distinct rounded
    scores, at most 10,001 rows.
    """
    steps = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(
        F.round(F.col(score) * 10_000).alias("s"), F.col(truth).cast("long").alias("y")
    )
    steps = steps.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = F.sum("neg").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    won = F.col("pos") * (F.coalesce(below, F.lit(0)) + F.col("neg") / 2)
    return steps.select("pos", "neg", won.alias("won")).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n_test"),
        F.sum("pos").alias("n_positive"),
        (F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"),
    )
