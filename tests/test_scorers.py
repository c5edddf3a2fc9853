"""Scorers and lookups in all their forms on the same awkward rows."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postweave.operators.lookup import lookup_tokens
from postweave.operators.scorers import (
    ArrowScorer,
    BatchScorer,
    HashedLexiconScorer,
    LexiconScorer,
    MLScorer,
    _ordered_means,
    length_batches,
)
from postweave.plans import classify_queries
from tests.conftest import SMALL

ROWS = "id INT, windows ARRAY<ARRAY<STRING>>"


def rows():
    """Repeated and null ids with different windows, equal rows, no windows, empty windows."""
    rng = random.Random(6)
    word = lambda: rng.choice(["good", "bad", "the", "가", "w1", "w2", "w3"])
    out = [(1, [["good", "good"]]), (1, [["bad"]]), (None, [["good"]]), (None, [["bad"], ["good"]]), (2, None), (3, [])]
    out += [(1, [["bad"]]), (4, [["w9"]]), (None, [["good"]]), (2, [["the", "bad"], ["good", "bad", "가"]])]
    return out + [(rng.randrange(9), [[word() for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 4))]) for _ in range(60)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows())], f"n INT, {ROWS}").repartition(3, "n")


@pytest.fixture(scope="module")
def weights(spark):
    known = [("good", 0, 2), ("bad", 1, 3), ("가", 2, 1), ("the", 0, 1), ("the", 1, 1), ("w1", 2, -2), ("good", 0, 1)]
    return spark.createDataFrame(known, "token STRING, class_id INT, weight INT")


def vectors(scorer, table):
    found = scorer.mean_probs(table, "id", "windows", "p").select("n", "p").collect()
    assert len(found) == len(rows())
    return {r["n"]: r["p"] and [round(x, 12) for x in r["p"]] for r in found}


def test_all_forms_of_a_lexicon_agree_on_repeated_and_null_ids(table, weights):
    inline = vectors(LexiconScorer(weights, 3), table)
    assert inline[0] != inline[1] and inline[4] is None
    assert vectors(LexiconScorer(weights, 3, inline_tokens=0), table) == inline
    assert vectors(HashedLexiconScorer(weights, 3), table) == inline


def model(texts):
    """A probability that depends on every token of a text."""
    share = np.array([sum(map(len, t.split(" "))) % 7 + 1 for t in texts]) / 9
    return np.stack([share, 1 - share], axis=1)


def test_batches_by_length_equal_batches_in_order(table):
    plain = vectors(ArrowScorer(lambda: model, 2), table)
    assert vectors(BatchScorer(lambda: model, 2, batch_size=3, batch_tokens=8), table) == plain
    assert vectors(BatchScorer(lambda: model, 2), table) == plain


def test_a_model_is_made_once_in_a_worker(spark, table, tmp_path):
    folder = str(tmp_path)

    def make():
        with open(f"{folder}/loads", "a") as log:
            log.write(f"{os.getpid()}\n")
        return model

    scorer = BatchScorer(make, 2)
    for _ in range(3):
        vectors(scorer, table.repartition(12))
    workers = (tmp_path / "loads").read_text().split()
    # More than a dozen tasks a turn, but no worker made the model twice.
    assert len(workers) == len(set(workers)) < 12


def test_length_batches():
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 40, 200)
    seen = []
    for places in length_batches(lengths, 16, 100):
        assert len(places) <= 16
        assert len(places) == 1 or len(places) * lengths[places].max() <= 100
        seen += places.tolist()
    assert sorted(seen) == list(range(200))
    padded = sum(len(p) * lengths[p].max() for p in length_batches(lengths, 16, 10**9))
    assert padded < 1.2 * lengths.sum()
    assert list(length_batches(np.array([], int), 4, 4)) == []


def test_trained_model_keeps_rows_with_one_id_apart(spark, table):
    labelled = [(f"good day {i}", 1) for i in range(30)] + [(f"bad night {i}", 0) for i in range(30)]
    scorer = MLScorer.fit(spark.createDataFrame(labelled, "text STRING, label INT"), "text", "label")
    found = vectors(scorer, table)
    assert found[0][1] > 0.5 > found[1][1] and found[1] == found[6]
    assert found[2][1] > 0.5 and found[4] is None


def test_hashed_lexicon_is_refused_or_right_at_its_bounds(spark, table, weights):
    with pytest.raises(ValueError, match="beyond"):
        HashedLexiconScorer(weights, 3, max_bytes=50)
    with pytest.raises(ValueError, match="outside"):
        HashedLexiconScorer(weights, 2)
    nothing = vectors(HashedLexiconScorer(weights.limit(0), 3), table)
    assert nothing[0] == [round(1 / 3, 12)] * 3 and nothing[4] is None
    assert HashedLexiconScorer(weights, 3).mean_probs(table.limit(0), "id", "windows", "p").count() == 0


@pytest.mark.parametrize("part_tokens", [1, 20, 10**6])
def test_a_lexicon_beyond_its_bytes_is_joined_by_parts_of_rows(table, weights, part_tokens):
    inline = vectors(LexiconScorer(weights, 3), table)
    scorer = HashedLexiconScorer(weights, 3, max_bytes=50, split=True, part_tokens=part_tokens)
    assert vectors(scorer, table) == inline
    assert scorer.mean_probs(table, "id", "windows", "p").columns == ["n", "id", "p"]
    assert scorer.mean_probs(table.limit(0), "id", "windows", "p").count() == 0
    with pytest.raises(ValueError, match="outside"):
        HashedLexiconScorer(weights, 2, max_bytes=50, split=True)
    nothing = vectors(HashedLexiconScorer(weights.limit(0), 3, max_bytes=-1, split=True), table)
    assert nothing[0] == [round(1 / 3, 12)] * 3 and nothing[4] is None


def test_the_hashed_lexicon_query_takes_any_number_of_words(spark, monkeypatch):
    small = lambda *args, **more: HashedLexiconScorer(*args, max_bytes=1000, **more)
    monkeypatch.setattr(classify_queries, "HashedLexiconScorer", small)
    found, want = (
        sorted(map(tuple, classify_queries.QUERIES[name].run(spark, SMALL).collect()))
        for name in ("classify_hashed_lexicon", "classify_comments")
    )
    assert found == want


def test_a_model_gets_a_bounded_number_of_texts_as_strings(spark):
    """One Arrow batch of many windows: no more than ``batch_size`` texts are Python strings at once."""
    rows = pa.array([[[f"w{i}", "x"][: i % 3], ["a", "b"]] if i % 4 else None for i in range(200)])
    texts, most = [], []

    def seen(some):
        texts.extend(some)
        most.append(len(some))
        return np.tile([len(some[0]) + 1.0, 0.0], (len(some), 1))

    found = _ordered_means(rows.slice(7), seen, 2, 16)
    assert max(most) == 16 and len(found) == 193 and found[1].as_py() is None
    assert len(texts) == 2 * sum(r is not None for r in rows.slice(7).to_pylist())


def test_a_large_lexicon_on_an_append_stream_equals_the_table(spark, table, weights, tmp_path):
    many = spark.range(200_000).select(F.concat(F.lit("x"), "id").alias("token"), F.lit(1).alias("class_id"), F.lit(4).alias("weight"))
    scorer = HashedLexiconScorer(weights.union(many), 3)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    table.write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    query = scorer.mean_probs(stream, "id", "windows", "p").select("n", "p").writeStream.format("parquet")
    query = query.option("path", sink).option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
    query.trigger(availableNow=True).start().awaitTermination()
    streamed = {r["n"]: r["p"] and [round(x, 12) for x in r["p"]] for r in spark.read.parquet(sink).collect()}
    assert streamed == vectors(scorer, table)


@pytest.mark.parametrize("max_rows", [100, 0])
def test_lookup_on_repeated_and_null_ids(spark, max_rows):
    texts = [(1, "a b"), (1, "b c"), (None, "a b"), (None, "c"), (2, None), (3, ""), (1, "a b"), (4, "z"), (5, "  ")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "n INT, id INT, text STRING")
    lexicon = spark.createDataFrame([("a", "X"), ("b", "Y"), ("b", "Z"), (None, "N"), ("c", None)], "token STRING, replacement STRING")
    found = lookup_tokens(df, "id", "text", lexicon, max_rows)
    assert found.columns == df.columns
    got = [r["text"] for r in sorted(found.collect(), key=lambda r: r["n"])]
    assert got == ["X Y", "Y c", "X Y", "c", None, "", "X Y", "z", "  "]
