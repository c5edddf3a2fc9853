"""Operators on small tables made by hand."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.functions.vectors import argmax, mean_vector, mean_vectors, round_vector, softmax
from postweave.functions.windows import (
    WindowOptions,
    is_long,
    sentences,
    text_windows,
    window_spans,
    windows,
)
from postweave.operators.activity import (
    activity_sessions,
    idle_intervals,
    live_keys,
    merge_sessions,
)
from postweave.operators.audit import changed_rows, mismatches, missing_keys
from postweave.operators.catalogue import categories, label_catalogue
from postweave.operators.classify import classify, classify_heads
from postweave.operators.lookup import label_of, lookup_tokens
from postweave.operators.normalize import normalize
from postweave.operators.scorers import ArrowScorer, LexiconScorer
from postweave.session import is_small, literal_rows
from postweave.sources.manifest import data_version, manifest
from postweave.sources.rules import RuleSet, default_rules, load_rules, rules_json
from postweave.streaming.posts import Refreshed, run_refreshing_stream, run_stream


def spans_of(n: int, size: int, overlap: int = 20) -> list[tuple[int, int]]:
    """The windowing rule, one window at a time."""
    done, at = [], 0
    everything = list(range(n))
    while at < n:
        if n - at > overlap:
            part = everything[at : at + size]
            at += size - overlap
        else:
            part = everything[n - size : n]
            at = n
        done.append((part[0], part[-1] + 1))
    return done


@pytest.mark.parametrize("size", [40, 256])
def test_window_spans(spark, size):
    rows = spark.range(1, 700).select("id", window_spans(F.col("id").cast("int"), size).alias("w"))
    for row in rows.collect():
        assert [tuple(w) for w in row["w"]] == spans_of(row["id"], size), row["id"]


def test_windows_cover_all_tokens_and_stub_can_be_dropped(spark):
    row = spark.range(1).select(
        windows(F.sequence(F.lit(1), F.lit(600)).cast("array<string>"), 256).alias("w"),
        window_spans(F.lit(250), 256, clamp_tail=True).alias("clamped"),
    ).first()
    assert {t for w in row["w"] for t in w} == {str(i) for i in range(1, 601)}
    assert [tuple(w) for w in row["clamped"]] == [(0, 250)]


def test_sentences(apply):
    assert apply(sentences, ["a .b!", "", "...", " x  y "]) == [["a.", "b!", ""], [""], ["...", ""], ["x  y"]]
    assert apply(lambda c: sentences(c, keep_empty=False), ["a .b!"]) == [["a.", "b!"]]


def test_long_border(apply):
    assert apply(lambda c: is_long(c, 256), ["a" * 280, "a" * 281, "a [X_Y] " * 280]) == [False, True, False]
    assert apply(lambda c: is_long(c, 40), ["a" * 43, "a" * 44]) == [False, True]


def test_short_text_is_one_cut_window(apply):
    short, long = apply(
        lambda c: text_windows(c, WindowOptions(40)), ["a " * 43, "a" * 44 + ". b"]
    )
    assert [len(w) for w in short] == [40] and short[0][-1] == "[SEP]"
    assert [w[1:-1] for w in long] == [["a" * 44, "."], ["b"]]


def test_vectors(spark):
    v = F.array(F.lit(0.25), F.lit(0.75))
    row = spark.range(1).select(
        softmax(F.array(F.lit(1), F.lit(3), F.lit(2))).alias("s"),
        mean_vectors(F.array(F.array(F.lit(0.2), F.lit(0.8)), F.array(F.lit(0.6), F.lit(0.4))), 2).alias("m"),
        argmax(v).alias("a"),
        argmax(F.array(F.lit(0.5), F.lit(0.5))).alias("tie"),
        round_vector(F.array(F.lit(0.125), F.lit(2.675))).alias("r"),
    ).first()
    assert sum(row["s"]) == pytest.approx(1) and np.argmax(row["s"]) == 1
    assert row["m"] == pytest.approx([0.4, 0.6])
    assert (row["a"], row["tie"], row["r"]) == (1, 0, [0.12, 2.68])


def test_mean_vector_over_rows(spark):
    rows = spark.createDataFrame([(1, [0.2, 0.8]), (1, [0.6, 0.4]), (2, [1.0, 0.0])], "k INT, v ARRAY<DOUBLE>")
    got = {r["k"]: r["prob"] for r in mean_vector(rows, ["k"], "v").collect()}
    assert got[1] == pytest.approx([0.4, 0.6]) and got[2] == [1.0, 0.0]


def test_catalogue_is_order_of_appearance(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "ord INT, c STRING")
    catalogue = label_catalogue(rows, "c", "ord", "head")
    assert sorted((r["class_id"], r["label"]) for r in catalogue.collect()) == [(0, "b"), (1, "a")]
    assert categories(catalogue).first()["categories"] == ["b", "a"]


WEIGHTS = [("good", 0, 2), ("bad", 1, 3), ("good", 1, -1), ("fine", 0, 1)]


def plain_result(text: str) -> tuple[int, list[float]]:
    table = {}
    for token, k, w in WEIGHTS:
        table.setdefault(token, [0, 0])[k] += w
    import re

    def words(part):
        return re.findall(r"\w+|[^\w\s]", part)

    if len(re.sub(r"\s", "", text)) >= 44:
        parts = re.split(r"(?<=[.,!?^~])(?![.,!?^~])", text)
        toks = [["B", *words(p), "E"] for p in parts]
        wins = [t[a:b] for t in toks for a, b in spans_of(len(t), 40)]
    else:
        wins = [words(text)[:38]]
    probs = []
    for w in wins:
        scores = np.sum([table.get(t, [0, 0]) for t in w] or [[0, 0]], axis=0).astype(float)
        e = np.exp(scores - scores.max())
        probs.append(e / e.sum())
    mean = np.mean(probs, axis=0)
    return int(np.argmax(np.round(mean, 12))), list(mean)


def test_scorers_agree_with_each_other_and_by_hand(spark):
    rng = random.Random(3)
    words = ["good", "bad", "fine", "so", "la", ".", "!", "?"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, nickname STRING").repartition(3)
    weights = spark.createDataFrame(WEIGHTS, "token STRING, class_id INT, weight INT")
    labels = literal_rows(spark, "head STRING, class_id INT, label STRING", [("nickname", 0, "yes"), ("nickname", 1, "no")])

    def make():
        def predict(batch):
            return np.array([plain_probs(text) for text in batch])

        return predict

    table = {}
    for token, k, w in WEIGHTS:
        table.setdefault(token, [0, 0])[k] += w

    def plain_probs(text):
        scores = np.sum([table.get(t, [0, 0]) for t in text.split(" ")], axis=0).astype(float)
        e = np.exp(scores - scores.max())
        return e / e.sum()

    inline, joined = LexiconScorer(weights, 2), LexiconScorer(weights, 2, inline_tokens=0)
    assert inline.inline and not joined.inline
    for scorer in (inline, joined, ArrowScorer(make, 2, batch_size=7)):
        for row in classify(df, scorer, labels, "nickname").collect():
            k, mean = plain_result(row["nickname"])
            assert row["nickname_result"]["predicted"] == ["yes", "no"][k]
            assert row["nickname_result"]["prob"] == pytest.approx(mean, abs=0.0051)


def test_unscored_rows_survive(spark):
    df = spark.createDataFrame([(1, None), (2, "good")], "id INT, comment STRING")
    weights = spark.createDataFrame(WEIGHTS, "token STRING, class_id INT, weight INT")
    labels = literal_rows(spark, "head STRING, class_id INT, label STRING", [("comment", 0, "yes"), ("comment", 1, "no")])
    for scorer in (LexiconScorer(weights, 2), LexiconScorer(weights, 2, inline_tokens=0)):
        got = {r["id"]: r["comment_result"]["predicted"] for r in classify(df, scorer, labels, "comment").collect()}
        assert got == {1: None, 2: "yes"}
        assert classify(df.where("id < 0"), scorer, labels, "comment").count() == 0


def test_large_lookup_tables_take_the_salted_join(spark):
    left = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS class_id")
    names = spark.range(50).selectExpr("'h' AS head", "CAST(id AS INT) AS class_id", "'n' || id AS label")
    assert not is_small(names, max_rows=10)
    from postweave.operators.lookup import lookup_join

    joined = lookup_join(
        left, names.select(F.col("class_id").cast("long").alias("class_id"), "label"), ["class_id"], max_rows=10
    )
    assert joined.where(F.col("label") == F.concat(F.lit("n"), "class_id")).count() == 1000
    assert label_of(left, names, "h").count() == 1000


def test_lookup_keeps_everything_else(spark):
    df = spark.createDataFrame([(1, " a  b\n[X] a!"), (2, "c"), (3, None)], "id INT, t STRING")
    lexicon = spark.createDataFrame([("a", "AA"), ("[X]", "y")], "token STRING, replacement STRING")
    got = {r["id"]: r["t"] for r in lookup_tokens(df, "id", "t", lexicon).collect()}
    assert got == {1: " AA  b\ny AA!", 2: "c", 3: None}


def test_lookup_forms_agree_on_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "e"), (3, None)], "id INT, t STRING")
    entries = [("a", "A2"), ("a", "A1"), ("a", "A3"), (None, "N"), ("b", None), ("b", "B"), ("c", None), ("d", "D"), ("d", "D")]
    lexicon = spark.createDataFrame(entries, "token STRING, replacement STRING")
    for max_rows in (200_000, 1):
        got = {r["id"]: r["t"] for r in lookup_tokens(df, "id", "t", lexicon, max_rows).collect()}
        assert got == {1: "A1 B c D", 2: "e", 3: None}


def test_audits(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "k STRING")
    actual = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "k STRING, size INT")
    assert {r["k"] for r in missing_keys(expected, actual, "k").collect()} == {"c"}
    assert {r["k"] for r in missing_keys(expected, actual, "k", "size").collect()} == {"b", "c"}
    other = spark.createDataFrame([("a", 2), ("b", None)], "k STRING, size INT")
    assert {r["k"] for r in mismatches(actual.distinct(), other, "k", "size").collect()} == {"a", "b"}
    before = spark.createDataFrame([(1, "x", None), (2, "[T] y", "q")], "id INT, a STRING, b STRING")
    after = spark.createDataFrame([(1, "x", "z"), (2, "y", "q")], "id INT, a STRING, b STRING")
    assert changed_rows(before, after, "id", ["a", "b"]).count() == 2
    assert [r["id"] for r in changed_rows(before, after, "id", ["a", "b"], ["[T]"]).collect()] == [2]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_sessions_with_a_hot_key(spark, kind):
    rng = random.Random(5)
    start = datetime(2024, 3, 30, 20)
    rows = [
        (rng.choice(["hot"] * 5 + ["a", "b"]), start + timedelta(seconds=rng.randint(0, 400_000)))
        for _ in range(3000)
    ]
    events = spark.createDataFrame(rows, "k STRING, ts TIMESTAMP").withColumn("ts", F.col("ts").cast(kind))
    want = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key)
        first = last = times[0]
        n = 1
        for t in times[1:]:
            if (t - last).total_seconds() > 300:
                want.append((key, first, last, n))
                first, n = t, 0
            last, n = t, n + 1
        want.append((key, first, last, n))
    for bucket in (1_000, 86_400):
        sessions = activity_sessions(events, "k", "ts", 300, bucket)
        assert sorted(map(tuple, sessions.collect())) == sorted(want)
    idle = idle_intervals(activity_sessions(events, "k", "ts", 300), "k", 5_000)
    pauses = []
    for key in {w[0] for w in want}:
        mine = sorted(w for w in want if w[0] == key)
        pauses += [(key, a[2], b[1]) for a, b in zip(mine, mine[1:])]
    assert sorted(map(tuple, idle.collect())) == sorted(pauses)


def test_live_keys(spark):
    now = datetime(2024, 1, 1, 0, 0, 30)
    rows = [("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1, 0, 0, 1)), ("b", datetime(2023, 1, 1))]
    events = spark.createDataFrame(rows, "k STRING, ts TIMESTAMP")
    assert [r["k"] for r in live_keys(events, "k", "ts", now, 30).collect()] == ["b"]


def test_manifest_and_version(spark, tmp_path):
    for name in ("a.txt", "b.txt", "skip.txt"):
        (tmp_path / name).write_text(name)
    files = manifest(spark, str(tmp_path), "*.txt", ["skip.txt"])
    assert sorted((r["name"], r["length"]) for r in files.collect()) == [("a.txt", 5), ("b.txt", 5)]
    first = data_version(files).first()["version"]
    assert data_version(files.repartition(3)).first()["version"] == first
    os.utime(tmp_path / "a.txt", (1, 1))
    assert data_version(files).first()["version"] != first


def test_rules_file_and_emoji_class(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(
        rules_json({"emoji": {"unicode": {"[E]": "-]^❤😀😂"}}, "incorrect": {"char": {"b": "2", "a": "1"}}}),
        encoding="utf-8",
    )
    rules = RuleSet.collect(load_rules(spark, str(path)))
    assert rules.char == [("b", "2"), ("a", "1")]
    row = spark.range(1).select(
        F.regexp_replace(F.lit("x-]^❤😀😂y"), rules.emoji_set[0][0], "!").alias("out")
    ).first()
    assert row["out"] == "x!y"


def test_normalize_does_not_depend_on_partitions(spark):
    df = spark.range(60).selectExpr(
        "id", "'@user-가나' || id AS nickname", "'ㅋ ㅋ ① ' || id || ' 갠춘해!!' AS comment"
    )
    rules = RuleSet.collect(default_rules(spark))
    got = [sorted(map(tuple, normalize(df.repartition(n), rules).collect())) for n in (1, 7)]
    assert got[0] == got[1]


def test_stream_equals_batch_and_rules_refresh(spark, tmp_path):
    rules = RuleSet.collect(default_rules(spark))
    posts = spark.range(40).selectExpr("id", "'가나다' || id AS nickname", "'good ㅋ ㅋ. bad' AS comment")
    posts.repartition(2).write.parquet(str(tmp_path / "in"))
    weights = spark.createDataFrame(WEIGHTS, "token STRING, class_id INT, weight INT")
    labels = literal_rows(
        spark, "head STRING, class_id INT, label STRING",
        [(h, k, label) for h in ("nickname", "comment") for k, label in enumerate(("yes", "no"))],
    )
    scorers = {h: LexiconScorer(weights, 2) for h in ("nickname", "comment")}
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(stream, rules, scorers, labels, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    batch = classify_heads(normalize(posts, rules), scorers, labels)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, batch.collect()))

    live = tmp_path / "rules"
    live.mkdir()
    (live / "r.json").write_text(rules_json({"incorrect": {"word": {"good": "fine"}}}))
    seen = []
    refreshed = Refreshed(spark, str(live), lambda s, p: RuleSet.collect(load_rules(s, p)))

    def transform(batch_df, current):
        seen.append(current.word)
        (live / "r.json").write_text(rules_json({"incorrect": {"word": {"good": "better"}}}))
        return batch_df

    run_refreshing_stream(stream, refreshed, transform, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert seen == [[("good", "fine")], [("good", "better")]] and refreshed.loads == 2
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 40


@pytest.mark.parametrize("bad", [("a", -1, 5), ("a", 2, 5), ("a", None, 5), ("a", 0, None), (None, 0, 1)])
@pytest.mark.parametrize("inline_tokens", [0, 1_000])
def test_bad_weights_are_refused_by_both_forms(spark, bad, inline_tokens):
    weights = spark.createDataFrame([("b", 1, 1), bad], "token STRING, class_id INT, weight INT")
    with pytest.raises(ValueError, match="weight with a null or a class outside"):
        LexiconScorer(weights, 2, inline_tokens=inline_tokens)


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from postweave.plans.stream_queries import QUERIES
    from tests.conftest import SMALL

    for name in ("documents", "events"):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        rows.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        got = sorted(map(repr, query.run(spark, str(tmp_path)).collect()))
        assert got == sorted(map(repr, query.run(spark, SMALL).collect())), name


def test_sessions_of_parts_in_any_order_are_sessions_of_the_whole(spark):
    start = datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [("k", start + timedelta(seconds=rng.randrange(50_000))) for _ in range(300)]
    events = spark.createDataFrame(rows, "k STRING, ts TIMESTAMP")
    whole = activity_sessions(events, "k", "ts", 300)
    parts = [activity_sessions(spark.createDataFrame(rows[i::4], "k STRING, ts TIMESTAMP"), "k", "ts", 300) for i in range(4)]
    merged = merge_sessions(parts[0].union(parts[3]).union(parts[1]).union(parts[2]), "k", 300)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
