"""Stages of the pipeline on tables with shared ids and clashing column names."""

from __future__ import annotations

from postweave.llm import mixing, near_dedup

LONG = " ".join(f"word{k}" for k in range(60))
OTHER = " ".join(f"unlike{k}" for k in range(60))


def near(text, k):
    return text + f" tail{k}"


def test_unlike_texts_of_one_id_all_stay(spark):
    rows = [(3, LONG), (7, near(LONG, 1)), (7, OTHER), (7, OTHER), (9, near(OTHER, 2)), (5, "a b"), (5, "c d"), (5, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["text"]) for r in near_dedup.drop_near_duplicates(docs).collect())
    ids, texts = [i for i, _ in got], [t for _, t in got]
    assert texts.count("a b") == texts.count("c d") == 1 and ids.count(5) == 2
    assert sum(t.startswith("word0 ") for t in texts) == 1 and (3, LONG) in got
    assert sum(t.startswith("unlike0 ") for t in texts) == 1
    assert len(got) == 4


def test_null_and_empty_texts_of_shared_ids(spark):
    rows = [(1, None), (1, ""), (1, ""), (2, None), (None, "x"), (None, "x"), (2, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_dedup.drop_near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, None), (1, ""), (2, None), (None, "x"), (None, "x"), (2, LONG)], key=repr)


def test_column_names_that_operators_once_used(spark):
    names = ["marked", "stays", "n", "kept", "component", "servings", "rows", "served_id", "serving", "nth", "size", "rank"]
    columns = ", ".join(f"{c} string" for c in names)
    rows = [(i, t, "s", *(f"{c}{i}" for c in names)) for i, t in enumerate([LONG, near(LONG, 1), OTHER, "short text"])]
    rows.append((3, "another text", "s", *(f"{c}-" for c in names)))
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {columns}")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] != 1}
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows)


def test_no_rows(spark, no_docs):
    assert near_dedup.drop_near_duplicates(no_docs).collect() == []
