"""Every registered query on the small tables, and its SQL where it has one."""

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from postweave.llm.queries import ORACLE_SQL, QUERIES
from postweave.plans.registry import Query
from tests.compare import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    message, rows = compare(spark, con, Query(QUERIES[name], ORACLE_SQL.get(name)), SMALL)
    assert not message
    assert rows > 0


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert set(ORACLE_SQL) <= set(entry_points.oracle_sql())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_oracle_sql_is_sql():
    assert all(isinstance(sql, str) for sql in entry_points.oracle_sql().values())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        assert docs.columns == names
        sizes.append(docs.count())
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= ids
        if name != "mix_sources":
            assert sizes[-1] == len(kept)
        if name == "substring_dedup":
            assert kept == {r["doc_id"] for r in before.select("doc_id").collect()}
        ids = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in packed} == ids
    assert sum(r["piece"] == 0 for r in packed) == sizes[-1]
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]


def test_pipeline_on_no_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
