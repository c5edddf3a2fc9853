"""Incremental runs against full ones."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postweave.plans import table_queries
from postweave.sources.incremental import SOURCE, IncrementalRun
from postweave.sources.snapshots import remove

SCHEMA = "id INT, text STRING"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def split_words(df):
    return df.select("id", F.explode(F.split("text", " ")).alias("word"), SOURCE).where("word <> ''")


def full(spark, source):
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(source).withColumn(SOURCE, F.lit(""))
    return sorted(tuple(r) for r in split_words(rows).drop(SOURCE).collect())


def test_runs_equal_full_ones(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(3)
    job = IncrementalRun(spark, source, SCHEMA, root, split_words, "json")
    rows = lambda n: [(rng.randrange(99), rng.choice(["a b", "c", "", "d d e"])) for _ in range(n)]
    here = set()
    for turn in range(4):
        for _ in range(2):
            name = rng.choice("pqrst")
            put(spark, f"{source}/{name}", rows(rng.randrange(1, 30)))
            here.add(name)
        if turn == 2:
            gone = sorted(here)[0]
            remove(spark, f"{source}/{gone}")
            here.discard(gone)
        before = job.changes().where("change <> 'same'").count()
        counts = job.run()
        assert counts["added"] + counts["changed"] + counts["removed"] == before
        assert sorted(tuple(r) for r in job.result().collect()) == full(spark, source)
        assert job.run() == {"added": 0, "changed": 0, "removed": 0, "same": len(here)}
    job.compact()
    assert sorted(tuple(r) for r in job.result().collect()) == full(spark, source)
    assert job._committed().select("part").distinct().count() == 1


def test_only_new_and_changed_files_are_computed(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []

    def transform(df):
        seen.append(df.where(F.col(SOURCE).isNotNull()).select("id").distinct().count() if df.inputFiles() else 0)
        return split_words(df)

    for k in range(5):
        put(spark, f"{source}/{k}", [(k, "a b"), (k, "c")])
    job = IncrementalRun(spark, source, SCHEMA, root, transform, "json")
    job.run()
    put(spark, f"{source}/5", [(5, "x")])
    seen.clear()
    job.run()
    assert seen == [1]
    assert job.result().count() == 16


def test_a_run_that_dies_changes_nothing(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, f"{source}/a", [(1, "a b")])
    job = IncrementalRun(spark, source, SCHEMA, root, split_words, "json")
    assert job.result().count() == 0
    job.run()
    put(spark, f"{source}/b", [(2, "c")])

    def dies(df):
        return split_words(df).withColumn("word", F.raise_error(F.lit("gone")).cast("string"))

    with pytest.raises(Exception, match="gone"):
        IncrementalRun(spark, source, SCHEMA, root, dies, "json").run()
    assert sorted(r["word"] for r in job.result().collect()) == ["a", "b"]
    assert job.run()["added"] == 1
    assert sorted(r["word"] for r in job.result().collect()) == ["a", "b", "c"]


def test_folders_of_files_stand_for_files(spark, tmp_path):
    """A folder of many files is one entry: any file of it that comes, goes or changes makes it changed."""
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    job = IncrementalRun(spark, source, SCHEMA, root, split_words, "json", folders=True)
    write = lambda path, rows, mode="append": spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode(mode).json(path)
    for name in "abc":
        write(f"{source}/{name}", [(i, f"{name} x{i}") for i in range(9)])
    # A folder inside a folder is one of its own, and its rows are read once.
    write(f"{source}/a/k=1", [(7, "inner")])
    assert job.run() == {"added": 4, "changed": 0, "removed": 0, "same": 0}
    assert sorted(tuple(r) for r in job.result().collect()) == full(spark, source)
    write(f"{source}/b", [(10, "b more")])
    remove(spark, f"{source}/c")
    assert job.run() == {"added": 0, "changed": 1, "removed": 1, "same": 2}
    assert sorted(tuple(r) for r in job.result().collect()) == full(spark, source)
    job.compact()
    assert sorted(tuple(r) for r in job.result().collect()) == full(spark, source)


def test_the_incremental_query_writes_its_parts_by_many_tasks(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(60)] + [(None, "no id"), (6, None)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    found = table_queries._incremental(spark, str(tmp_path))
    got = [tuple(r) for r in found.select("id", "n_chars", "files_added", "files_changed", "files_removed", "files_same").collect()]
    want = [(i, t and len(t), 2, 0, 2, 3) for i, t in rows if i is not None and i % 6 != 4]
    assert sorted(got, key=str) == sorted(want, key=str)
    # Every part is several files, so no task wrote the whole of one.
    shared = spark.conf.get("spark.checkpoint.dir")
    newest = max(Path(shared).glob("incremental-in-*"), key=lambda p: p.stat().st_mtime)
    assert min(len(list(p.glob("part-*"))) for p in newest.iterdir()) > 1
