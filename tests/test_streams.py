"""Streams with state, and tables that are published as one version."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postweave.operators.activity import activity_sessions, live_keys
from postweave.plans import stream_queries
from postweave.session import literal_rows
from postweave.sources.snapshots import Published, commits, current, drop_old, publish
from postweave.streaming.activity import open_sessions, run_closed_sessions, run_live_stream

START = datetime(2024, 5, 1)
KIND = "k STRING, ts TIMESTAMP"


def events(n=600, seed=4):
    """Keys with pauses around the gap of 60 s, one of them hot, one null; repeated times."""
    rng = random.Random(seed)
    rows, at = [], 0.0
    for _ in range(n):
        at += rng.choice([0, 0.5, 3, 20, 60, 60.000001, 61, 200]) / 2
        rows.append((rng.choice(["hot", "hot", "hot", "a", "b", None]), START + timedelta(seconds=at)))
    return rows


def arrive(spark, path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def out_of_order(rows, parts, delay):
    """Rows in files; each may come up to ``delay`` seconds after a later one."""
    rng = random.Random(9)
    timed = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, delay)))
    size = -(-len(timed) // parts)
    return [timed[i : i + size] for i in range(0, len(timed), size)]


def as_rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select("k", "session_start", "session_end", "n_events").collect())))


def test_closed_sessions_survive_a_restart_and_are_written_once(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / name) for name in ("in", "out", "state"))
    rows = events()
    files = out_of_order(rows, 8, 300)
    seen = []

    def run():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
        query = run_closed_sessions(stream, "k", "ts", 60, 600, sink, checkpoint)
        query.awaitTermination()
        return query

    for at, part in enumerate(files):
        arrive(spark, source, part)
        seen += part
        if at in (2, 5, 7):  # a run ends here, the next one starts from its checkpoint
            query = run()
            dropped = [s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]]
            assert not any(dropped)
            whole = activity_sessions(spark.createDataFrame(seen, KIND), "k", "ts", 60)
            closed, still = spark.read.parquet(sink), open_sessions(spark, checkpoint, "k")
            assert as_rows(closed.unionByName(still)) == as_rows(whole)
    assert closed.count() > 20
    latest = max(ts for _, ts in rows)
    # The state holds what the last watermark could not close, not the history.
    oldest = still.agg(F.min("session_end")).first()[0]
    assert oldest > latest - timedelta(seconds=600 + 60 + 900)
    assert still.count() < closed.count()


def version(spark, n):
    return {
        name: literal_rows(spark, "version INT, name STRING", [(n, name)]) for name in ("rules", "labels", "weights")
    }


def versions_read(spark, snapshot):
    return [snapshot.table(spark, name).first()["version"] for name in ("rules", "labels", "weights")]


def test_a_version_published_while_another_is_read_is_not_mixed_in(spark, tmp_path):
    root = str(tmp_path / "live")
    assert current(spark, root) is None
    publish(spark, root, version(spark, 0))

    def load(session, snapshot):
        first = snapshot.table(session, "rules").first()["version"]
        if snapshot.number < 2:
            publish(session, root, version(session, snapshot.number + 1))
        rest = [snapshot.table(session, name).first()["version"] for name in ("labels", "weights")]
        return [first, *rest]

    held = Published(spark, root, load)
    assert [held.get() for _ in range(4)] == [[0] * 3, [1] * 3, [2] * 3, [2] * 3]
    assert held.loads == 3


def test_commits_are_numbered_once_and_torn_ones_are_not_seen(spark, tmp_path):
    root = str(tmp_path / "live")
    with pytest.raises(ValueError):
        Published(spark, root, versions_read).get()
    first = publish(spark, root, version(spark, 0))
    second = publish(spark, root, version(spark, 1))
    assert (first.number, second.number) == (0, 1)
    # A publisher that died in the middle of its commit.
    (tmp_path / "live" / "commits" / f"{2:012d}").write_text(second.path[-10:])
    assert current(spark, root) == second
    third = publish(spark, root, version(spark, 2))
    assert third.number == 3 and versions_read(spark, current(spark, root)) == [2] * 3
    assert drop_old(spark, root, keep=1) == [0, 1]
    assert [r["number"] for r in commits(spark, root).collect()] == [3]
    assert versions_read(spark, current(spark, root)) == [2] * 3


def test_the_posts_of_a_batch_are_written_by_many_tasks(spark, tmp_path):
    """Even and odd posts, in as many files as the input has splits; the even ones are one batch."""
    rows = [(i, f"text {i}", "en", "src1", 6) for i in range(200)] + [(None, "no id", "en", None, 5)]
    kind = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    spark.createDataFrame(rows, kind).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    batches = []
    stream = stream_queries._two_files(spark, str(tmp_path))
    query = stream.writeStream.foreachBatch(
        lambda df, _: batches.append(df.select("id", F.input_file_name().alias("file")).collect())
    )
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [sorted(r["id"] for r in b) for b in batches] == [list(range(0, 200, 2)), list(range(1, 200, 2))]
    assert all(len({r["file"] for r in b}) > 1 for b in batches)


def test_live_keys_hold_few_versions(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / name) for name in ("in", "out", "state"))
    rows = [r for r in events() if r[0]]
    for at, part in enumerate(out_of_order(rows, 6, 100)):
        arrive(spark, source, part)
        if at in (3, 5):
            stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
            run_live_stream(stream, "k", "ts", 90, sink, checkpoint).awaitTermination()
    versions = sorted(int(p.name[8:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("version="))
    assert versions == [4, 5]
    last = max(ts for _, ts in rows)
    want = live_keys(spark.createDataFrame(rows, KIND), "k", "ts", last, 90)
    found = spark.read.parquet(f"{sink}/version=5")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
