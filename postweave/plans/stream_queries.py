"""Streams over the given tables, run until the available files are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.functions.steps import fix_words
from postweave.functions.windows import WindowOptions
from postweave.operators.classify import classify, classify_heads
from postweave.operators.scorers import LexiconScorer
from postweave.plans.classify_queries import HEADS_SQL, flat_heads, label_table, scorers
from postweave.plans.corpus import COMMENT, NICKNAME, table
from postweave.plans.registry import Query
from postweave.plans.table_queries import (
    GAP_SECONDS,
    LIVE_SQL,
    SESSIONS_SQL,
    TTL_SECONDS,
    token_list_sql,
)
from postweave.plans.text_queries import RULES
from postweave.session import literal_rows, scratch_path
from postweave.sources.manifest import manifest
from postweave.sources.rules import RULE_FILE_SCHEMA, RuleSet, flatten_rules, load_rules, rules_json
from postweave.sources.snapshots import Published, publish
from postweave.streaming.activity import (
    closed_sessions,
    open_sessions,
    run_closed_sessions,
    run_live_stream,
    run_session_stream,
    stream_sessions,
)
from postweave.streaming.posts import Refreshed, run_refreshing_stream, run_stream, stream_posts

#: How late an event may come, and files in which they come.
DELAY_SECONDS = 24 * 3600
ARRIVALS = 6


def _documents(spark, sf_dir):
    return stream_posts(
        spark,
        # A pattern: a plain path would have to be a folder.
        f"{sf_dir}/documents[.]parquet",
        "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    )


def _events(spark, sf_dir):
    """The events as a stream of four files, dealt by id: every batch is out of order
    with the others."""
    path = scratch_path(spark, "events")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    rows.repartition(4, F.col("event_id") % 4).write.parquet(path)
    return stream_posts(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "), maxFilesPerTrigger=1)


def _stream_classify(spark, sf_dir):
    labels = label_table(spark, sf_dir)
    posts = _documents(spark, sf_dir).selectExpr(
        "doc_id AS id", f"lower({NICKNAME}) AS nickname", f"lower({COMMENT}) AS comment"
    )
    sink, checkpoint = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-state")
    done = classify_heads(posts, scorers(spark, labels), labels)
    query = (
        done.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return flat_heads(spark.read.parquet(sink))


def _stream_normalize_classify(spark, sf_dir):
    labels = label_table(spark, sf_dir)
    posts = _documents(spark, sf_dir).selectExpr(
        "doc_id AS id", f"{NICKNAME} AS nickname", f"{COMMENT} AS comment"
    )
    sink, checkpoint = scratch_path(spark, "posts-sink"), scratch_path(spark, "posts-state")
    run_stream(posts, RULES, scorers(spark, labels), labels, sink, checkpoint).awaitTermination()
    return flat_heads(spark.read.parquet(sink))


def _two_files(spark, sf_dir):
    """The posts with even ids as files of a first batch, then those with odd ids.

    Each split of the input is written by its own task, so the even posts are as many files
    as a batch takes; odd posts in more files than that go on in further batches."""
    source = scratch_path(spark, "two-files")
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "source AS nickname", "text AS comment")
    rows.where("id % 2 = 0").write.parquet(source)
    first = manifest(spark, source, "part-*").count()
    rows.where("id % 2 = 1").write.mode("append").parquet(source)
    return stream_posts(spark, source, "id BIGINT, nickname STRING, comment STRING", maxFilesPerTrigger=first)


def _version(spark, number: int):
    """Rules, label names and weights of a version."""
    text = rules_json({"incorrect": {"sentence": [["[aeiou]+", "_" if number == 0 else "#"]]}})
    names = [("comment", k, f"v{number}-{name}") for k, name in enumerate(("no", "yes"))]
    weights = [("_" if number == 0 else "#", 1, 5)]
    return {
        "rules": literal_rows(spark, "value STRING", [(text,)]),
        "labels": literal_rows(spark, "head STRING, class_id INT, label STRING", names),
        "weights": literal_rows(spark, "token STRING, class_id INT, weight INT", weights),
    }


def _fix_and_classify(batch, held):
    rules, model, labels = held
    fixed = batch.select("id", fix_words(F.lower("comment"), rules).alias("comment"))
    done = classify(fixed, model, labels, "comment", options=WindowOptions(1 << 30))
    return done.select("id", "comment", "comment_result.predicted")


def _stream_refreshed_rules(spark, sf_dir):
    """Two batches: rules, labels and weights change between them."""
    live = scratch_path(spark, "live")

    def publish(number: int) -> None:
        for name, df in _version(spark, number).items():
            writer = df.coalesce(1).write.mode("overwrite")
            writer.text(f"{live}/{name}") if name == "rules" else writer.parquet(f"{live}/{name}")

    def load(session, path):
        labels = session.read.parquet(f"{path}/labels")
        weights = session.read.parquet(f"{path}/weights")
        return RuleSet.collect(load_rules(session, f"{path}/rules")), LexiconScorer(weights, 2), labels

    publish(0)
    current = Refreshed(spark, live, load)
    sink, checkpoint = scratch_path(spark, "rules-sink"), scratch_path(spark, "rules-state")
    run_refreshing_stream(
        _two_files(spark, sf_dir),
        current,
        _fix_and_classify,
        sink,
        checkpoint,
        after=lambda batch_id: publish(1) if batch_id == 0 else None,
    ).awaitTermination()
    return spark.read.parquet(sink).select("id", "comment", "predicted")


def _stream_snapshots(spark, sf_dir):
    """Two batches; the second version is published while the first is being loaded."""
    root = scratch_path(spark, "snapshots")

    def load(session, snapshot):
        parsed = snapshot.table(session, "rules").select(F.from_json("value", RULE_FILE_SCHEMA).alias("rules"))
        rules = RuleSet.collect(flatten_rules(parsed.select("rules.*")))
        if snapshot.number == 0:
            publish(session, root, _version(session, 1))
        return rules, LexiconScorer(snapshot.table(session, "weights"), 2), snapshot.table(session, "labels")

    publish(spark, root, _version(spark, 0))
    sink, checkpoint = scratch_path(spark, "snapshots-sink"), scratch_path(spark, "snapshots-state")
    run_refreshing_stream(
        _two_files(spark, sf_dir), Published(spark, root, load), _fix_and_classify, sink, checkpoint
    ).awaitTermination()
    return spark.read.parquet(sink).select("id", "comment", "predicted")


def _refreshed_sql() -> str:
    fixed = "regexp_replace(lower(text), '[aeiou]+', CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '#' END, 'g')"
    own = "CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '#' END"
    tokens = token_list_sql("comment")
    return (
        f"WITH f AS (SELECT doc_id, {own} AS sign, {fixed} AS comment FROM documents) "
        f"SELECT doc_id AS id, comment, 'v' || doc_id % 2 || CASE WHEN list_contains({tokens}, sign) "
        "THEN '-yes' ELSE '-no' END AS predicted FROM f"
    )


def _stream_sessions(spark, sf_dir):
    sink, checkpoint = scratch_path(spark, "sessions"), scratch_path(spark, "sessions-state")
    run_session_stream(_events(spark, sf_dir), "user_id", "ts", GAP_SECONDS, sink, checkpoint).awaitTermination()
    return stream_sessions(spark.read.parquet(sink), "user_id", GAP_SECONDS)


def _late_events(spark, sf_dir):
    """The events as a stream of files in which those of up to ``DELAY_SECONDS`` later may be
    ahead: files go by time plus a shift that depends on the id."""
    path = scratch_path(spark, "late-events")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    shifted = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 + F.col("event_id") * 7919 % DELAY_SECONDS
    rows = rows.withColumn("arrival", shifted)
    first, last = rows.agg(F.min("arrival"), F.max("arrival")).first()
    part = F.floor((F.col("arrival") - F.lit(first)) / (F.lit(last) - F.lit(first) + 1) * ARRIVALS)
    rows = rows.withColumn("part", part)
    # One after the other: a stream takes files in the order they were written.
    for k in range(ARRIVALS):
        rows.where(F.col("part") == k).select("event_id", "ts", "user_id").coalesce(1).write.mode("append").parquet(path)
    schema = "event_id BIGINT, ts " + rows.schema["ts"].dataType.simpleString() + ", user_id BIGINT"
    return stream_posts(spark, path, schema, maxFilesPerTrigger=1)


def _stream_closed(spark, sf_dir):
    """Closed sessions as they were written, and those still open in the state."""
    sink, checkpoint = scratch_path(spark, "closed"), scratch_path(spark, "closed-state")
    events = _late_events(spark, sf_dir)
    run_closed_sessions(events, "user_id", "ts", GAP_SECONDS, DELAY_SECONDS, sink, checkpoint).awaitTermination()
    closed = spark.read.schema(closed_sessions(events, "user_id", "ts", GAP_SECONDS, DELAY_SECONDS).schema).parquet(sink)
    return closed.unionByName(open_sessions(spark, checkpoint, "user_id", events.schema["ts"].dataType))


def _stream_live(spark, sf_dir):
    sink, checkpoint = scratch_path(spark, "live-keys"), scratch_path(spark, "live-keys-state")
    run_live_stream(_events(spark, sf_dir), "user_id", "ts", TTL_SECONDS, sink, checkpoint).awaitTermination()
    versions = spark.read.parquet(sink)
    return versions.where(F.col("version") == versions.agg(F.max("version")).first()[0]).drop("version")


QUERIES: dict[str, Query] = {
    "stream_classify": Query(_stream_classify, HEADS_SQL),
    "stream_normalize_classify": Query(_stream_normalize_classify),
    "stream_refreshed_rules": Query(_stream_refreshed_rules, _refreshed_sql()),
    "stream_snapshots": Query(_stream_snapshots, _refreshed_sql()),
    "stream_closed_sessions": Query(_stream_closed, f"{SESSIONS_SQL} SELECT * FROM s"),
    "stream_sessions": Query(_stream_sessions, f"{SESSIONS_SQL} SELECT * FROM s"),
    "stream_live_keys": Query(_stream_live, LIVE_SQL),
}
