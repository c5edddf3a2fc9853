"""Activity of keys on a stream of events.

Two forms of sessions.  ``run_session_stream`` waits for nothing: each micro-batch leaves what
it knows in a table, and the tables are merged when they are read, so an event that comes
late counts like any other.  ``run_closed_sessions`` keeps the open sessions in the
state store and writes each session once, when the watermark has passed it: nothing is
read again, and the state holds open sessions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postweave.operators.activity import activity_sessions, expire_keys, merge_sessions
from postweave.sources.snapshots import remove

SESSION_COLUMNS = ("session_start", "session_end", "n_events")


def run_session_stream(
    events: DataFrame, key: str, ts: str, gap_seconds: float, sink: str, checkpoint: str, trigger: Mapping | None = None
) -> StreamingQuery:
    """Write the sessions of each micro-batch to ``sink``.

    A batch is cut by key and time bucket, so a key with a third of all events is spread
    over its buckets.  A batch that runs again overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = activity_sessions(batch, key, ts, gap_seconds)
        done.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_sessions(written: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """All sessions so far, open ones too, of what ``run_session_stream`` wrote."""
    return merge_sessions(written.drop("batch"), key, gap_seconds)


def closed_sessions(events: DataFrame, key: str, ts: str, gap_seconds: float, delay_seconds: float) -> DataFrame:
    """``key, session_start, session_end, n_events`` of a stream, each session once.

    A session is closed when the watermark, the latest event time less ``delay_seconds``, is
    past its end and the gap; only then can no event that is still taken extend it.  An
    event older than the watermark that touches no open session is dropped, and counted
    by the query's progress (``numRowsDroppedByWatermark``).  Events without key are a key; those
    without time are dropped.  Events of one key are put together into sessions inside
    the task that read them (``session.SETTINGS``), so a hot key sends a row per session.
    Times without zone are taken as times of the session's zone, which is UTC there.
    """
    kind = events.schema[ts].dataType
    timed = events.where(F.col(ts).isNotNull()).select(F.col(key), F.col(ts).cast("timestamp").alias("__at"))
    window = F.session_window("__at", f"{round(gap_seconds * 1_000_000)} microseconds").alias("__window")
    sessions = (
        timed.withWatermark("__at", f"{round(delay_seconds * 1_000_000)} microseconds")
        .groupBy(key, window)
        .agg(F.min("__at").alias("session_start"), F.max("__at").alias("session_end"), F.count("*").alias("n_events"))
    )
    return _as(sessions, key, kind)


def _as(sessions: DataFrame, key: str, kind: T.DataType | str) -> DataFrame:
    ends = [F.col(name).cast(kind).alias(name) for name in ("session_start", "session_end")]
    return sessions.select(key, *ends, "n_events")


def run_closed_sessions(
    events: DataFrame,
    key: str,
    ts: str,
    gap_seconds: float,
    delay_seconds: float,
    sink: str,
    checkpoint: str,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Append each session to ``sink`` when it is closed; started again with the same checkpoint,
    it goes on with the sessions that were open."""
    return (
        closed_sessions(events, key, ts, gap_seconds, delay_seconds)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def open_sessions(spark: SparkSession, checkpoint: str, key: str, kind: T.DataType | str = "timestamp") -> DataFrame:
    """The sessions that ``run_closed_sessions`` has not closed yet, read from its state.

    With what it wrote they are all sessions of the events taken so far.  ``kind`` is the type of
    the events' time.
    """
    state = spark.read.format("statestore").load(checkpoint).select("value.*")
    names = [key, "session_window", *SESSION_COLUMNS]
    return _as(state.toDF(*names), key, kind)


def run_live_stream(
    events: DataFrame,
    key: str,
    ts: str,
    ttl_seconds: float,
    sink: str,
    checkpoint: str,
    trigger: Mapping | None = None,
    keep: int = 2,
) -> StreamingQuery:
    """Keep the latest event of each live key: version ``n`` of the table is written by
    batch ``n`` from the version before and the batch.

    ``now`` is the latest event time seen; a key whose last event is ``ttl_seconds`` or
    more before it has expired and leaves the table, so the table holds live keys only.  The
    last ``keep`` versions stay, two at least: the one before is what a batch that is run
    again starts from.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(key).agg(F.max(ts).alias("last_seen"))
        if batch_id:
            latest = latest.unionByName(spark.read.parquet(f"{sink}/version={batch_id - 1}"))
        expire_keys(latest, key, ttl_seconds).write.mode("overwrite").parquet(f"{sink}/version={batch_id}")
        if batch_id >= max(keep, 2):
            remove(spark, f"{sink}/version={batch_id - max(keep, 2)}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
