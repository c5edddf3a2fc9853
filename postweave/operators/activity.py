"""Activity of keys in an event log."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Short enough that one bucket of a key with a third of a very large log is
# still one task's work.
BUCKET_SECONDS = 600


def live_keys(
    events: DataFrame, key: str, ts: str, now: datetime | Column, ttl_seconds: float
) -> DataFrame:
    """Keys whose latest event is less than ``ttl_seconds`` before ``now``."""
    at = (now if isinstance(now, Column) else F.lit(now)).cast(events.schema[ts].dataType)
    latest = events.groupBy(key).agg(F.max(ts).alias("last_seen"))
    return latest.where(at - F.col("last_seen") < _interval(ttl_seconds))


def expire_keys(seen: DataFrame, key: str, ttl_seconds: float) -> DataFrame:
    """Latest ``last_seen`` per key without the keys that expired by the latest of all."""
    latest = seen.groupBy(key).agg(F.max("last_seen").alias("last_seen"))
    now = latest.agg(F.max("last_seen").alias("__now"))
    return latest.join(F.broadcast(now), F.col("__now") - F.col("last_seen") < _interval(ttl_seconds)).drop("__now")


def merge_sessions(sessions: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """Merge sessions that several parts of a log were cut into, in any order: those that
    overlap or lie within the gap of each other are one."""
    reach = F.max("session_end").over(
        Window.partitionBy(key).orderBy("session_start", "session_end").rowsBetween(Window.unboundedPreceding, -1)
    )
    pause = F.col("session_start") - reach
    order = Window.partitionBy(key).orderBy("session_start", "session_end")
    return (
        sessions.withColumn("__new", F.when(reach.isNull() | (pause > _interval(gap_seconds)), 1).otherwise(0))
        .withColumn("__no", F.sum("__new").over(order))
        .groupBy(key, "__no")
        .agg(
            F.min("session_start").alias("session_start"),
            F.max("session_end").alias("session_end"),
            F.sum("n_events").alias("n_events"),
        )
        .drop("__no")
    )


def _interval(seconds: float) -> Column:
    return F.make_dt_interval(secs=F.lit(Decimal(str(seconds))).cast("decimal(18,6)"))


def _bucket(events: DataFrame, ts: str, seconds: int) -> Column:
    """Number of the time bucket; the same for timestamps with and without zone."""
    kind = events.schema[ts].dataType.simpleString()
    since = f"({ts} - CAST('1970-01-01 00:00:00' AS {kind}))"
    whole = (
        f"extract(DAY FROM {since}) * 86400L + extract(HOUR FROM {since}) * 3600 "
        f"+ extract(MINUTE FROM {since}) * 60 + floor(extract(SECOND FROM {since}))"
    )
    return F.floor(F.expr(whole) / seconds)


def activity_sessions(
    events: DataFrame,
    key: str,
    ts: str,
    gap_seconds: float,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Active intervals per key: a pause longer than ``gap_seconds`` ends one.

    ``(key, session_start, session_end, n_events)``; start and end are the first
    and last event.  Sessions are first built per key and time bucket, so a key
    with a third of all events is spread over its buckets.  Only the first and
    last session of a bucket can go on in a neighbour; just those are merged per
    key, at most two rows per bucket.
    """
    rows = events.where(F.col(ts).isNotNull()).select(
        F.col(key), F.col(ts).alias("__t"), _bucket(events, ts, bucket_seconds).alias("__bucket")
    )
    in_bucket = Window.partitionBy(key, "__bucket").orderBy("__t")
    local = (
        rows.withColumn("__new", _starts("__t", "__t", in_bucket, gap_seconds))
        .withColumn("__no", F.sum("__new").over(in_bucket))
        .groupBy(key, "__bucket", "__no")
        .agg(F.min("__t").alias("__start"), F.max("__t").alias("__end"), F.count("*").alias("n"))
    )
    whole_bucket = Window.partitionBy(key, "__bucket")
    edge = (F.col("__no") == 1) | (F.col("__no") == F.max("__no").over(whole_bucket))
    slotted = local.withColumn("__slot", F.when(edge, F.lit(None)).otherwise(F.col("__bucket")))
    in_slot = Window.partitionBy(key, "__slot").orderBy("__start")
    return (
        slotted.withColumn("__new", _starts("__start", "__end", in_slot, gap_seconds))
        .withColumn("__no", F.sum("__new").over(in_slot))
        .groupBy(key, "__slot", "__no")
        .agg(
            F.min("__start").alias("session_start"),
            F.max("__end").alias("session_end"),
            F.sum("n").alias("n_events"),
        )
        .select(key, "session_start", "session_end", "n_events")
    )


def _starts(start: str, end: str, window, gap_seconds: float) -> Column:
    before = F.lag(end).over(window)
    pause = F.col(start) - before
    return F.when(before.isNull() | (pause > _interval(gap_seconds)), 1).otherwise(0)


def idle_intervals(
    sessions: DataFrame, key: str, bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """Pauses between the sessions of a key: ``(key, idle_start, idle_end)``.

    The session before is looked up inside a time bucket; the first session of a
    bucket takes the latest end of the buckets before it, one row per bucket.
    """
    bucketed = sessions.withColumn("__bucket", _bucket(sessions, "session_start", bucket_seconds))
    by_bucket = Window.partitionBy(key).orderBy("__bucket")
    earlier = (
        bucketed.groupBy(key, "__bucket")
        .agg(F.max("session_end").alias("__last"))
        .withColumn("__before", F.lag("__last").over(by_bucket))
        .select(key, "__bucket", "__before")
    )
    in_bucket = Window.partitionBy(key, "__bucket").orderBy("session_start")
    return (
        bucketed.withColumn("__previous", F.lag("session_end").over(in_bucket))
        .join(earlier, [key, "__bucket"])
        .withColumn("idle_start", F.coalesce("__previous", "__before"))
        .where(F.col("idle_start").isNotNull())
        .select(key, "idle_start", F.col("session_start").alias("idle_end"))
    )
