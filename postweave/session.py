"""Session settings, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a broadcast side may hold.  Beyond it callers use a shuffle join.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Whole texts travel to the Arrow step: batches bounded by bytes, not rows.
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
    # Chains are hundreds of column calls; looking up the Python line of each one
    # takes longer than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Sessions are merged inside a task before a stream shuffles them.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def local_session(
    cores: int | str = "*", name: str = "postweave", scratch: str | None = None
) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``.  Where it is unset the warehouse
    holds it, but only if all runs in one process: a cluster's executors may not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def literal_rows(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A few rows as one literal of the plan: unlike ``createDataFrame`` on a list,
    reading them starts no Python worker."""
    kind = T.StructType.fromDDL(schema)
    text = json.dumps([dict(zip(kind.names, row)) for row in rows], ensure_ascii=False)
    parsed = F.from_json(F.lit(text), T.ArrayType(kind))
    return spark.range(0, 1, 1, 1).select(F.inline(parsed))


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether ``df`` is within both bounds; reads at most ``max_rows + 1`` rows."""
    measured = (
        df.limit(max_rows + 1)
        .select(F.octet_length(F.to_json(F.struct("*"))).alias("size"))
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
        .first()
    )
    return measured["n"] <= max_rows and measured["size"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if its measured size allows it."""
    if is_small(df, max_rows):
        return F.broadcast(df), True
    return df, False


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give the CPU-heavy text steps work for all cores.

    Large inputs have more file splits than cores and pass through untouched;
    only an input with fewer splits is redistributed, by hash of its unique key,
    which lands a re-run task's rows where the first run put them.  For scans:
    counting the splits of a plan with a shuffle would run it.
    """
    if df.isStreaming:
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, key)
