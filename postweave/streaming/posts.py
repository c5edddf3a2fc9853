"""Continuous normalization and classification."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from postweave.operators.classify import classify_heads
from postweave.operators.normalize import normalize
from postweave.operators.scorers import Scorer
from postweave.sources.manifest import data_version, manifest
from postweave.sources.rules import RuleSet
from postweave.sources.snapshots import Published


def stream_posts(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of the files that arrive under ``path``."""
    reader = spark.readStream.schema(schema).format(fmt)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def classified(
    posts: DataFrame, rules: DataFrame | RuleSet, scorers: Mapping[str, Scorer], labels: DataFrame
) -> DataFrame:
    """Normalize and classify; on a stream and on a table.

    With scorers that average inside the row there is no state, so a stream runs
    in append mode without a watermark.
    """
    return classify_heads(normalize(posts, rules), scorers, labels)


def run_stream(
    posts: DataFrame,
    rules: DataFrame | RuleSet,
    scorers: Mapping[str, Scorer],
    labels: DataFrame,
    sink: str,
    checkpoint: str,
    fmt: str = "parquet",
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Start writing classified posts to ``sink``."""
    return (
        classified(posts, rules, scorers, labels)
        .writeStream.format(fmt)
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class Refreshed:
    """Something built from files, built again when the files change.

    The version is compared before each use: one listing, no file contents.  Files that change
    while they are read may be of two versions; ``snapshots.Published`` rules that out.
    """

    def __init__(self, spark: SparkSession, path: str, load: Callable[[SparkSession, str], object]):
        self.spark, self.path, self._load = spark, path, load
        self.version: str | None = None
        self.loads = 0
        self._value: object = None

    def get(self):
        version = data_version(manifest(self.spark, self.path)).first()["version"]
        if version != self.version:
            self._value = self._load(self.spark, self.path)
            self.version = version
            self.loads += 1
        return self._value


def run_refreshing_stream(
    posts: DataFrame,
    rules: Refreshed | Published,
    transform: Callable[[DataFrame, object], DataFrame],
    sink: str,
    checkpoint: str,
    fmt: str = "parquet",
    trigger: Mapping | None = None,
    after: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Stream that picks up changed rules, labels and weights between micro-batches.

    ``rules.get()`` is whatever ``transform`` needs; ``after`` is called with the number of
    each batch that is written.

    Each batch is written to its own folder, overwritten when the batch is run
    again after a failure, so every post is in the sink once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = transform(batch, rules.get())
        done.write.format(fmt).mode("overwrite").save(f"{sink}/batch={batch_id}")
        if after:
            after(batch_id)

    return (
        posts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
