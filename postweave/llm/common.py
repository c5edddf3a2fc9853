"""What the operators share: folds, whole-text batches, written intermediates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.session import scratch_path

#: Text bytes handled at once inside a task; bounds the arrays made from them.
SLICE_BYTES = 2 << 20

#: Rows that an operator's own writes hand to Python at once.
BATCH_ROWS = 2000

#: Separators of words, for a Java pattern.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to Python a few megabytes at a time while this holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: the lineage ends here,
    and a lost executor costs its own tasks only."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass ``limit`` bytes; a longer text is a slice of its own."""
    lengths = batch.column(column).cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)
    # What the batch took goes back to the system, not to the next one.
    pa.default_memory_pool().release_unused()
