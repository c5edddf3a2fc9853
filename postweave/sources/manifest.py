"""What input files there are, and a version of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(
    spark: SparkSession, path: str, glob: str = "*", exclude: Sequence[str] = ()
) -> DataFrame:
    """All files under ``path`` as ``path, name, length, modificationTime``.

    File contents are not read: only metadata columns are selected.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
        .withColumn("name", F.element_at(F.split("path", "/"), -1))
    )
    return without_names(files, "name", exclude)


def scan_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The files behind some scans, as the scans know them, with the rows read from each:
    ``table, path, name, length, modificationTime, n_rows``."""
    found = [
        scan.select(
            F.lit(table).alias("table"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("name"),
            F.col("_metadata.file_size").alias("length"),
            F.col("_metadata.file_modification_time").alias("modificationTime"),
        )
        for table, scan in tables.items()
    ]
    rows = reduce(DataFrame.union, found)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n_rows"))


def without_names(df: DataFrame, name: str, exclude: Sequence[str]) -> DataFrame:
    """Rows whose name is not on an exclusion list."""
    return df.where(~F.col(name).isin(list(exclude))) if exclude else df


def file_version(modified: Column, length: Column) -> Column:
    """Version of one file: md5 of ``"time-size"``."""
    return F.md5(F.concat_ws("-", modified.cast("string"), length.cast("string")).cast("binary"))


def data_version(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One version for a whole manifest, or for each group of it, in any order of its files.

    Per-file hashes are combined by count, xor and sum, which Spark adds up
    inside each task: no list of files is ever gathered.
    """
    one = F.xxhash64(
        "path", file_version(F.col("modificationTime"), F.col("length"))
    )
    return files.groupBy(*by).agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"),
        F.bit_xor(one).alias("x"),
        F.sum(one.cast("decimal(38,0)")).alias("s"),
    ).select(
        *by,
        "n_files",
        "n_bytes",
        F.md5(
            F.concat_ws("-", *[F.col(c).cast("string") for c in ("n_files", "n_bytes", "x", "s")]).cast(
                "binary"
            )
        ).alias("version"),
    )
