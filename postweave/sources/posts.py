"""Post and label scans.  Schemas are always explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweave.functions.text import strip

POST_SCHEMA = "id BIGINT, nickname STRING, comment STRING"
REQUEST_SCHEMA = "items ARRAY<STRUCT<nickname: STRING, comment: STRING>>"
LABEL_SCHEMA = "ord BIGINT, nickname_class STRING, comment_class STRING"
TESTSET_SCHEMA = "id BIGINT, nickname STRING, comment STRING"


def read_posts(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    id_col: str = "id",
    nickname_col: str = "nickname",
    comment_col: str = "comment",
) -> DataFrame:
    """Posts as ``id, nickname, comment`` from a table with any column names."""
    schema = T.StructType(
        [
            T.StructField(id_col, T.LongType()),
            T.StructField(nickname_col, T.StringType()),
            T.StructField(comment_col, T.StringType()),
        ]
    )
    rows = spark.read.schema(schema).format(fmt).load(path)
    return rows.select(
        F.col(id_col).alias("id"),
        F.col(nickname_col).alias("nickname"),
        F.col(comment_col).alias("comment"),
    )


def explode_request(df: DataFrame, keys: list[str], items: str = "items") -> DataFrame:
    """One row per item of a request; ``item_no`` is its place in the list."""
    return df.select(*keys, F.posexplode(items).alias("item_no", "item")).select(
        *keys, "item_no", "item.nickname", "item.comment"
    )


def read_labels(
    spark: SparkSession, path: str, columns: list[str] | None = None, schema: str = LABEL_SCHEMA
) -> DataFrame:
    """Label columns of a CSV with header; unused columns are not parsed."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(*columns) if columns else rows


def read_testset(
    spark: SparkSession, path: str, schema: str = TESTSET_SCHEMA, multi_line: bool = False
) -> DataFrame:
    """Test posts from CSV: both columns trimmed, ``\\`` in comments read as ``,``.

    ``multi_line`` allows line ends in quoted posts, at the price of one task per file.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return rows.withColumn("nickname", strip(F.col("nickname"))).withColumn(
        "comment", strip(F.translate("comment", "\\", ","))
    )
