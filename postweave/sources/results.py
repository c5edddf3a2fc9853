"""Result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "id BIGINT, "
    "nickname STRUCT<predicted: STRING, prob: ARRAY<DOUBLE>>, "
    "comment STRUCT<predicted: STRING, prob: ARRAY<DOUBLE>>, "
    "model_type STRING"
)
CATEGORY_SCHEMA = "head STRING, categories ARRAY<STRING>"


def write_results(
    df: DataFrame,
    path: str,
    categories: DataFrame | None = None,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: list[str] | None = None,
    model_type: str | None = None,
) -> None:
    """Write result rows to ``<path>/results`` and category lists to ``<path>/categories``.

    ``model_type`` names the kind of model in every row.
    """
    rows = df if model_type is None else df.withColumn("model_type", F.lit(model_type))
    writer = rows.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{path}/results")
    if categories is not None:
        categories.write.format(fmt).mode(mode).save(f"{path}/categories")
