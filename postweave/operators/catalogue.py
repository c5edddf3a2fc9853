"""Label catalogues: class ids are the order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_catalogue(df: DataFrame, label: str, order_col: str, head: str | None = None) -> DataFrame:
    """``(head, class_id, label)`` of one label column.

    First appearances are reduced before any shuffle.  What is left to number is
    one row per class, never more than a probability vector is long.
    """
    return catalogues(df, {head or label: label}, order_col)


def catalogues(df: DataFrame, heads: dict[str, str], order_col: str) -> DataFrame:
    """Catalogue of several heads, ``{head: label column}``, in one pass over the rows."""
    melted = df.select(
        F.col(order_col).alias("__ord"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(head).alias("head"), F.col(column).alias("label"))
                    for head, column in heads.items()
                ]
            )
        ).alias("cell"),
    ).select("__ord", "cell.*")
    first = (
        melted.where(F.col("label").isNotNull())
        .groupBy("head", "label")
        .agg(F.min("__ord").alias("first_seen"))
    )
    by_appearance = Window.partitionBy("head").orderBy("first_seen", "label")
    return first.select(
        "head", (F.row_number().over(by_appearance) - 1).cast("int").alias("class_id"), "label"
    )


def categories(catalogue: DataFrame) -> DataFrame:
    """Ordered category list per head."""
    return catalogue.groupBy("head").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("class_id", "label"))), lambda c: c["label"]
        ).alias("categories")
    )
