"""Tag inventory of a text table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = r"\[[A-Z_]+\]"


def tag_inventory(df: DataFrame, text: str, minus: Sequence[str] = ()) -> DataFrame:
    """Distinct tags found in ``text``, without the given ones, sorted."""
    found = df.select(
        F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)))).alias("tag")
    )
    if minus:
        found = found.where(~F.col("tag").isin(list(minus)))
    return found.distinct().orderBy("tag")
