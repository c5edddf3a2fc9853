"""Posts as JSON text, with what is malformed set aside instead of read as nulls.

Every line is accepted or rejected, with a reason for each field at fault: accepted and
rejected lines together are the input.  All of it is expressions inside the row, so the
same functions work on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a post and the type that each must have in the JSON text.
FIELDS = {"id": "BIGINT", "nickname": "STRING", "comment": "STRING"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, path`` of text lines, one post each; the file goes along into the quarantine."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def _fault(parsed: Column, field: str, kind: str) -> Column:
    """What is wrong with one field, or null."""
    found = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
    return (
        F.when(found.isNull(), F.lit(f"{field}: missing"))
        .when(found == "VOID", F.lit(f"{field}: null"))
        .when(found != kind, F.lit(f"{field}: not {'text' if kind == 'STRING' else 'an integer'}"))
    )


def checked_posts(lines: DataFrame, value: str = "value", fields: dict[str, str] | None = None) -> DataFrame:
    """``lines`` with the fields of the post and ``reasons``, what is wrong with it.

    A line that is no JSON (a null or an empty one, one cut short, one that repeats a field,
    one too large for a variant) is ``malformed``; JSON that is no object, ``not an object``.
    Fields beyond those asked for are ignored.  The fields of a rejected line are null, so that
    nobody takes half a post for a whole one.
    """
    fields = fields or FIELDS
    parsed = F.try_parse_json(value)
    faults = F.array_compact(F.array(*[_fault(F.col("__parsed"), name, kind) for name, kind in fields.items()]))
    shape = F.schema_of_variant(F.col("__parsed"))
    reasons = (
        F.when(shape.isNull(), F.array(F.lit("malformed")))
        .when(~shape.startswith("OBJECT"), F.array(F.lit("not an object")))
        .otherwise(faults)
    )
    rows = lines.withColumn("__parsed", parsed).withColumn("reasons", reasons)
    good = F.size("reasons") == 0
    posts = [
        F.when(good, F.try_variant_get("__parsed", f"$.{name}", kind)).alias(name) for name, kind in fields.items()
    ]
    return rows.select(*lines.columns, *posts, "reasons")


def accepted(checked: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """The posts without a fault."""
    return checked.where(F.size("reasons") == 0).select(*(fields or FIELDS))


def rejected(checked: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """The other lines as they came, with their reasons."""
    return checked.where(F.size("reasons") > 0).drop(*(fields or FIELDS))


def reason_counts(checked: DataFrame) -> DataFrame:
    """``reason, n``: how often each fault was found; a line with several counts for each."""
    return checked.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
