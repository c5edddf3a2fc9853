"""Probability vectors as ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import let

# Means are compared after this rounding, so a tie stays a tie whatever the
# order of summation was.
TIE_DIGITS = 12


def softmax(v: Column) -> Column:
    """Exponentials over their sum, shifted by the maximum."""

    def scaled(x: Column) -> Column:
        top = F.array_max(x)
        return F.transform(x, lambda p: F.exp(p - top))

    def normalized(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, p: acc + p)
        return F.transform(e, lambda p: p / total)

    return let(let(v.cast("array<double>"), scaled), normalized)


def mean_vectors(vectors: Column, width: int) -> Column:
    """Mean of an array of vectors of ``width`` numbers, inside the row; null for an empty array."""
    zero = F.array_repeat(F.lit(0.0), width)

    def mean(all_of_row: Column) -> Column:
        total = F.aggregate(
            all_of_row,
            zero,
            lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
            lambda acc: F.transform(acc, lambda total: F.try_divide(total, F.size(all_of_row))),
        )
        return F.when(F.size(all_of_row) > 0, total)

    return let(vectors, mean)


def argmax(v: Column) -> Column:
    """Index of the largest number, the first one on ties."""
    settled = F.transform(v, lambda p: F.round(p, TIE_DIGITS))
    return let(settled, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def round_vector(v: Column, digits: int = 2) -> Column:
    """Half-even rounding of each number."""
    return F.transform(v, lambda p: F.bround(p, digits))


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "prob") -> DataFrame:
    """Mean vector per key for vectors in separate rows.

    Sums are combined before the shuffle, per key and position, so a key with
    very many vectors sends one row per position and task.
    """
    long = df.select(*keys, F.posexplode(vector).alias("class_id", "p"))
    means = long.groupBy(*keys, "class_id").agg(F.avg("p").alias("p"))
    return means.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("class_id", "p"))), lambda cell: cell["p"]
        ).alias(out)
    )
