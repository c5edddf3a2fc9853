"""Checks on inputs and before/after comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import java_quote


def missing_keys(
    expected: DataFrame, actual: DataFrame, key: str, size: str | None = None
) -> DataFrame:
    """Expected keys with no row in ``actual``, or none with a ``size`` above zero.

    Keys are made distinct before the shuffle, so repeated keys cost nothing.
    """
    present = actual.where(F.col(size) > 0) if size else actual
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def mismatches(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys both tables have with values that differ; one row per key on each side."""
    pair = left.select(key, F.col(value).alias("left_value")).join(
        right.select(key, F.col(value).alias("right_value")), key
    )
    return pair.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def changed_rows(
    before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], tags: Sequence[str] = ()
) -> DataFrame:
    """Rows in which any of ``columns`` changed, as ``<column>_before/_after``.

    With ``tags``, only rows that contain one of them in any compared column.
    """
    old = before.select(key, *[F.col(c).alias(f"{c}_before") for c in columns])
    new = after.select(key, *[F.col(c).alias(f"{c}_after") for c in columns])
    return _changed(old.join(new, key), columns, tags)


def changed_columns(
    df: DataFrame, pairs: dict[str, tuple[str, str]], key: str, tags: Sequence[str] = ()
) -> DataFrame:
    """The same for values that are already side by side: no join."""
    both = df.select(
        key,
        *[F.col(old).alias(f"{name}_before") for name, (old, _) in pairs.items()],
        *[F.col(new).alias(f"{name}_after") for name, (_, new) in pairs.items()],
    )
    return _changed(both, list(pairs), tags)


def _changed(df: DataFrame, columns: Sequence[str], tags: Sequence[str]) -> DataFrame:
    def either(conditions):
        return reduce(lambda a, b: a | b, conditions)

    out = df.where(
        either(~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after")) for c in columns)
    )
    if tags:
        wanted = "|".join(java_quote(tag) for tag in tags)
        out = out.where(
            either(
                F.coalesce(F.col(f"{c}_{side}").rlike(wanted), F.lit(False))
                for c in columns
                for side in ("before", "after")
            )
        )
    return out
