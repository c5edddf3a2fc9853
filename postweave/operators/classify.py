"""Windowed classification of text columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.vectors import argmax, round_vector
from postweave.functions.windows import MAX_TOKENS, WindowOptions, text_windows, truncated
from postweave.operators.lookup import label_of
from postweave.operators.scorers import Scorer


def classify(
    df: DataFrame,
    scorer: Scorer,
    labels: DataFrame,
    head: str,
    text: str | None = None,
    key: str = "id",
    options: WindowOptions | None = None,
    labels_only: bool = False,
) -> DataFrame:
    """Classify ``text`` (default: the column named like the head).

    Adds the result in a column ``<head>_result``: label and the rounded mean
    vector.  A short text is one window cut to the token limit; a long one is
    the mean over the windows of its sentences.  ``labels_only``: no long path
    and just the label, as ``<head>_label``.
    """
    text = text or head
    options = options or WindowOptions(MAX_TOKENS[head])
    if labels_only:
        windows = F.array(truncated(F.col(text), options.max_tokens))
    else:
        windows = text_windows(F.col(text), options)
    missing = F.col(text).isNull()
    scored = scorer.mean_probs(
        df.withColumn("__windows", F.when(~missing, windows)), key, "__windows", "__mean"
    ).drop("__windows")
    picked = scored.withColumn("__class", argmax(F.col("__mean")))
    named = label_of(picked, labels, head, "__class", "__label").drop("__class")
    if labels_only:
        return named.withColumnRenamed("__label", f"{head}_label").drop("__mean")
    result = F.struct(
        F.col("__label").alias("predicted"), round_vector(F.col("__mean")).alias("prob")
    )
    return named.withColumn(f"{head}_result", result).drop("__label", "__mean")


def classify_heads(
    df: DataFrame, scorers: Mapping[str, Scorer], labels: DataFrame, key: str = "id"
) -> DataFrame:
    """Classify several columns of the same rows; one result record per row.

    Both heads are columns of one row, so putting them side by side is no join.
    """
    for head, scorer in scorers.items():
        df = classify(df, scorer, labels, head, key=key)
    return assemble(df, key, list(scorers))


def assemble(df: DataFrame, key: str, heads: list[str]) -> DataFrame:
    """Key and the result of each head under the head's name."""
    return df.select(key, *[F.col(f"{head}_result").alias(head) for head in heads])


def combine_heads(nickname: DataFrame, comment: DataFrame, key: str = "id") -> DataFrame:
    """Results of two heads computed apart, zipped by key."""
    return nickname.join(comment, key, "inner")
