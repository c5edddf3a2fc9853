"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; a component is its smallest node.

    Large-star and small-star rounds: a node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows, until all links end there.  Each
    round is a grouped minimum and a join, and is written down; the driver sees a
    count and a checksum of it.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(links.distinct(), name)
    state = _state(links)
    while state[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        larger = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = larger.where("a <> b").distinct()
        least = larger.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        smaller = larger.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(smaller.where("a <> b").union(least.select("u", "m")).distinct(), name)
        before, state = state, _state(links)
        if state == before:
            break
    members = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(roots)


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0
