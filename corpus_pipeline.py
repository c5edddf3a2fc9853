"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage
before it kept and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes what a stage returns as Parquet and reads it again
for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import read_table, written
from postweave.llm.mixing import mixture
from postweave.llm.near_dedup import drop_near_duplicates
from postweave.llm.packing import pack_documents
from postweave.llm.quality_model import keep_good
from postweave.llm.substring_dedup import strip_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; no document goes."""
    return strip_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its sources takes it."""
    return mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_model", quality),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: The first stage is learned, so SQL cannot restate the rows; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
