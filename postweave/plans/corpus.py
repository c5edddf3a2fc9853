"""Tables the queries start from.

The test tables hold no Hangul, emoji or tags, so text queries run on a
decorated corpus: every document, with a snippet chosen by its id appended.  The
decoration is one SQL expression that Spark and the checking engine both read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from postweave.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(key: str, snippets: Sequence[str]) -> str:
    """SQL: one of ``snippets`` by ``key``."""
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(snippets))
    return f"CASE {key} % {len(snippets)} {cases} END"


def decorated(snippets: Sequence[str], text: str = "text", key: str = "doc_id") -> str:
    """SQL: ``text`` with one of ``snippets`` behind it."""
    return f"{text} || {choose(key, snippets)}"


NICKNAME = "'@user-' || source || " + choose("doc_id", ["가나다", "_abc", "가a나", "123"])
COMMENT = decorated(
    [
        " 조아욤 갠춘해", " ㅋ ㅋ 1 ㅋ", " 가ㅣ나다ㅣ라", " wow!!?.,~",
        " 가아아아", " 후쿠쿠 쿠쿠", " zzzz 3.14 1,000 a .b", " [num] [num] :) 🎉",
    ]
)


def documents(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """``id`` and the given SQL expressions over ``documents``."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", *[f"{sql} AS {name}" for name, sql in columns.items()]
    )
    return spread(rows, "id")


def documents_sql(**columns: str) -> str:
    """The same rows for the checking engine."""
    parts = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"SELECT doc_id AS id, {parts} FROM documents"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorated posts."""
    return documents(spark, sf_dir, nickname=NICKNAME, comment=COMMENT)


POSTS_SQL = documents_sql(nickname=NICKNAME, comment=COMMENT)
