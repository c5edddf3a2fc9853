"""Phrase dictionaries: neighbouring words of the benchmark texts, replaced in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.operators.phrases import PART_BYTES, replace_phrases
from postweave.plans.corpus import documents, table
from postweave.plans.registry import Query


def _dictionary(spark, sf_dir):
    """Every two and three neighbouring words, in an order that is neither by length nor by
    letter: among keys at one place the longest need not be the first."""
    words = table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("w"))

    def neighbours(n: int):
        return F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, n), " "))

    keys = words.select(F.explode(F.concat(neighbours(2), neighbours(3))).alias("key")).where("instr(key, ' ') > 0").distinct()
    return keys.select(
        (F.octet_length("key") % 3).alias("ord"), "key", F.concat(F.lit("<"), "key", F.lit(">")).alias("value")
    )


def _replaced(part_bytes: int):
    def run(spark, sf_dir):
        return replace_phrases(documents(spark, sf_dir, c="text"), "c", _dictionary(spark, sf_dir), part_bytes)

    return run


# One alternation of all keys, over all texts at once: its matches are leftmost, and the first
# alternative counts.
_SQL = r"""
WITH b AS (SELECT string_split(text, ' ') AS w FROM benchmark),
k AS (SELECT DISTINCT key FROM (
  SELECT unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + 1], ' '))) AS key FROM b
  UNION ALL SELECT unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM b)
  WHERE contains(key, ' ')),
p AS (SELECT string_agg(regexp_escape(key), '|' ORDER BY strlen(key) % 3, strlen(key)) AS pattern FROM k),
d AS (SELECT list(doc_id ORDER BY doc_id) AS ids, string_agg(text, chr(1) ORDER BY doc_id) AS t
      FROM documents WHERE text IS NOT NULL),
r AS (SELECT unnest(ids) AS id, unnest(string_split(regexp_replace(t, pattern, '<\0>', 'g'), chr(1))) AS c FROM d, p)
SELECT doc_id AS id, c FROM documents LEFT JOIN r ON doc_id = id
"""

QUERIES: dict[str, Query] = {
    "phrase_dictionary": Query(_replaced(PART_BYTES), _SQL),
    "phrase_dictionary_parts": Query(_replaced(20_000), _SQL),
}
