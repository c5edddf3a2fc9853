"""Compatibility folding.  Spark has no NFKC function, so this is the one step of
the chain that leaves the JVM; ``fold_column`` sends it only rows that need it."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweave.functions.hangul import FINALS, INITIALS, VOWELS
from postweave.functions.text import char_ranges, dict_replace

# Ranges NFKC leaves alone in any context of themselves.
_STABLE = [(0x00, 0x7F), (0xC0, 0xFF), (0xAC00, 0xD7A3)]


def jamo_restoration() -> dict[str, str]:
    """Conjoining jamo back to compatibility jamo.

    NFKC turns loose jamo into conjoining ones; without this table no later jamo
    rule would match.
    """
    table = {chr(0x1100 + i): jamo for i, jamo in enumerate(INITIALS)}
    table.update({chr(0x1161 + i): jamo for i, jamo in enumerate(VOWELS)})
    table.update({chr(0x11A8 + i): jamo for i, jamo in enumerate(FINALS)})
    return table


@F.pandas_udf(T.StringType())
def fold_compatibility(texts: pd.Series) -> pd.Series:
    """NFKC, then drop combining marks."""

    def fold(text: str) -> str:
        folded = unicodedata.normalize("NFKC", text)
        return "".join(ch for ch in folded if not unicodedata.combining(ch))

    return texts.map(fold, na_action="ignore")


def map_chars(c: Column, table: Mapping[str, str]) -> Column:
    """Replace single characters by texts of any length, all at once."""
    return dict_replace(c, table.items())


def needs_folding(c: Column, table: Mapping[str, str]) -> Column:
    """Rows with a character folding could change, given the table applied after it."""
    stable = {chr(code) for first, last in _STABLE for code in range(first, last + 1)}
    restored = all(table.get(k) == v for k, v in jamo_restoration().items())
    if restored and not any("\u3131" <= key <= "\u3163" for key in table):
        # Folded and mapped back.  Compound finals stay out: they would join a
        # syllable before them.
        stable |= set(INITIALS + VOWELS)
    kept = "".join(
        rf"\x{{{ord(first):X}}}-\x{{{ord(last):X}}}" for first, last in char_ranges(stable)
    )
    return c.rlike(rf"(?![\x00-\x7F])(?![가-힣])[^{kept}]")


def fold_column(df: DataFrame, name: str, table: Mapping[str, str]) -> DataFrame:
    """Fold ``name`` in place: NFKC, no combining marks, single-character table."""
    sent = f"__{name}_to_fold"
    out = f"__{name}_folded"
    keep = [c for c in df.columns if c != name]
    staged = df.withColumn(sent, F.when(needs_folding(F.col(name), table), F.col(name)))
    staged = staged.withColumn(out, fold_compatibility(sent))
    return staged.select(
        *keep, map_chars(F.coalesce(F.col(out), F.col(name)), table).alias(name)
    ).select(*df.columns)
