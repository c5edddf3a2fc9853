"""Lookup joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import literal_lookup
from postweave.functions.windows import TOKEN
from postweave.session import BROADCAST_ROWS, broadcast_if_small

SALTS = 32
LOOKUP_SLOTS = 64
# A lexicon of so many tokens is at most a few megabytes of the plan.
IN_ROW = 20_000


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    salt_by: list[str] | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large ``left`` to a lookup ``table`` with one row per key.

    A table within the broadcast bounds is broadcast.  A larger one is shuffled:
    each of its rows is copied to ``SALTS`` salts and ``left`` rows pick one by
    hash of ``salt_by``, so a key that holds a third of all rows is spread over
    that many tasks.
    """
    table, small = broadcast_if_small(table, max_rows)
    if small:
        return left.join(table, on, how)
    return salted_join(left, table, on, how, salt_by or left.columns)


def salted_join(
    left: DataFrame, table: DataFrame, on: list[str], how: str, salt_by: list[str]
) -> DataFrame:
    """The shuffle form of ``lookup_join``."""
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    picked = left.withColumn(
        "__salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int")
    )
    return picked.join(salted, [*on, "__salt"], how).drop("__salt")


def label_of(
    df: DataFrame, labels: DataFrame, head: str, class_col: str = "class_id", out: str = "label"
) -> DataFrame:
    """Label of a class index.  ``labels`` is ``(head, class_id, label)``."""
    names = labels.where(F.col("head") == head).select(
        F.col("class_id").alias(class_col), F.col("label").alias(out)
    )
    return lookup_join(df, names, [class_col])


def lookup_tokens(
    df: DataFrame, key: str, text: str, lexicon: DataFrame, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Replace whole tokens by a lexicon ``(token, replacement)`` of any size.

    A lexicon of up to ``IN_ROW`` tokens becomes a literal and is looked up in the row.
    Of a larger one only distinct ``(row, token)`` pairs meet the lexicon; what was
    found comes back to the row as a map and the text is rebuilt there.  Either way
    everything else in the text is untouched.  A null token matches nothing, a repeated
    one has its smallest replacement, and one whose replacement is null stays.  Both forms give
    the same texts; ``key`` is not read.
    """
    cut = F.regexp_extract_all(text, F.lit(rf"{TOKEN}|[\p{{Z}}\s]+"), F.lit(0))
    # One row per token ahead of both forms, so that they agree on any lexicon.
    entries = lexicon.where("token is not null").groupBy("token").agg(F.min("replacement").alias("replacement"))
    few = entries.limit(min(IN_ROW, max_rows) + 1).collect()
    if len(few) <= min(IN_ROW, max_rows):
        found = literal_lookup({token: new for token, new in few})
        parts = F.transform(cut, lambda t: F.coalesce(found(t), t))
        return df.withColumn(text, F.when(F.size(parts) > 0, F.array_join(parts, "")).otherwise(F.col(text)))
    # What a row finds depends on its text alone.  Keyed by that, rows that repeat an id or have
    # none keep their own tokens, and copies are looked up once.
    df = df.withColumn("__content", F.sha2(text, 256))
    names, key = df.columns[:-1], "__content"
    tokens = df.where(F.col(text).isNotNull()).groupBy(key).agg(F.first(text).alias(text))
    # Distinct inside the row: no shuffle for it.
    tokens = tokens.select(key, F.explode(F.array_distinct(cut)).alias("token"))
    found = lookup_join(
        tokens,
        entries,
        ["token"],
        "inner",
        salt_by=[key],
        max_rows=max_rows,
    )
    # Found pairs by hash: looking a token up in one long map would read all of it.
    slots = F.lit(LOOKUP_SLOTS)
    slot_of = lambda t: F.pmod(F.xxhash64(t), slots).cast("int")
    pairs = found.groupBy(key).agg(F.collect_list(F.struct("token", "replacement")).alias("pairs"))
    table = pairs.select(
        key,
        F.transform(
            F.sequence(F.lit(0), slots - 1),
            lambda i: F.map_from_entries(F.filter("pairs", lambda p: slot_of(p["token"]) == i)),
        ).alias("__found"),
    )
    rebuilt = F.array_join(
        F.transform(
            cut, lambda t: F.coalesce(F.element_at(F.col("__found")[slot_of(t)], t), t)
        ),
        "",
    )
    return (
        df.join(table, key, "left")
        .withColumn(text, F.when(F.col("__found").isNull(), F.col(text)).otherwise(rebuilt))
        .select(*names)
    )
