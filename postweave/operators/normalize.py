"""The whole normalization chain on a table or stream of posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.functions import hangul, steps
from postweave.functions.unicode_fold import fold_column
from postweave.sources.rules import RuleSet


def lower_all(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Lower-case the given columns, or every string column."""
    wanted = columns or [name for name, kind in df.dtypes if kind == "string"]
    return df.select(*[F.lower(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


def nickname_chain(c: Column, rules: RuleSet) -> Column:
    """Everything that happens to a nickname."""
    c = steps.clean_nickname(F.lower(c))
    c = steps.fix_words(c, rules)
    c = steps.drop_isolated_letter(steps.drop_trailing_digits(c))
    return steps.upper_tags(steps.default_nickname(c))


def before_folding(c: Column, rules: RuleSet) -> Column:
    """Comment steps up to compatibility folding."""
    c = steps.drop_invisible(steps.unify_spaces(F.lower(c)))
    return hangul.compose(steps.unify_marks(c, rules.punct))


def after_folding(rules: RuleSet) -> list[Callable[[Column], Column]]:
    """Comment steps from folding on, in order: all native."""
    return [
        lambda c: steps.squeeze_long_runs(steps.unify_letters(c, rules.single_en)),
        lambda c: steps.fix_words(c, rules),
        lambda c: F.lower(steps.tidy_jamo(c)),
        lambda c: steps.unify_crying(steps.shorten_vowels(steps.sort_marks(c))),
        lambda c: steps.tag_symbols(c, rules),
        steps.keep_known_chars,
        lambda c: steps.drop_i_between_syllables(steps.join_spaced_letters(c)),
        lambda c: steps.tidy_marks(steps.tag_structured(c, rules)),
        lambda c: steps.collapse_tags(c, rules.tags),
        lambda c: hangul.compose(steps.upper_tags(steps.laugh_z(c))),
    ]


def normalize(
    df: DataFrame,
    rules: DataFrame | RuleSet,
    nickname: str | None = "nickname",
    comment: str | None = "comment",
) -> DataFrame:
    """Normalize both text columns in place; other columns pass through.

    Row by row, so there is no shuffle and the same call works on a stream.
    Only comments that compatibility folding could change visit Python.
    """
    rules = RuleSet.collect(rules)
    out = df
    if comment:
        out = out.withColumn(comment, before_folding(F.col(comment), rules))
        out = fold_column(out, comment, dict(rules.single_ko))
        # One at a time: the analyzer resolves one level of nested functions in each of its rounds.
        for step in after_folding(rules):
            out = out.withColumn(comment, step(F.col(comment)))
    if nickname:
        out = out.withColumn(nickname, nickname_chain(F.col(nickname), rules))
    return out
