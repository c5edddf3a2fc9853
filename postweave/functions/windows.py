"""Long texts to token windows: array functions inside the row, so no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.functions.regex import java_pattern
from postweave.functions.text import MARK, cut_at, let

# Token limits per text column, window overlap, delimiters.
MAX_TOKENS = {"nickname": 40, "comment": 256}
OVERLAP = 20
DELIMITERS = ".,!?^~"

BEGIN, END = "[CLS]", "[SEP]"
WORD_CHARS = r"\p{L}\p{M}\p{N}_"
# A word, a tag, or one mark.  (Spaces and frequent letters first: they are tried in order.)
TOKEN = (
    rf"(?! )(?:(?:[a-z]++|[가-힣]++|[{WORD_CHARS}]++)++|\[[A-Z_]+\]|[^{WORD_CHARS}\p{{Z}}\s])"
)


@dataclass(frozen=True)
class WindowOptions:
    """``keep_empty``: keep the empty rest after a final delimiter as a sentence.
    ``clamp_tail``: drop the extra stub (or repeat) a tail window makes when the
    sentence is not longer than a window."""

    max_tokens: int
    overlap: int = OVERLAP
    keep_empty: bool = True
    clamp_tail: bool = False


def long_border(max_tokens: int) -> int:
    """Characters from which a text counts as long: a tenth over the token limit."""
    return max_tokens * 11 // 10


def visible_length(c: Column) -> Column:
    """Length without white space and tags."""
    return F.length(F.regexp_replace(c, java_pattern(r"\[[A-Z_]+\]|\s"), ""))


def is_long(c: Column, max_tokens: int) -> Column:
    border = long_border(max_tokens)

    def long(text: Column) -> Column:
        # The start of most long texts is long enough; a tag that is cut there does not count.
        start = F.regexp_replace(F.left(text, F.lit(2 * border)), r"\[[A-Z_]*$", "")
        return (F.length(text) >= border) & ((visible_length(start) >= border) | (visible_length(text) >= border))

    return let(c, long)


def route(df: DataFrame, text: str, max_tokens: int, out: str = "is_long") -> DataFrame:
    """Mark each row for the short or the long path."""
    return df.withColumn(out, is_long(F.col(text), max_tokens))


def _cut(c: Column) -> Column:
    # Zero-width cut behind each run of delimiters: linear, and the rest after
    # the last run is there even when empty.
    return F.when(
        F.contains(c, F.lit(MARK)), F.split(c, rf"(?<=[{DELIMITERS}])(?![{DELIMITERS}])", -1)
    ).otherwise(cut_at(c, f"[{DELIMITERS}]++", f"$0{MARK}"))


def sentences(c: Column, keep_empty: bool = True) -> Column:
    """Sentences with their delimiters, trimmed, and the rest after the last one."""
    trimmed = F.transform(
        _cut(c),
        lambda s: F.regexp_replace(s, java_pattern(rf"\A\s+|(?<!\s)\s++(?=[{DELIMITERS}]|\z)"), ""),
    )
    return trimmed if keep_empty else F.filter(trimmed, lambda s: F.length(s) > 0)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def tokens(c: Column) -> Column:
    """Words, tags and marks of a sentence between begin and end markers."""
    return F.concat(F.array(F.lit(BEGIN)), words(c), F.array(F.lit(END)))


def truncated(c: Column, max_tokens: int) -> Column:
    """Tokens cut to the limit, markers kept."""
    return F.concat(
        F.array(F.lit(BEGIN)), F.slice(words(c), 1, max_tokens - 2), F.array(F.lit(END))
    )


def window_spans(length: Column, size: int, overlap: int = OVERLAP, clamp_tail: bool = False) -> Column:
    """``(start, stop)`` of the windows over ``length`` tokens.

    Windows start every ``size - overlap`` tokens.  When at most ``overlap``
    tokens are left the last window is the tail of ``size`` tokens; a sentence
    shorter than that counts the negative start from its end.
    """

    def span(start: Column, n: Column) -> Column:
        tail = n - size
        tail_start = F.when(tail >= 0, tail).otherwise(F.greatest(n * 2 - size, F.lit(0)))
        is_tail = (n - start) <= overlap
        return F.struct(
            F.when(is_tail, tail_start).otherwise(start).cast("int").alias("start"),
            F.when(is_tail, n).otherwise(F.least(start + size, n)).cast("int").alias("stop"),
        )

    def spans(n: Column) -> Column:
        starts = F.sequence(F.lit(0), n - 1, F.lit(size - overlap))
        if clamp_tail:
            # A tail that starts in the first window of a short sentence adds nothing.
            starts = F.filter(starts, lambda s: (s == 0) | (n > size))
        return F.when(n > 0, F.transform(starts, lambda s: span(s, n))).otherwise(
            F.array().cast("array<struct<start:int,stop:int>>")
        )

    return let(length, spans)


def windows(toks: Column, size: int, overlap: int = OVERLAP, clamp_tail: bool = False) -> Column:
    """Overlapping windows over a token array."""

    def cut(t: Column) -> Column:
        several = F.transform(
            window_spans(F.size(t), size, overlap, clamp_tail),
            lambda w: F.slice(t, w["start"] + 1, w["stop"] - w["start"]),
        )
        if size < 2 * overlap:
            return several
        # Most sentences are one window, which is all of their tokens.
        return F.when(F.size(t).between(1, size - overlap), F.array(t)).otherwise(several)

    return let(toks, cut)


def text_windows(c: Column, options: WindowOptions) -> Column:
    """All windows of a text as ``ARRAY<ARRAY<STRING>>``.

    A short text is one window cut to the limit; a long one is cut into
    sentences and each of them into windows.
    """
    size = options.max_tokens

    def parts(text: Column) -> Column:
        cut = _cut(text)
        if not options.keep_empty:
            cut = F.filter(cut, lambda s: s.rlike(java_pattern(r"\S")))
        long = F.flatten(
            F.transform(
                cut, lambda s: windows(tokens(s), size, options.overlap, options.clamp_tail)
            )
        )
        return F.when(is_long(text, size), long).otherwise(F.array(truncated(text, size)))

    return let(c, parts)


def window_table(df: DataFrame, keys: list[str], text: str, options: WindowOptions) -> DataFrame:
    """One row per window: keys, ``sentence_no``, ``window_no``, ``tokens``."""
    size = options.max_tokens
    parts = df.select(
        *keys, F.posexplode(sentences(F.col(text), options.keep_empty)).alias("sentence_no", "s")
    )
    return parts.select(
        *keys,
        "sentence_no",
        F.posexplode(
            windows(tokens(F.col("s")), size, options.overlap, options.clamp_tail)
        ).alias("window_no", "tokens"),
    )


def window_stats(df: DataFrame, keys: list[str], tokens_col: str = "tokens") -> DataFrame:
    """Windows and tokens per key for a table of windows."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), F.sum(F.size(tokens_col)).alias("n_tokens")
    )
