"""Quality rules as learned decision lists.

Sequential covering: a rule grows by the threshold that gains most, is pruned on
rows it has not seen, and the rows it covers are set aside for the next one.  What
the learner sees are counts: Spark cuts every statistic at a few thresholds taken
from the labelled rows and counts labels per combination of levels, a table bounded
by the number of levels whatever the input.  The rules are interpretable and come
back as one ordered conditional expression.

Everything is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import WORD_GAP, fold, read_table, written

FOLDS = 5
WINDOW = 5

#: What rules are made of, each from the counted columns of a row.
STATISTICS: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "shout_rate": "n_shouts / greatest(n_words, 1)",
}
#: Where a statistic is cut: quantiles of the good and of the bad rows.
QUANTILES = (0.02, 0.1, 0.5, 0.9, 0.98)

Condition = tuple[str, str, float]


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(statistic, '<=' or '>', threshold)``; rows it fits are rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return F.expr(" AND ".join(f"({STATISTICS[s]}) {sign} {cut!r}D" for s, sign, cut in self.conditions))


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the counts of every whole text; null texts count as empty."""
    n = F.col("n_words")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = texts.select(
        "doc_id",
        F.array_remove(F.split("text", WORD_GAP), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _hits("text", r"[^#*$%&|<>]+").alias("n_symbols"),
        _hits("text", r"[^A-Z]+").alias("n_upper"),
        _hits("text", r"[^!]+").alias("n_shouts"),
    )
    simple = cut.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_symbols",
        "n_upper",
        "n_shouts",
    )
    window = F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)).cast("int")),
        lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))),
    )
    grams = simple.withColumn("grams", F.when(n >= WINDOW, window)).drop("words")
    # Only a text with a repeated window is looked at any further.
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    placed = grams.withColumn("placed", F.when(again, placed)).drop("grams")
    twice = F.filter(
        F.sequence(F.lit(0), F.size("placed") - 1),
        lambda k: F.get("placed", k)["g"].eqNullSafe(F.get("placed", k - 1)["g"])
        | F.get("placed", k)["g"].eqNullSafe(F.get("placed", k + 1)["g"]),
    )
    starts = F.sort_array(F.transform(twice, lambda k: F.get("placed", k)["i"]))
    starts = placed.withColumn("starts", F.when(F.col("placed").isNotNull(), starts)).drop("placed")
    covered = F.aggregate(
        F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("starts")


def _hits(text: str, others: str) -> Column:
    """Characters left when ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn(rows: DataFrame, labels: DataFrame, rules: int = 8, conditions: int = 3, precision: float = 0.9) -> list[Rule]:
    """Decision list for ``labels(doc_id, quality)`` over all labelled ``rows``.

    ``rules`` and ``conditions`` bound the list's size; a rule whose precision on the
    pruning rows is below ``precision`` ends it.  Rows without a label of 0 or 1 are
    not learned from; without rows of both labels the list is empty.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("labelled"), "quality")
    known = rows.join(known, F.col("doc_id") == F.col("labelled"))
    known = known.select(
        "quality",
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"),
        *(F.expr(e).alias(s) for s, e in STATISTICS.items()),
    )
    known = written(known, "labelled")
    found = known.groupBy("quality").agg(
        *(F.percentile_approx(s, list(QUANTILES), 1000).alias(s) for s in STATISTICS)
    ).collect()
    if len(found) < 2:
        return []
    cuts = {s: sorted({float(x) for row in found for x in row[s]}) for s in STATISTICS}
    level = {s: sum((F.col(s) > cut).cast("int") for cut in at) for s, at in cuts.items()}
    table = known.groupBy("prune", *(level[s].alias(s) for s in STATISTICS)).agg(
        F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good")
    )
    cells = [(r["prune"], tuple(r[s] for s in STATISTICS), r["bad"], r["good"]) for r in table.collect()]
    return cover(cells, cuts, rules, conditions, precision)


def cover(cells, cuts: dict[str, list[float]], rules: int, conditions: int, precision: float) -> list[Rule]:
    """Sequential covering over counted cells ``(prune, levels, bad, good)``."""
    names = list(cuts)
    tests = [(f, sign, k) for f, s in enumerate(names) for k in range(len(cuts[s])) for sign in ("<=", ">")]

    def fits(levels, test) -> bool:
        f, sign, k = test
        return (levels[f] > k) == (sign == ">")

    def tally(some, prune: bool) -> tuple[int, int]:
        return (
            sum(bad for p, _, bad, _ in some if p == prune),
            sum(good for p, _, _, good in some if p == prune),
        )

    out: list[Rule] = []
    while len(out) < rules:
        grown, inside = [], cells
        while len(grown) < conditions:
            bad, good = tally(inside, False)
            if not bad or not good:
                break
            best = max(
                ((_gain(tally([c for c in inside if fits(c[1], t)], False), bad, good), -i, t) for i, t in enumerate(tests)),
            )
            if best[0] <= 0:
                break
            grown.append(best[2])
            inside = [c for c in inside if fits(c[1], best[2])]
        worth = []
        for size in range(1, len(grown) + 1):
            bad, good = tally([c for c in cells if all(fits(c[1], t) for t in grown[:size])], True)
            worth.append(((bad - good) / max(bad + good, 1), bad / max(bad + good, 1), -size))
        if not worth or max(worth)[1] < precision:
            break
        grown = grown[: -max(worth)[2]]
        out.append(Rule(tuple((names[f], sign, cuts[names[f]][k]) for f, sign, k in grown)))
        cells = [c for c in cells if not all(fits(c[1], t) for t in grown)]
    return out


def _gain(inside: tuple[int, int], bad: int, good: int) -> float:
    """First-order gain of information on the bad rows."""
    b, g = inside
    return b * (log2(b / (b + g)) - log2(bad / (bad + good))) if b else 0.0


def verdict(rules: Sequence[Rule]) -> Column:
    """The list as one ordered conditional: false where a rule fits, else true."""
    out = F
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept`` of every row, by rules learned outside the held-out fold.

    Null and empty texts have zero counts and fail the base rule; repeated rows are
    judged each; other columns are not read; an empty table gives no rows; without
    usable labels the base rule decides alone.
    """
    rows = written(counted(docs), "counted")
    rules = learn(rows.where(fold(F.col("doc_id"), FOLDS) != 0), labels)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
