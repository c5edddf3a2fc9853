"""Mix sources to target weights by weighted fair queueing.

The documents of a source, shuffled, are served up to three times.  A serving's
virtual finish time is the number of words its source has served by then,
divided by the source's target.  All servings are range-sorted by that time and
cut at the total budget, so every source comes out near its target.

Everything is DataFrame functions.  Running sums are made in two steps, inside
bounded shares of a range and over the sums of the shares, so no source and no
stretch of time has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweave.llm.common import WORD_GAP, read_table, written
from postweave.session import broadcast_if_small

WEIGHTS = (5, 2, 1)
TIMES = 3
#: Documents whose running sum is made in one task, about.
SHARE = 5_000


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES) -> DataFrame:
    """Add ``rank`` and ``target`` to ``source, source_size``: the sizes of all, shared by
    weight, no source above ``times`` its size and the excess shared again.

    With sources in the order of cap over weight the shares end at one level: it is
    the first whose remaining budget, over the weights not yet capped, stays below the
    source's own cap.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * times
    by_level = Window.orderBy(cap / F.col("weight"), "rank")
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum(cap).over(earlier), F.lit(0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    )
    every = Window.partitionBy()
    ranked = (
        sources.withColumn("rank", order)
        .withColumn("weight", weight.cast("long"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("level", level)
    )
    open_level = F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))
    settled = F.coalesce(F.max(open_level).over(every), F.lit(0.0))
    return ranked.withColumn("settled", settled).select(
        "source",
        "source_size",
        "documents",
        "rank",
        "total",
        F.least(cap.cast("double"), F.col("settled") * F.col("weight")).alias("target"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    Null texts have size 0 and take nothing; a null source is a source of its own,
    last in order; a null id is shuffled as an empty one.  Equal ids are ordered by
    size, and repeated rows are served each.  The shuffle is by a hash of the id, so
    reruns agree.  Other columns are not read; an empty table gives no rows.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = written(sized.withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sized")
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("documents")
    )
    aimed = written(targets(sources, weights, times), "targets")
    aims, _ = broadcast_if_small(aimed.withColumnRenamed("source", "own"))
    served = sized.join(aims, F.col("source").eqNullSafe(F.col("own"))).drop("own", "source")
    served = written(_within_source(served), "served")
    turns = served.where("size > 0 and target > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("turn")
    )
    turns = turns.select("rank", "size", "turn", "total", _finish(F.col("turn")).alias("finish"))
    last = _last_served(turns, max(1, times * served.count() // SHARE))
    taken = F.lit(0).cast("long")
    for turn in range(times):
        key = F.struct(_finish(F.lit(turn)), F.col("rank"), F.lit(turn))
        in_time = F.lit(True) if last is None else key <= F.struct(*map(F.lit, last))
        taken = taken + F.when((F.col("target") > 0) & in_time, F.col("size")).otherwise(0)
    return served.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _finish(turn: Column) -> Column:
    return (turn * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")


def _last_served(turns: DataFrame, stretches: int) -> tuple[float, int, int] | None:
    """``finish, rank, turn`` of the last serving within the budget; None if all are.

    The servings are range-sorted: stretches of time are summed first, then only the
    stretch that the budget ends in is put in order.
    """
    stretch = F.floor(F.least(F.col("finish"), F.lit(2.0)) * stretches)
    dealt = turns.withColumn("stretch", stretch)
    sums = dealt.groupBy("stretch").agg(F.sum("size").alias("words"), F.max("total").alias("total"))
    order = Window.orderBy("stretch")
    sums = sums.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    end = sums.where("upto > total").orderBy("stretch").first()
    if end is None:
        return None
    running = F.sum("size").over(Window.orderBy("finish", "rank", "turn").rowsBetween(Window.unboundedPreceding, 0))
    inside = dealt.where(F.col("stretch") == end["stretch"]).withColumn("running", running)
    inside = inside.where(F.col("running") <= end["total"] - (end["upto"] - end["words"]))
    last = inside.agg(F.max(F.struct("finish", "rank", "turn")).alias("k")).first()["k"]
    return tuple(last) if last else (end["stretch"] / stretches, -1, -1)


def _within_source(docs: DataFrame) -> DataFrame:
    """Add ``upto``: words of the source up to and with this document, in shuffled order."""
    shares = F.ceil(F.col("documents") / SHARE)
    place = F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / 2**32
    docs = docs.withColumn("share", F.floor(place * shares))
    cells = docs.groupBy(F.col("rank").alias("cr"), F.col("share").alias("cs")).agg(F.sum("size").alias("cell"))
    before = Window.partitionBy("cr").orderBy("cs").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cr", "cs", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("moved"))
    inside = Window.partitionBy("rank", "share").orderBy("mark", "doc_id", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        docs.withColumn("running", running)
        .join(cells, (F.col("rank") == F.col("cr")) & (F.col("share") == F.col("cs")))
        .withColumn("upto", F.col("running") + F.col("moved"))
        .drop("cr", "cs", "share", "moved", "running", "documents")
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES) -> DataFrame:
    """``docs`` as the mix takes them: a row per serving, none for documents not served.

    Empty documents weigh nothing and stay once.  Rows that repeat an id share its
    servings evenly.  Other columns may have any names but those that begin with ``__mix_``.
    """
    plan = mixed(docs, weights, times)
    served = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("long")
    plan = plan.groupBy(F.col("doc_id").alias("__mix_id")).agg(
        F.sum(served).alias("__mix_servings"), F.count("*").alias("__mix_rows")
    )
    # Joined by a merge at every size: the plan has as many rows as there are documents.
    plan = written(plan, "servings").hint("merge")
    own = docs.columns
    alike = F.col("doc_id").eqNullSafe(F.col("__mix_id"))
    once = docs.join(plan.where("__mix_rows = 1"), alike)
    several = docs.join(plan.where("__mix_rows > 1"), alike).withColumn(
        "__mix_nth", F.row_number().over(Window.partitionBy("__mix_id").orderBy(F.xxhash64(*own)))
    )
    servings, rows = F.col("__mix_servings"), F.col("__mix_rows")
    extra = F.when(F.col("__mix_nth") <= servings % rows, 1).otherwise(0)
    several = several.withColumn("__mix_servings", F.floor(servings / rows) + extra)
    every = once.select(*own, "__mix_servings").unionByName(several.select(*own, "__mix_servings"))
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), servings))
    return every.where(servings > 0).withColumn("__mix_serving", repeats).select(*own)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mark
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][rnk % 3 + 1] AS w, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM ranked),
levels AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed),
aimed AS (
  SELECT source, source_size, rnk, total,
         least(CAST(cap AS DOUBLE), w * coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER (), 0)) AS target
  FROM levels),
served AS (
  SELECT s.*, a.source_size, a.rnk, a.total, a.target,
         sum(s.size) OVER (PARTITION BY a.rnk ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
turns AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(turn * source_size + upto AS DOUBLE) / target END AS finish
  FROM served, (SELECT unnest([0, 1, 2]) AS turn)),
queue AS (
  SELECT *, sum(CASE WHEN target > 0 THEN size ELSE 0 END) OVER (ORDER BY finish, rnk, turn, mark, doc_id, size ROWS UNBOUNDED PRECEDING) AS running
  FROM turns)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN target > 0 AND running <= total THEN size ELSE 0 END) AS BIGINT) AS taken
FROM queue GROUP BY doc_id, size, source_size, target, mark, rnk, upto
"""
