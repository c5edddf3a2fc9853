"""Merkle manifest of a document table by sibling-shift self-joins.

1. A row becomes a leaf: the digest of its five columns.  Leaves are sorted globally by
   language, id and digest (a range partitioning, so no language is one task) and get
   consecutive numbers inside their language.
2. Every level equijoins its nodes with themselves by computed sibling indices: the slot-zero
   node of each run of siblings meets the node at each shift, ``index XOR shift`` for two
   siblings and ``index + shift`` else.  The slot-zero row then holds the whole
   run, of at most ``arity`` digests, and emits the parent.
3. The roots of the languages, in order, are the leaves of one more tree.
4. Proofs go from the root down: a run of siblings takes the path of the run above it, so
   a join has one row per run, and a leaf is joined once, with the run it is in.

The driver sees a number of levels and the root, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postweave.llm.common import read_table, written

ARITY = 8
#: Characters of a digest.
HEX = 64
#: Leaves that are sorted in one task, about.
RANGE_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Digest of a ``documents`` row whose text is ``text``."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``part``, ``nth``: its range of the sort by ``order`` and its place in the whole, from 0.

    Rows that are equal in ``order`` are told apart by where they were read, so a third
    of all rows may be equal and still lie in several ranges.
    """
    ranges = 1 + df.count() // RANGE_ROWS
    df = df.withColumn("__read", F.monotonically_increasing_id())
    keys = [*order, "__read"]
    df = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("__read")
    # The id holds the partition above bit 33 and the row of it below; it is written down.
    df = df.withColumn("__at", F.monotonically_increasing_id())
    df = df.withColumn("part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    df = written(df, name)
    # A row per range.
    sizes = df.groupBy(F.col("part").alias("__part")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    df = df.join(sizes, F.col("part") == F.col("__part"))
    return df.withColumn("nth", F.col("__at") + F.col("__before")).drop("__part", "__before", "__at")


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """``tree, parent, n, run``: for each slot-zero node its run of siblings, digests end to end."""
    zero = nodes.where(F.col("idx") % arity == 0)
    shift = F.explode(F.sequence(F.lit(0), F.lit(arity - 1))).alias("shift")
    zero = zero.select("tree", F.col("idx").alias("base"), "n", shift)
    sibling = F.col("base").bitwiseXOR(F.col("shift")) if arity == 2 else F.col("base") + F.col("shift")
    zero = zero.withColumn("idx", sibling.cast("long"))
    met = zero.join(nodes.select("tree", "idx", "hash"), ["tree", "idx"])
    run = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shift", "hash"))), lambda s: s["hash"]), "")
    runs = met.groupBy("tree", "base").agg(F.max("n").alias("n"), run.alias("run"))
    return runs.select("tree", F.expr(f"base div {arity}").alias("parent"), "n", "run")


def _tree(nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, lowest first, and ``tree, level, top``: the last node of each tree.

    ``nodes``: ``tree, idx, n, hash``, where ``n`` counts the nodes of the tree.
    """
    widest = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    tops = nodes.where("n = 1").select("tree", F.lit(0).alias("level"), F.col("hash").alias("top"))
    while widest > 1:
        runs = written(_runs(nodes.where("n > 1"), arity), name)
        levels.append(runs)
        nodes = runs.select(
            "tree", F.col("parent").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), F.sha2("run", 256).alias("hash")
        )
        widest = -(-widest // arity)
        ended = nodes.where("n = 1")
        tops = tops.union(ended.select("tree", F.lit(len(levels)).alias("level"), F.col("hash").alias("top")))
    return levels, tops


def _paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """``tree, parent`` and the columns of ``tops``, with ``runs``: the runs from that one up to
    the top of its tree.  A tree of one node has an empty path at place 0."""
    carried = [c for c in tops.columns if c not in ("tree", "level")]
    paths = None
    for k in range(len(levels), -1, -1):
        none = F.array().cast("array<string>").alias("runs")
        ends = tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("parent"), none, *carried)
        above = ends if paths is None else ends.union(paths)
        if k == 0:
            return above
        runs = levels[k - 1].select("tree", "parent", "run").alias("r")
        above = above.withColumnRenamed("parent", "up").withColumnRenamed("tree", "up_tree")
        paths = runs.join(
            above, (F.col("tree") == F.col("up_tree")) & (F.expr(f"parent div {arity}") == F.col("up"))
        ).select("tree", "parent", F.concat(F.array("run"), F.col("runs")).alias("runs"), *carried)
    raise AssertionError("unreachable")


def _steps(runs: str, idx: str, arity: int) -> Column:
    """``(before, after)`` of the node's siblings at each level, lowest first."""
    slot = f"cast(({idx} div cast(power({arity}, m) as bigint)) % {arity} as int)"
    return F.expr(
        f"transform({runs}, (run, m) -> struct(substring(run, 1, {HEX} * {slot}) as before,"
        f" substring(run, {HEX} * ({slot} + 1) + 1) as after))"
    )


def manifest(docs: DataFrame, arity: int = ARITY, tampered: Column | None = None) -> DataFrame:
    """A leaf, its proof and what the proof folds to, for every row of ``docs``.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, steps``; ``steps``
    is the proof itself: the digests before and after the node at each level.  ``tampered``
    is a text to fold from instead of the row's own (default: the own text).

    Nulls are fields of their own, told from empty texts; a null id sorts first, a null
    language is a language.  Rows that repeat an id are ordered by their digests; equal
    rows are leaves side by side.  A long text is one digest, held nowhere else.
    Other columns are not read; an empty table gives no rows.
    """
    text = F.col("text")
    leaves = docs.select(
        "doc_id", "lang", leaf_digest(text).alias("leaf"), leaf_digest(text if tampered is None else tampered).alias("now")
    )
    leaves = numbered(leaves, ["lang", "doc_id", "leaf"], "leaves")
    # Languages of each range: a language of a third of all rows has a row per range here.
    spans = leaves.groupBy("part", "lang").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    langs = spans.groupBy("lang").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    langs = numbered(langs, ["first"], "languages").select(
        F.col("lang").alias("of"), "first", "n", F.col("nth").alias("tree")
    )
    spans = spans.select(F.col("part").alias("in"), "lang").join(langs, F.col("lang").eqNullSafe(F.col("of")))
    spans = spans.select("in", "of", "first", "n", "tree")
    leaves = leaves.join(spans, (F.col("part") == F.col("in")) & F.col("lang").eqNullSafe(F.col("of")))
    leaves = written(
        leaves.select("doc_id", "leaf", "now", "tree", (F.col("nth") - F.col("first")).alias("idx"), "n"), "numbered"
    )
    levels, tops = _tree(leaves.select("tree", "idx", "n", F.col("leaf").alias("hash")), arity, "runs")
    tops = written(tops, "subroots")
    # The subroots are the leaves of the last tree.
    whole = tops.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(tops.count()).alias("n"), F.col("top").alias("hash")
    )
    upper, root = _tree(whole, arity, "upper_runs")
    last = root.first()
    upper = _paths(upper, root, arity).select("parent", F.col("runs").alias("upper_runs"))
    tops = tops.withColumnRenamed("top", "subroot").join(upper, F.expr(f"tree div {arity}") == F.col("parent")).drop("parent")
    paths = _paths(levels, tops, arity).withColumnRenamed("tree", "of")
    rows = leaves.join(paths, (F.col("tree") == F.col("of")) & (F.expr(f"idx div {arity}") == F.col("parent")))
    rows = rows.withColumn("steps", F.concat(_steps("runs", "idx", arity), _steps("upper_runs", "tree", arity)))
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("steps", F.col("now"), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
    rows = rows.select(
        "doc_id",
        "leaf",
        "subroot",
        F.lit(last["top"] if last else None).alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        "steps",
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tampered = F.when(picked, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    rows = manifest(read_table(spark, sf_dir, "documents"), tampered=tampered)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# crc32 of the decimal id, a bit at a time.
_CRC = """xor(list_reduce(
    flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END),
    CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""

OP13_SQL = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang,
         list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
                        lambda v: coalesce(CAST(octet_length(encode(v)) AS VARCHAR) || ':' || v, '-')) AS head,
         text,
         CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS altered
  FROM (SELECT *, {_CRC} AS crc FROM documents)),
digests AS (
  SELECT doc_id, lang,
         sha256(array_to_string(head, '') || coalesce(CAST(octet_length(encode(text)) AS VARCHAR) || ':' || text, '-')) AS leaf,
         sha256(array_to_string(head, '') || coalesce(CAST(octet_length(encode(altered)) AS VARCHAR) || ':' || altered, '-')) AS now
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM digests),
nodes(tree, level, idx, hash, n) AS (
  SELECT tree, 0, idx, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), any_value((n + 7) // 8)
  FROM nodes WHERE n > 1 GROUP BY tree, idx // 8),
subroots AS (SELECT tree, hash, level FROM nodes WHERE n = 1),
upper(level, idx, hash, n) AS (
  SELECT 0, tree, hash, count(*) OVER () FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), any_value((n + 7) // 8)
  FROM upper WHERE n > 1 GROUP BY idx // 8),
every AS (
  SELECT tree, level, idx, hash FROM nodes WHERE n > 1
  UNION ALL SELECT s.tree, s.level + u.level, u.idx, u.hash FROM subroots s CROSS JOIN upper u WHERE u.n > 1),
runs AS (
  SELECT tree, level, idx // 8 AS run, list(hash ORDER BY idx) AS hashes FROM every GROUP BY ALL),
walk(doc_id, leaf, now, tree, place, level, depth, idx, folded, proof) AS (
  SELECT doc_id, leaf, now, l.tree, l.idx, 0, s.level, CASE WHEN s.level = 0 THEN l.tree ELSE l.idx END, now, ''
  FROM leaves l JOIN subroots s ON l.tree = s.tree
  UNION ALL
  SELECT doc_id, leaf, now, w.tree, place, w.level + 1, depth,
         CASE WHEN w.level + 1 = depth THEN w.tree ELSE w.idx // 8 END,
         sha256(array_to_string(list_transform(hashes, lambda h, i: CASE WHEN i = w.idx % 8 + 1 THEN folded ELSE h END), '')),
         proof || array_to_string(list_filter(hashes, lambda h, i: i <> w.idx % 8 + 1), '')
  FROM walk w JOIN runs r ON w.tree = r.tree AND w.level = r.level AND w.idx // 8 = r.run),
ended AS (
  SELECT * FROM (SELECT *, max(level) OVER (PARTITION BY tree, place) AS last FROM walk) WHERE level = last)
SELECT e.doc_id, e.leaf, s.hash AS subroot, u.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = u.hash AS verified
FROM ended e JOIN subroots s ON e.tree = s.tree CROSS JOIN (SELECT hash FROM upper WHERE n = 1) u
"""
