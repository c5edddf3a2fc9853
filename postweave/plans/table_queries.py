"""Queries over tables: sources, sinks, windows, audits, catalogues, activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.functions import steps
from postweave.functions.vectors import argmax, mean_vector, round_vector, softmax
from postweave.functions.windows import (
    BEGIN,
    DELIMITERS,
    END,
    MAX_TOKENS,
    WindowOptions,
    is_long,
    long_border,
    route,
    sentences,
    tokens,
    truncated,
    window_stats,
    window_table,
)
from postweave.operators.activity import activity_sessions, idle_intervals, live_keys
from postweave.operators.audit import changed_columns, changed_rows, mismatches, missing_keys
from postweave.operators.catalogue import catalogues, categories, label_catalogue
from postweave.operators.lookup import label_of, lookup_tokens
from postweave.operators.tags import tag_inventory
from postweave.plans.corpus import (
    COMMENT,
    POSTS_SQL,
    documents,
    documents_sql,
    posts,
    table,
)
from postweave.plans.registry import Query
from postweave.plans.text_queries import marks_sql, on, upper_tags_sql
from postweave.session import scratch_path
from postweave.sources.incremental import SOURCE, IncrementalRun
from postweave.sources.manifest import data_version, scan_manifest, without_names
from postweave.sources.posts import explode_request, read_labels, read_posts, read_testset
from postweave.sources.quarantine import checked_posts, reason_counts
from postweave.sources.rules import load_faces, load_pairs, load_rules, load_tags
from postweave.sources.snapshots import remove

# --- sources: files that Spark derives from the tables ----------------------------


def _read_posts(spark, sf_dir):
    return read_posts(
        spark, f"{sf_dir}/documents.parquet", id_col="doc_id", nickname_col="source", comment_col="text"
    )


def _read_posts_json(spark, sf_dir):
    path = scratch_path(spark, "posts-json")
    posts(spark, sf_dir).write.json(path)
    return read_posts(spark, path, "json")


# Six kinds of lines by id; only the first is a post.
_LINES = [
    "to_json(named_struct('id', doc_id, 'nickname', source, 'comment', text))",
    "to_json(named_struct('id', doc_id, 'comment', text))",
    "to_json(named_struct('id', doc_id, 'nickname', n_chars, 'comment', array(text)))",
    "left(to_json(named_struct('id', doc_id, 'nickname', source, 'comment', text)), 20)",
    "concat('[', doc_id, ']')",
    "concat('{\"nickname\": null, \"comment\": \"', lang, '\", \"id\": \"', doc_id, '\", \"more\": 1}')",
]


def _checked_lines(spark, sf_dir):
    kinds = " ".join(f"WHEN {k} THEN {line}" for k, line in enumerate(_LINES))
    lines = table(spark, sf_dir, "documents").selectExpr("doc_id", f"CASE doc_id % {len(_LINES)} {kinds} END AS value")
    return checked_posts(lines)


def _quarantine(spark, sf_dir):
    """Every line once, as a post or with its reasons."""
    checked = _checked_lines(spark, sf_dir)
    reasons = F.array_join("reasons", ", ").alias("reasons")
    return checked.select("doc_id", "id", "nickname", "comment", reasons)


_QUARANTINE_SQL = """
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN doc_id END AS id, CASE WHEN doc_id % 6 = 0 THEN source END AS nickname,
       CASE WHEN doc_id % 6 = 0 THEN text END AS comment,
       ['', 'nickname: missing', 'nickname: not text, comment: not text', 'malformed', 'not an object',
        'id: not an integer, nickname: null'][doc_id % 6 + 1] AS reasons
FROM documents"""


def _explode_request(spark, sf_dir):
    requests = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.array(
            F.struct(F.col("source").alias("nickname"), F.col("text").alias("comment")),
            F.struct(F.col("lang").alias("nickname"), F.reverse("source").alias("comment")),
        ).alias("items"),
    )
    return explode_request(requests, ["id"])


def _read_label_csv(spark, sf_dir):
    path = scratch_path(spark, "labels-csv")
    table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.expr("CASE WHEN doc_id % 7 > 0 THEN source END").alias("nickname_class"),
        F.expr("CASE WHEN doc_id % 5 > 0 THEN lang END").alias("comment_class"),
    ).write.option("header", True).csv(path)
    return read_labels(spark, path, ["ord", "comment_class"]).where(
        F.col("comment_class").isNotNull()
    )


def _read_testset_csv(spark, sf_dir):
    path = scratch_path(spark, "testset-csv")
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "'  ' || source || ' ' AS nickname", "' ' || text || chr(92) || 'x ' AS comment"
    )
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_testset(spark, path, multi_line=True)


def _load_rule_json(spark, sf_dir):
    # One small rule file per document.
    path = scratch_path(spark, "rules-json")
    name = F.concat(F.col("source"), F.lit("-"), F.col("doc_id"))
    table(spark, sf_dir, "documents").select(
        F.struct(
            F.create_map(name, F.col("lang")).alias("word"),
            F.array(F.array(F.concat(name, F.lit("+")), F.lit("x")), F.array(name, F.col("lang"))).alias("sentence"),
        ).alias("incorrect"),
        F.struct(F.create_map(F.lit("[SRC]"), F.array(name, F.col("lang"))).alias("base")).alias("structed"),
        F.create_map(F.lit("!"), F.concat(F.lit("["), name, F.lit("]"))).alias("punct"),
        F.struct(
            F.create_map(F.lit("[FACE]"), F.concat(F.lit("]^"), F.col("source"))).alias("unicode"),
            F.create_map(F.lit("[TEXT]"), F.array(name, F.col("source"))).alias("text"),
        ).alias("emoji"),
    ).write.json(path)
    return load_rules(spark, path, multi_line=False)


_RULE_SQL = """
WITH d AS (SELECT source || '-' || doc_id AS n, lang, source FROM documents)
SELECT 'word' AS "group", 0 AS ord, n AS key, n AS pattern, lang AS replacement FROM d
UNION ALL SELECT 'sentence', 0, n || '+', n || '+', 'x' FROM d
UNION ALL SELECT 'sentence', 1, n, n, lang FROM d
UNION ALL SELECT 'base', 0, '[SRC]', n, '[SRC]' FROM d
UNION ALL SELECT 'base', 1, '[SRC]', lang, '[SRC]' FROM d
UNION ALL SELECT 'punct', 0, '!', '[' || n || ']', '!' FROM d
UNION ALL SELECT 'emoji_set', 0, '[FACE]', '(?:[\\]\\^' || source || '])+', '[FACE]' FROM d
UNION ALL SELECT 'emoji_text', 0, '[TEXT]', '(?i)(?:' || n || '|' || source || ')+', '[TEXT]' FROM d
"""


def _lines_file(spark, sf_dir, sql: str) -> str:
    """A line per document in two files, in the order of ids."""
    path = scratch_path(spark, "lines")
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{sql} AS value", "doc_id % 2 AS part")
    ordered = rows.repartition("part").sortWithinPartitions("part", "doc_id")
    ordered.select("part", "value").write.partitionBy("part").text(path)
    return path


def _part(rules):
    return rules.withColumn("part", F.regexp_extract("file", "part=([0-9])", 1).cast("long")).drop("file")


def _load_face_lines(spark, sf_dir):
    path = _lines_file(spark, sf_dir, "'  :' || upper(source) || ')' || doc_id || ' '")
    return _part(load_faces(spark, path, with_file=True))


def _load_pair_lines(spark, sf_dir):
    path = _lines_file(
        spark, sf_dir, "CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || doc_id || ' -> ' || lang END"
    )
    return _part(load_pairs(spark, path, with_file=True))


def _load_tag_json(spark, sf_dir):
    path = scratch_path(spark, "tags-json")
    table(spark, sf_dir, "documents").selectExpr(
        "array('[' || upper(source) || ']', '[' || doc_id || ']') AS additional_special_tokens"
    ).write.json(path)
    return load_tags(spark, path, multi_line=False)


TABLES = ["documents", "events", "labels", "orders"]


def _scanned(spark, sf_dir):
    """File names as the scans of the tables give them, with the rows read from each."""
    return scan_manifest({name: table(spark, sf_dir, name) for name in TABLES})


def _input_manifest(spark, sf_dir):
    files = without_names(_scanned(spark, sf_dir), "table", ["labels"])
    return files.groupBy("table").agg(
        F.sum("n_rows").alias("n_rows"), (F.min("length") > 0).alias("has_length")
    )


def _input_version(spark, sf_dir):
    """A version per table, told by what it does, since it differs between copies of the files: the
    same for the same files, another one for each table and after a change of time or size."""
    files = _scanned(spark, sf_dir)
    versions = data_version(files, ["table"])
    changed = files.withColumn("modificationTime", F.expr("modificationTime + INTERVAL 1 SECOND"))
    grown = files.withColumn("length", F.col("length") + 1)
    renamed = lambda df, name: data_version(df, ["table"]).select("table", F.col("version").alias(name))
    rows = files.groupBy("table").agg(F.sum("n_rows").alias("n_rows"))
    once = versions.groupBy("version").agg(F.count("*").alias("tables"))
    return (
        versions.join(once, "version")
        .join(renamed(files, "again"), "table")
        .join(renamed(changed, "touched"), "table")
        .join(renamed(grown, "grown"), "table")
        .join(rows, "table")
        .select(
            "table",
            "n_rows",
            F.length("version").alias("version_length"),
            (F.col("tables") == 1).alias("own_version"),
            (F.col("version") == F.col("again")).alias("stable"),
            ((F.col("version") != F.col("touched")) & (F.col("version") != F.col("grown"))).alias("sees_changes"),
        )
    )


def _incremental(spark, sf_dir):
    """Documents as six folders of files, each written by as many tasks as the input has splits; between
    two runs one is written anew, one goes and one is added."""
    source, root = scratch_path(spark, "incremental-in"), scratch_path(spark, "incremental")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")

    def put(part: int, rows, turn: int = 0) -> None:
        rows.where(F.col("doc_id") % 6 == part).write.parquet(f"{source}/part{part}-{turn}")

    def transform(docs):
        return docs.select(
            F.col("doc_id").alias("id"), F.length("text").alias("n_chars"), F.concat(F.lit("<"), "text", F.lit(">")).alias("marked"), SOURCE
        )

    job = IncrementalRun(spark, source, "doc_id BIGINT, text STRING", root, transform, folders=True)
    for part in range(5):
        put(part, rows.withColumn("text", F.lit("an earlier text")) if part == 1 else rows)
    job.run()
    # The rows of a write that replaces another come under a new path, as Spark names its files.
    put(1, rows, turn=1)
    remove(spark, f"{source}/part1-0")
    put(5, rows)
    remove(spark, f"{source}/part4-0")
    changed = job.run()
    names = ("added", "changed", "removed", "same")
    return job.result().select("*", *[F.lit(changed[name]).alias(f"files_{name}") for name in names])


def _exclude_names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return without_names(rows, "source", ["src0", "src3"])


# --- windows ----------------------------------------------------------------------

TOKEN_SQL = r"\[[A-Z_]+\]|[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\p{Z}\s]"
VISIBLE_SQL = r"length(regexp_replace(c, '\[[A-Z_]+\]|\s', '', 'g'))"


def sentence_list_sql(c: str = "c") -> str:
    d = DELIMITERS.replace("^", "\\^")
    return (
        f"list_concat(regexp_extract_all({c}, '[^{d}]*[{d}]+'), "
        f"[regexp_extract({c}, '([^{d}]*)$', 1)])"
    )


def trimmed_sql(s: str) -> str:
    d = DELIMITERS.replace("^", "\\^")
    return rf"regexp_replace(regexp_replace({s}, '^\s+', ''), '\s+([{d}]*)$', '\1')"


def token_list_sql(s: str) -> str:
    return f"list_concat(['{BEGIN}'], regexp_extract_all({s}, '{TOKEN_SQL}'), ['{END}'])"


def window_list_sql(t: str, size: int) -> str:
    n = f"len({t})"
    tail = f"CASE WHEN {n} >= {size} THEN {n} - {size} ELSE greatest(2 * {n} - {size}, 0) END"
    return (
        f"list_transform(range(0, {n}, {size - 20}), lambda cur: CASE WHEN {n} - cur > 20 "
        f"THEN {t}[cur + 1 : least(cur + {size}, {n})] ELSE {t}[({tail}) + 1 : {n}] END)"
    )


def windows_sql(text_sql: str, size: int, key: str = "id") -> str:
    """CTEs ending in ``win(id, sentence_no, window_no, toks)``, all sentences."""
    return f"""
WITH d AS ({text_sql}),
parts AS (SELECT {key}, unnest(generate_series(0, len(l) - 1)) AS sentence_no, unnest(l) AS s
          FROM (SELECT {key}, {sentence_list_sql()} AS l FROM d)),
toks AS (SELECT {key}, sentence_no, {token_list_sql('s')} AS t FROM parts),
win AS (SELECT {key}, sentence_no, unnest(generate_series(0, len(w) - 1)) AS window_no, unnest(w) AS toks
        FROM (SELECT {key}, sentence_no, {window_list_sql('t', size)} AS w FROM toks))"""


SENTENCE_TEXT = "text || '. ab ,c  !? x' || repeat(' wort', CAST(doc_id % 300 AS INTEGER))"


def _sentence_rows(spark, sf_dir):
    rows = documents(spark, sf_dir, c=SENTENCE_TEXT)
    return rows.select("id", F.posexplode(sentences(F.col("c"))).alias("sentence_no", "sentence"))


def _sentence_tokens(spark, sf_dir):
    rows = documents(spark, sf_dir, c=on(" [NUM] a_b ㅋㅋ", " don?t 3.5"))
    return rows.select("id", F.array_join(tokens(F.col("c")), " ").alias("tokens"))


def _truncated(spark, sf_dir):
    rows = documents(spark, sf_dir, c="text")
    return rows.select("id", F.array_join(truncated(F.col("c"), 40), " ").alias("tokens"))


def _window_rows(spark, sf_dir):
    rows = documents(spark, sf_dir, c=SENTENCE_TEXT)
    return window_table(rows, ["id"], "c", WindowOptions(40)).withColumn(
        "tokens", F.array_join("tokens", " ")
    )


def _window_counts(spark, sf_dir):
    rows = documents(spark, sf_dir, c=SENTENCE_TEXT)
    return window_stats(window_table(rows, ["id"], "c", WindowOptions(256)), ["id"])


def _long_texts(spark, sf_dir):
    rows = documents(spark, sf_dir, c="text || ' [NUM] [TEXT_EMOJI]'", n="source || ' ' || lang")
    return rows.select(
        "id",
        is_long(F.col("c"), MAX_TOKENS["comment"]).alias("long_comment"),
        is_long(F.col("n"), MAX_TOKENS["nickname"]).alias("long_nickname"),
    )


def _route_counts(spark, sf_dir):
    rows = documents(spark, sf_dir, comment=COMMENT)
    return route(rows, "comment", MAX_TOKENS["comment"]).groupBy("is_long").agg(
        F.count("*").alias("n"), F.sum(F.length("comment")).alias("n_chars")
    )


# --- audits ---------------------------------------------------------------------------

MARKED = on(" wow!!?? [tag_x]", " plain", " a [b] ??")


def _changed_rows(spark, sf_dir):
    before = documents(spark, sf_dir, c=MARKED)
    after = before.select("id", steps.upper_tags(steps.sort_marks(F.col("c"))).alias("c"))
    return changed_rows(before, after, "id", ["c"], ["[tag_x]", "[B]"])


def _changed_columns(spark, sf_dir):
    rows = documents(spark, sf_dir, c=MARKED).withColumn(
        "done", steps.upper_tags(steps.sort_marks(F.col("c")))
    )
    return changed_columns(rows, {"c": ("c", "done")}, "id")


_CHANGED_SQL = f"""
WITH d AS ({documents_sql(c=MARKED)}),
a AS (SELECT id, c AS c_before, {upper_tags_sql(marks_sql('c'))} AS c_after FROM d)
SELECT id, c_before, c_after FROM a WHERE c_before IS DISTINCT FROM c_after"""


def _missing_labels(spark, sf_dir):
    expected = table(spark, sf_dir, "documents").select("doc_id")
    return missing_keys(expected, table(spark, sf_dir, "labels"), "doc_id", size="quality")


def _size_mismatches(spark, sf_dir):
    declared = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    counted = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "length(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n_chars"
    )
    return mismatches(declared, counted, "doc_id", "n_chars")


# --- catalogues and vectors ---------------------------------------------------------


def _label_catalogue(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 > 0 THEN source END AS source"
    )
    return label_catalogue(rows, "source", "doc_id", "nickname")


def _both_catalogues(spark, sf_dir):
    return catalogues(
        table(spark, sf_dir, "documents"), {"nickname": "source", "comment": "lang"}, "doc_id"
    )


_CATALOGUES_SQL = """
SELECT 'nickname' AS head, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS class_id, source AS label
FROM documents WHERE source IS NOT NULL GROUP BY source
UNION ALL
SELECT 'comment', CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER), lang
FROM documents WHERE lang IS NOT NULL GROUP BY lang"""


def _category_lists(spark, sf_dir):
    return categories(_both_catalogues(spark, sf_dir)).withColumn(
        "categories", F.array_join("categories", ",")
    )


def _class_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CAST(user_id % 5 AS INT) AS class_id"
    )
    return label_of(rows, _both_catalogues(spark, sf_dir), "comment")


def _mean_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    means = mean_vector(rows, ["label"], "embedding", "m")
    return means.select("label", F.posexplode("m").alias("i", "m")).withColumn("m", F.round("m", 6))


def _top_class(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.floor(x * 10))
    return table(spark, sf_dir, "embeddings").select("vec_id", argmax(v).alias("class_id"))


def _rounded(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(round_vector(v)).alias("i", "p")
    )


def _softmax(spark, sf_dir):
    logits = F.expr("array(doc_id % 5, n_chars % 7, doc_id % 3)")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(softmax(logits)).alias("i", "p")
    ).withColumn("p", F.round("p", 9))


# --- lexicon lookup -------------------------------------------------------------------


def _lexicon(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))).alias("token")
    )
    return words.distinct().withColumn(
        "replacement", F.concat(F.lit("<"), "token", F.lit(">"))
    )


def _lexicon_lookup(max_rows: int):
    def run(spark, sf_dir):
        rows = documents(spark, sf_dir, c="text")
        return lookup_tokens(rows, "id", "c", _lexicon(spark, sf_dir), max_rows)

    return run


_LOOKUP_SQL = rf"""
WITH lex AS (SELECT list(DISTINCT t) AS l FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS t FROM benchmark)),
p AS (SELECT doc_id AS id, regexp_extract_all(text, '{TOKEN_SQL}|[\p{{Z}}\s]+') AS ts FROM documents),
t AS (SELECT id, unnest(generate_series(1, len(ts))) AS i, unnest(ts) AS t FROM p),
u AS (SELECT id, i, CASE WHEN t IN (SELECT unnest(l) FROM lex) THEN '<' || t || '>' ELSE t END AS t FROM t)
SELECT id, string_agg(t, '' ORDER BY i) AS c FROM u GROUP BY id"""

# --- activity -----------------------------------------------------------------------

TTL_SECONDS = 8 * 3600
LINE_SQL = (
    "doc_id % 2 AS part, "
    "CAST(row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS INTEGER) AS ord"
)
GAP_SECONDS = 6 * 3600


def _live_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    now = rows.agg(F.max("ts")).first()[0]
    return live_keys(rows, "user_id", "ts", now, TTL_SECONDS)


def _sessions(spark, sf_dir):
    return activity_sessions(table(spark, sf_dir, "events"), "user_id", "ts", GAP_SECONDS)


def _idle(spark, sf_dir):
    return idle_intervals(_sessions(spark, sf_dir), "user_id")


SESSIONS_SQL = f"""
WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {GAP_SECONDS * 1_000_000}
           THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e),
s AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events
      FROM n GROUP BY user_id, no)"""

LIVE_SQL = (
    "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id "
    f"HAVING (SELECT epoch_us(max(ts)) FROM events) - epoch_us(max(ts)) < {TTL_SECONDS} * 1000000::BIGINT"
)

QUERIES: dict[str, Query] = {
    "read_posts": Query(
        _read_posts, "SELECT doc_id AS id, source AS nickname, text AS comment FROM documents"
    ),
    "read_posts_json": Query(_read_posts_json, POSTS_SQL),
    "quarantine_posts": Query(_quarantine, _QUARANTINE_SQL),
    "quarantine_reasons": Query(
        lambda spark, sf_dir: reason_counts(_checked_lines(spark, sf_dir)),
        f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ', ')) AS reason FROM ({_QUARANTINE_SQL})) "
        "WHERE reason <> '' GROUP BY reason",
    ),
    "explode_request": Query(
        _explode_request,
        "SELECT doc_id AS id, 0 AS item_no, source AS nickname, text AS comment FROM documents "
        "UNION ALL SELECT doc_id, 1, lang, reverse(source) FROM documents",
    ),
    "read_label_csv": Query(
        _read_label_csv,
        "SELECT doc_id AS ord, lang AS comment_class FROM documents WHERE doc_id % 5 > 0",
    ),
    "read_testset_csv": Query(
        _read_testset_csv,
        r"SELECT doc_id AS id, source AS nickname, "
        r"regexp_replace(text || ',x', '^\s+', '') AS comment FROM documents",
    ),
    "load_rule_json": Query(_load_rule_json, _RULE_SQL),
    "load_face_lines": Query(
        _load_face_lines,
        "SELECT 'face' AS \"group\", ':' || upper(source) || ')' || doc_id AS key, "
        "':' || lower(source) || ')' || doc_id AS pattern, '[TEXT_EMOJI]' AS replacement, "
        f"{LINE_SQL} FROM documents",
    ),
    "load_pair_lines": Query(
        _load_pair_lines,
        "SELECT 'word' AS \"group\", source || doc_id AS key, source || doc_id AS pattern, "
        f"lang AS replacement, part, ord FROM (SELECT *, {LINE_SQL} FROM documents) WHERE doc_id % 3 > 0",
    ),
    "load_tag_json": Query(
        _load_tag_json,
        "SELECT 'tag' AS \"group\", ord, t AS key, t AS pattern, t AS replacement FROM ("
        "SELECT 0 AS ord, '[' || upper(source) || ']' AS t FROM documents "
        "UNION ALL SELECT 1, '[' || doc_id || ']' FROM documents)",
    ),
    "input_manifest": Query(
        _input_manifest,
        " UNION ALL ".join(
            f"SELECT '{t}' AS \"table\", count(*) AS n_rows, true AS has_length FROM {t}" for t in TABLES if t != "labels"
        ),
    ),
    "input_version": Query(
        _input_version,
        " UNION ALL ".join(
            f"SELECT '{t}' AS \"table\", count(*) AS n_rows, 32 AS version_length, true AS own_version, true AS stable, "
            f"true AS sees_changes FROM {t}"
            for t in TABLES
        ),
    ),
    # A file that is written again has another name: the old one goes, the new one is added.
    "incremental_run": Query(
        _incremental,
        "SELECT doc_id AS id, CAST(length(text) AS INTEGER) AS n_chars, '<' || text || '>' AS marked, 2 AS files_added, "
        "0 AS files_changed, 2 AS files_removed, 3 AS files_same FROM documents WHERE doc_id % 6 <> 4",
    ),
    "exclude_names": Query(
        _exclude_names, "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src3')"
    ),
    "long_texts": Query(
        _long_texts,
        f"WITH d AS (SELECT doc_id AS id, text || ' [NUM] [TEXT_EMOJI]' AS c, source || ' ' || lang AS n FROM documents) "
        f"SELECT id, {VISIBLE_SQL} >= {long_border(256)} AS long_comment, "
        f"{VISIBLE_SQL.replace('(c,', '(n,')} >= {long_border(40)} AS long_nickname FROM d",
    ),
    "route_texts": Query(
        _route_counts,
        f"SELECT {VISIBLE_SQL} >= 281 AS is_long, count(*) AS n, sum(length(c)) AS n_chars "
        f"FROM ({documents_sql(c=COMMENT)}) GROUP BY 1",
    ),
    "split_sentences": Query(
        _sentence_rows,
        f"{windows_sql(documents_sql(c=SENTENCE_TEXT), 256)} "
        f"SELECT id, CAST(sentence_no AS INTEGER) AS sentence_no, {trimmed_sql('s')} AS sentence FROM parts",
    ),
    "tokenize": Query(
        _sentence_tokens,
        f"SELECT id, array_to_string({token_list_sql('c')}, ' ') AS tokens "
        f"FROM ({documents_sql(c=on(' [NUM] a_b ㅋㅋ', ' don?t 3.5'))})",
    ),
    "truncate_tokens": Query(
        _truncated,
        f"SELECT doc_id AS id, array_to_string(list_concat(['{BEGIN}'], "
        f"regexp_extract_all(text, '{TOKEN_SQL}')[1:38], ['{END}']), ' ') AS tokens FROM documents",
    ),
    "token_windows": Query(
        _window_rows,
        f"{windows_sql(documents_sql(c=SENTENCE_TEXT), 40)} "
        "SELECT id, sentence_no, window_no, array_to_string(toks, ' ') AS tokens FROM win",
    ),
    "window_counts": Query(
        _window_counts,
        f"{windows_sql(documents_sql(c=SENTENCE_TEXT), 256)} "
        "SELECT id, count(*) AS n_windows, sum(len(toks)) AS n_tokens FROM win GROUP BY id",
    ),
    "changed_rows": Query(
        _changed_rows,
        _CHANGED_SQL + r" AND (regexp_matches(c_before, '\[tag_x\]|\[B\]') OR regexp_matches(c_after, '\[tag_x\]|\[B\]'))",
    ),
    "changed_columns": Query(_changed_columns, _CHANGED_SQL),
    "missing_labels": Query(
        _missing_labels,
        "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)",
    ),
    "size_mismatches": Query(
        _size_mismatches,
        "SELECT doc_id, n_chars AS left_value, length(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS right_value "
        "FROM documents WHERE n_chars <> length(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END",
    ),
    "label_catalogue": Query(
        _label_catalogue,
        "SELECT 'nickname' AS head, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS class_id, "
        "source AS label FROM documents WHERE doc_id % 3 > 0 GROUP BY source",
    ),
    "label_catalogues": Query(_both_catalogues, _CATALOGUES_SQL),
    "category_lists": Query(
        _category_lists,
        f"SELECT head, string_agg(label, ',' ORDER BY class_id) AS categories FROM ({_CATALOGUES_SQL}) GROUP BY head",
    ),
    "class_labels": Query(
        _class_labels,
        f"SELECT event_id, CAST(user_id % 5 AS INTEGER) AS class_id, label FROM events "
        f"LEFT JOIN (SELECT * FROM ({_CATALOGUES_SQL}) WHERE head = 'comment') c ON user_id % 5 = c.class_id",
    ),
    "mean_vectors": Query(
        _mean_vectors,
        "SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(x), 6) AS m FROM ("
        "SELECT label, unnest(generate_series(1, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x "
        "FROM embeddings) GROUP BY label, i",
    ),
    "top_class": Query(
        _top_class,
        "SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS class_id FROM ("
        "SELECT vec_id, list_transform(embedding, lambda x: floor(x * 10)) AS v FROM embeddings)",
    ),
    "rounded_vectors": Query(
        _rounded,
        "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round_even(CAST(embedding[i] AS DOUBLE), 2) + 0.0 AS p "
        "FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)",
    ),
    "softmax_vectors": Query(
        _softmax,
        "WITH l AS (SELECT doc_id, [doc_id % 5, n_chars % 7, doc_id % 3] AS v FROM documents), "
        "e AS (SELECT doc_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM l) "
        "SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, round(e[i] / list_sum(e), 9) AS p FROM e, generate_series(1, 3) g(i)",
    ),
    "lexicon_lookup": Query(_lexicon_lookup(200_000), _LOOKUP_SQL),
    "lexicon_lookup_salted": Query(_lexicon_lookup(10), _LOOKUP_SQL),
    "tag_inventory": Query(
        lambda spark, sf_dir: tag_inventory(
            documents(spark, sf_dir, c="text || '[' || upper(translate(source, '0123456789', 'ABCDEFGHIJ')) || '] [DAYS] [x]'"),
            "c",
            ["[DAYS]", "[POINT_DOT]", "[POINT_COM]"],
        ),
        r"SELECT DISTINCT tag FROM (SELECT unnest(regexp_extract_all(text || '[' || "
        r"upper(translate(source, '0123456789', 'ABCDEFGHIJ')) || '] [DAYS] [x]', '\[[A-Z_]+\]')) AS tag FROM documents) "
        r"WHERE tag NOT IN ('[DAYS]', '[POINT_DOT]', '[POINT_COM]') ORDER BY tag",
    ),
    "live_keys": Query(
        _live_keys,
        LIVE_SQL,
    ),
    "activity_sessions": Query(_sessions, f"{SESSIONS_SQL} SELECT * FROM s"),
    "idle_intervals": Query(
        _idle,
        f"{SESSIONS_SQL} SELECT * FROM (SELECT user_id, lag(session_end) OVER (PARTITION BY user_id ORDER BY session_start) "
        "AS idle_start, session_start AS idle_end FROM s) WHERE idle_start IS NOT NULL",
    ),
}
