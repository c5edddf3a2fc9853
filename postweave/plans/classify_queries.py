"""Classification queries.

The lexicon weighs common function words, so the comment head tells the
language; its classes are the languages in order of appearance.  The nickname
head tells members from guests.  Weights are integers: sums are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.functions import steps
from postweave.functions.text import squeeze
from postweave.functions.windows import MAX_TOKENS, WindowOptions, window_table
from postweave.operators.catalogue import catalogues, categories
from postweave.operators.classify import classify, classify_heads, combine_heads
from postweave.operators.scorers import (
    ArrowScorer,
    BatchScorer,
    HashedLexiconScorer,
    LexiconScorer,
    MLScorer,
    ranking,
    score_tokens,
)
from postweave.plans.corpus import COMMENT, NICKNAME, documents, documents_sql, table
from postweave.plans.registry import Query
from postweave.plans.table_queries import VISIBLE_SQL, token_list_sql, windows_sql
from postweave.plans.text_queries import tidy_marks_sql
from postweave.session import literal_rows, scratch_path
from postweave.sources.results import CATEGORY_SCHEMA, RESULT_SCHEMA, write_results

# Fixed values of this module: label -> {token: weight}.
COMMENT_WEIGHTS = {
    "en": {"the": 3, "of": 2, "and": 2, "to": 1, "is": 2, "that": 2, "with": 2, "for": 1},
    "fr": {"le": 2, "et": 2, "les": 2, "la": 1, "des": 1, "un": 1, "pour": 2, "dans": 2},
    "de": {"der": 3, "und": 2, "die": 2, "von": 2, "nicht": 2, "den": 1, "ist": 2, "mit": 2},
    "es": {"el": 2, "los": 2, "que": 1, "en": 1, "una": 2, "por": 2, "con": 2, "la": 1},
}
NICKNAME_WEIGHTS = {
    "member": {"src0": 1, "src3": 2, "src5": 1, "가나다": 2, "abc": 1},
    "guest": {"src1": 2, "src7": 1, "123": 2, "user": 1, "가a나": 1},
}
NICKNAME_LABEL = "CASE WHEN doc_id % 3 = 1 THEN 'guest' WHEN doc_id % 3 = 2 THEN 'member' END"


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang AS comment_class", f"{NICKNAME_LABEL} AS nickname_class"
    )
    found = catalogues(rows, {"nickname": "nickname_class", "comment": "comment_class"}, "doc_id")
    # One row per class: read once, then part of every plan that names classes.
    return literal_rows(
        spark, "head STRING, class_id INT, label STRING", [tuple(r) for r in found.select("head", "class_id", "label").collect()]
    )


def weight_table(spark: SparkSession, labels: DataFrame, head: str) -> DataFrame:
    source = COMMENT_WEIGHTS if head == "comment" else NICKNAME_WEIGHTS
    rows = [(label, token, w) for label, tokens in source.items() for token, w in tokens.items()]
    weights = literal_rows(spark, "label STRING, token STRING, weight INT", rows)
    classes = labels.where(F.col("head") == head).select("label", "class_id")
    return weights.join(classes, "label").select("token", "class_id", "weight")


def scorer(spark: SparkSession, labels: DataFrame, head: str, **options) -> LexiconScorer:
    n = len(COMMENT_WEIGHTS if head == "comment" else NICKNAME_WEIGHTS)
    return LexiconScorer(weight_table(spark, labels, head), n, **options)


# --- SQL ------------------------------------------------------------------------------


def _weights_sql(head: str) -> str:
    source = COMMENT_WEIGHTS if head == "comment" else NICKNAME_WEIGHTS
    rows = ", ".join(
        f"('{label}', '{token}', {w})" for label, tokens in source.items() for token, w in tokens.items()
    )
    column = "lang" if head == "comment" else f"({NICKNAME_LABEL})"
    return f"""
cat AS (SELECT {column} AS label, row_number() OVER (ORDER BY min(doc_id)) - 1 AS class_id
        FROM documents WHERE {column} IS NOT NULL GROUP BY {column}),
wt AS (SELECT token, label, class_id, weight FROM (VALUES {rows}) v(label, token, weight) JOIN cat USING (label))"""


def classify_sql(text_sql: str, head: str, out: str, labels_only: bool = False) -> str:
    """CTEs over ``text_sql`` (``id, c``) ending in ``out``: id, label and vector."""
    size = MAX_TOKENS[head]
    border = size * 11 // 10
    long_texts = f"SELECT id, c FROM ({text_sql}) WHERE {VISIBLE_SQL} >= {border}"
    short = "" if labels_only else f"WHERE {VISIBLE_SQL} < {border}"
    short_tokens = token_list_sql("c").replace("), ['[SEP]", f")[1:{size - 2}], ['[SEP]")
    windows = windows_sql(long_texts, size)
    both = (
        f"SELECT id, 0 AS sentence_no, 0 AS window_no, {short_tokens} AS toks FROM ({text_sql}) {short}"
    )
    if not labels_only:
        both += " UNION ALL SELECT id, sentence_no, window_no, toks FROM win"
    # windows are numbered per text so that each is one group
    return f"""{windows},
{_weights_sql(head)},
allw AS (SELECT *, row_number() OVER () AS w FROM ({both})),
tok AS (SELECT id, w, unnest(toks) AS token FROM allw),
hit AS (SELECT w, class_id, sum(weight) AS s FROM tok JOIN wt USING (token) GROUP BY ALL),
logit AS (SELECT allw.id, allw.w, cat.class_id, coalesce(hit.s, 0) AS s
          FROM allw CROSS JOIN cat LEFT JOIN hit ON hit.w = allw.w AND hit.class_id = cat.class_id),
e AS (SELECT id, w, class_id, exp(s - max(s) OVER (PARTITION BY w)) AS e FROM logit),
p AS (SELECT id, w, class_id, e / sum(e) OVER (PARTITION BY w) AS p FROM e),
m AS (SELECT id, class_id, avg(p) AS p FROM p GROUP BY id, class_id),
{out} AS (SELECT id, arg_min(label, rank) AS predicted, {_vector_sql(head)}
          FROM (SELECT m.id, m.class_id, m.p, cat.label,
                row_number() OVER (PARTITION BY m.id ORDER BY round(m.p, 12) DESC, m.class_id) AS rank
                FROM m JOIN cat USING (class_id)) GROUP BY id)"""


def _vector_sql(head: str) -> str:
    n = len(COMMENT_WEIGHTS if head == "comment" else NICKNAME_WEIGHTS)
    return ", ".join(
        f"round_even(max(CASE WHEN class_id = {k} THEN p END), 2) AS p{k}" for k in range(n)
    )


# --- plans ----------------------------------------------------------------------------

FLAGSHIP_TEXT = COMMENT


def flat(df: DataFrame, head: str, n: int, prefix: str = "") -> DataFrame:
    """Result struct as plain columns."""
    column = f"{head}_result" if f"{head}_result" in df.columns else head
    return df.select(
        "id",
        F.col(f"{column}.predicted").alias(f"{prefix}predicted"),
        *[F.col(f"{column}.prob")[k].alias(f"{prefix}p{k}") for k in range(n)],
    )


def _tidied(c):
    return steps.tidy_marks(squeeze(F.lower(c), "[.!?]", min_run=3, keep=2))


def _tidied_sql(c: str) -> str:
    c = f"lower({c})"
    for mark in ".!?":
        c = f"regexp_replace({c}, '\\{mark}{{3,}}', '{mark * 2}', 'g')"
    return tidy_marks_sql(c)


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: tidy every document, label it, count per label."""
    labels = label_table(spark, sf_dir)
    rows = documents(spark, sf_dir, comment=FLAGSHIP_TEXT).withColumn(
        "comment", _tidied(F.col("comment"))
    )
    labelled = classify(rows, scorer(spark, labels, "comment"), labels, "comment")
    return (
        labelled.groupBy(F.col("comment_result.predicted").alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy("label")
    )


def _classify_one(head: str, text_sql: str, **options):
    def run(spark, sf_dir):
        labels = label_table(spark, sf_dir)
        rows = documents(spark, sf_dir, **{head: text_sql})
        model = scorer(spark, labels, head, **options)
        return flat(classify(rows, model, labels, head), head, model.n_classes)

    return run


def _labels_only(spark, sf_dir):
    labels = label_table(spark, sf_dir)
    rows = documents(spark, sf_dir, comment="lower(text)")
    return classify(rows, scorer(spark, labels, "comment"), labels, "comment", labels_only=True).select(
        "id", "comment_label"
    )


def _model_from(weights: dict[str, list[int]], n: int):
    """A stand-in model for the Arrow path: the same lexicon in numpy."""

    def make():
        def predict(texts: list[str]) -> np.ndarray:
            scores = np.zeros((len(texts), n))
            for i, text in enumerate(texts):
                for token in text.split(" "):
                    if token in weights:
                        scores[i] += weights[token]
            scaled = np.exp(scores - scores.max(axis=1, keepdims=True))
            return scaled / scaled.sum(axis=1, keepdims=True)

        return predict

    return make


def _arrow_model(spark, sf_dir):
    labels = label_table(spark, sf_dir)
    vectors = scorer(spark, labels, "comment").vectors
    rows = documents(spark, sf_dir, comment="lower(text)")
    model = ArrowScorer(_model_from(vectors, len(COMMENT_WEIGHTS)), len(COMMENT_WEIGHTS))
    return flat(classify(rows, model, labels, "comment"), "comment", model.n_classes)


def _batched_model(spark, sf_dir):
    """As ``_arrow_model``, with the model kept in its worker and batches by length."""
    rows, labels = documents(spark, sf_dir, comment="lower(text)"), label_table(spark, sf_dir)
    vectors = scorer(spark, labels, "comment", inline_tokens=1_000).vectors
    model = BatchScorer(_model_from(vectors, len(COMMENT_WEIGHTS)), len(COMMENT_WEIGHTS))
    return flat(classify(rows, model, labels, "comment"), "comment", model.n_classes)


def _hashed_lexicon(spark, sf_dir):
    """The lexicon with a weight of nothing for every word of the documents: as many tokens as
    the corpus has words, joined by parts of the documents where it is too large for every executor."""
    rows, labels = documents(spark, sf_dir, comment="lower(text)"), label_table(spark, sf_dir)
    words = rows.select(F.explode(F.split("comment", r"\s+")).alias("token")).where("token <> ''").distinct()
    nothing = words.select("token", F.lit(0).alias("class_id"), F.lit(0).alias("weight"))
    weights = weight_table(spark, labels, "comment")
    model = HashedLexiconScorer(weights.unionByName(nothing, allowMissingColumns=True), len(COMMENT_WEIGHTS), split=True)
    return flat(classify(rows, model, labels, "comment"), "comment", model.n_classes)


def posts_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, nickname=f"lower({NICKNAME})", comment=f"lower({COMMENT})")


def scorers(spark: SparkSession, labels: DataFrame) -> dict[str, LexiconScorer]:
    return {head: scorer(spark, labels, head) for head in ("nickname", "comment")}


def flat_heads(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "id",
        *more,
        F.col("nickname.predicted").alias("nickname_predicted"),
        *[F.col("nickname.prob")[k].alias(f"n{k}") for k in range(len(NICKNAME_WEIGHTS))],
        F.col("comment.predicted").alias("comment_predicted"),
        *[F.col("comment.prob")[k].alias(f"c{k}") for k in range(len(COMMENT_WEIGHTS))],
    )


def _two_heads(spark, sf_dir):
    labels = label_table(spark, sf_dir)
    return flat_heads(classify_heads(posts_lower(spark, sf_dir), scorers(spark, labels), labels))


def _combined(spark, sf_dir):
    labels = label_table(spark, sf_dir)
    by_head = scorers(spark, labels)
    rows = posts_lower(spark, sf_dir)
    parts = [
        classify(rows.select("id", head), by_head[head], labels, head).select(
            "id", F.col(f"{head}_result").alias(head)
        )
        for head in by_head
    ]
    return flat_heads(combine_heads(*parts))


def _written(spark, sf_dir):
    labels = label_table(spark, sf_dir)
    path = scratch_path(spark, "results")
    done = classify_heads(posts_lower(spark, sf_dir), scorers(spark, labels), labels)
    write_results(done, path, categories(labels), fmt="json", model_type="lexicon")
    rows = spark.read.schema(RESULT_SCHEMA).json(f"{path}/results")
    lists = spark.read.schema(CATEGORY_SCHEMA).json(f"{path}/categories")
    by_head = {r["head"]: ",".join(r["categories"]) for r in lists.collect()}
    return flat_heads(rows, "model_type").withColumns(
        {f"{head}_categories": F.lit(by_head[head]) for head in ("nickname", "comment")}
    )


def _heads_sql() -> str:
    parts = {}
    for head, text in (("nickname", NICKNAME), ("comment", COMMENT)):
        body = classify_sql(documents_sql(c=f"lower({text})"), head, "res")
        parts[head] = f"({body} SELECT * FROM res)"
    return (
        f"SELECT n.id, n.predicted AS nickname_predicted, n.p0 AS n0, n.p1 AS n1, "
        f"c.predicted AS comment_predicted, c.p0 AS c0, c.p1 AS c1, c.p2 AS c2, c.p3 AS c3 "
        f"FROM {parts['nickname']} n JOIN {parts['comment']} c USING (id)"
    )


HEADS_SQL = _heads_sql()


def _category_sql(column: str) -> str:
    return (
        f"(SELECT string_agg(label, ',' ORDER BY first) FROM (SELECT {column} AS label, min(doc_id) AS first "
        f"FROM documents WHERE {column} IS NOT NULL GROUP BY 1))"
    )


WRITTEN_SQL = (
    f"SELECT *, 'lexicon' AS model_type, {_category_sql(f'({NICKNAME_LABEL})')} AS nickname_categories, "
    f"{_category_sql('lang')} AS comment_categories FROM ({HEADS_SQL})"
)


def _token_scores(spark, sf_dir):
    labels = label_table(spark, sf_dir)
    rows = documents(spark, sf_dir, c="lower(text)")
    windows = window_table(rows, ["id"], "c", WindowOptions(256))
    return score_tokens(
        windows, weight_table(spark, labels, "comment"), ["id", "sentence_no", "window_no"]
    )


def _trained(spark, sf_dir):
    """Train on four fifths of the labelled documents, then classify the rest by windows;
    per head the rows of both parts and whether the ranking is good, for toxic posts beyond chance."""
    rows = documents(spark, sf_dir, comment="text").join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), "id"
    )
    train, test = rows.where(F.col("id") % 5 > 0), rows.where(F.col("id") % 5 == 0)
    results = []
    for target in ("quality", "toxic"):
        toxic = target == "toxic"
        model = MLScorer.fit(train, "comment", target, features=1 << (16 if toxic else 14), few_words=toxic)
        labels = literal_rows(
            spark, "head STRING, class_id INT, label STRING", [("comment", k, f"{target}{k}") for k in (0, 1)]
        )
        scored = classify(test.withColumn("comment", F.lower("comment")), model, labels, "comment")
        scored = scored.select(F.col(target).alias("truth"), F.col("comment_result.prob")[1].alias("p"))
        results.append(ranking(scored, "truth", "p").select(F.lit(target).alias("head"), "*"))
    found = results[0].unionByName(results[1])
    sizes = train.agg(*[F.count(t).alias(t) for t in ("quality", "toxic")]).first()
    n_train = F.when(F.col("head") == "quality", sizes["quality"]).otherwise(sizes["toxic"])
    # With fewer than TELLING rows of a label the area says nothing.
    telling = F.least("n_positive", F.col("n_test") - F.col("n_positive")) >= TELLING
    # By chance the area is 0.5 with this standard error; two of them are passed by one chance in 40.
    n_negative = F.col("n_test") - F.col("n_positive")
    error = F.sqrt((F.col("n_test") + 1) / (12.0 * F.col("n_positive") * n_negative))
    bound = F.when(F.col("head") == "quality", F.lit(AUC_QUALITY)).otherwise(0.5 + 2 * error)
    return found.select(
        "head", n_train.alias("n_train"), "n_test", "n_positive", F.when(telling, F.col("auc") >= bound).alias("ranks_well")
    )


# Quality shows in marks and letters; toxic posts are few in small tables.
AUC_QUALITY = 0.9
TELLING = 10


def _trained_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS head, count(*) FILTER (doc_id % 5 > 0) AS n_train, count(*) FILTER (doc_id % 5 = 0) AS n_test, "
        f"CAST(sum(CASE WHEN doc_id % 5 = 0 THEN {t} END) AS BIGINT) AS n_positive "
        f"FROM labels JOIN documents USING (doc_id)"
        for t in ("quality", "toxic")
    )
    return f"SELECT *, CASE WHEN least(n_positive, n_test - n_positive) >= {TELLING} THEN true END AS ranks_well FROM ({parts})"


def _one_sql(head: str, text: str) -> str:
    return f"{classify_sql(documents_sql(c=text), head, 'res')} SELECT * FROM res"


QUERIES: dict[str, Query] = {
    "label_counts": Query(
        label_counts,
        f"{classify_sql(f'SELECT id, {_tidied_sql(chr(99))} AS c FROM ({documents_sql(c=FLAGSHIP_TEXT)})', 'comment', 'res')} "
        "SELECT predicted AS label, count(*) AS n FROM res GROUP BY 1 ORDER BY 1",
    ),
    "classify_comments": Query(
        _classify_one("comment", "lower(text)"), _one_sql("comment", "lower(text)")
    ),
    "classify_nicknames": Query(
        _classify_one("nickname", f"lower({NICKNAME})"), _one_sql("nickname", f"lower({NICKNAME})")
    ),
    "classify_joined_lexicon": Query(
        _classify_one("comment", "lower(text)", inline_tokens=0),
        _one_sql("comment", "lower(text)"),
    ),
    "classify_arrow_model": Query(_arrow_model, _one_sql("comment", "lower(text)")),
    "classify_batched_model": Query(_batched_model, _one_sql("comment", "lower(text)")),
    "classify_hashed_lexicon": Query(_hashed_lexicon, _one_sql("comment", "lower(text)")),
    "classify_labels_only": Query(
        _labels_only,
        f"{classify_sql(documents_sql(c='lower(text)'), 'comment', 'res', labels_only=True)} "
        "SELECT id, predicted AS comment_label FROM res",
    ),
    "classify_posts": Query(_two_heads, HEADS_SQL),
    "combine_heads": Query(_combined, HEADS_SQL),
    "write_results": Query(_written, WRITTEN_SQL),
    "token_scores": Query(
        _token_scores,
        f"{windows_sql(documents_sql(c='lower(text)'), 256)}, {_weights_sql('comment')} "
        "SELECT id, sentence_no, window_no, class_id, sum(weight) AS score FROM "
        "(SELECT id, sentence_no, window_no, unnest(toks) AS token FROM win) JOIN wt USING (token) GROUP BY ALL",
    ),
    "trained_scorer": Query(_trained, _trained_sql()),
}
