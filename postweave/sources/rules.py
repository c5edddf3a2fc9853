"""Rule tables.

A rule file becomes one flat table ``(group, ord, key, pattern, replacement)``.
Rules are configuration: ``RuleSet.collect`` brings them to the driver and turns
them into literal patterns of the plan.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweave.functions.text import JAVA_FLAGS, char_class, key_pattern, strip
from postweave.functions.unicode_fold import jamo_restoration
from postweave.session import literal_rows

DATA = Path(__file__).resolve().parent.parent / "data"
RULE_SCHEMA = "`group` STRING, ord INT, `key` STRING, pattern STRING, replacement STRING"

RULE_FILE_SCHEMA = """
    incorrect STRUCT<
        char: MAP<STRING, STRING>, word: MAP<STRING, STRING>,
        sentence: ARRAY<ARRAY<STRING>>, monde: ARRAY<ARRAY<STRING>>,
        sentence_eval: ARRAY<ARRAY<STRING>>>,
    structed STRUCT<base: MAP<STRING, ARRAY<STRING>>, extern: MAP<STRING, ARRAY<STRING>>>,
    single STRUCT<ko: MAP<STRING, STRING>, en: MAP<STRING, STRING>>,
    punct MAP<STRING, STRING>,
    emoji STRUCT<unicode: MAP<STRING, STRING>, text: MAP<STRING, ARRAY<STRING>>>,
    special_token ARRAY<ARRAY<STRING>>
"""

Pairs = list[tuple[str, str]]


def _rule(group: str, ord_: Column, key: Column, pattern: Column, replacement: Column) -> Column:
    return F.struct(
        F.lit(group).alias("group"),
        ord_.cast("int").alias("ord"),
        key.alias("key"),
        pattern.alias("pattern"),
        replacement.alias("replacement"),
    )


def _from_map(group: str, source: str, pattern, replacement) -> Column:
    return F.transform(
        F.map_entries(source),
        lambda e, i: _rule(group, i, e["key"], pattern(e), replacement(e)),
    )


def _from_pairs(group: str, source: str) -> Column:
    return F.transform(
        F.col(source), lambda pair, i: _rule(group, i, pair[0], pair[0], pair[1])
    )


def _from_lists(group: str, source: str) -> Column:
    # (tag -> ordered regexes): numbered through in tag order, then list order.
    flat = F.flatten(
        F.transform(
            F.map_entries(source),
            lambda e: F.transform(
                e["value"], lambda regex: F.struct(e["key"].alias("tag"), regex.alias("regex"))
            ),
        )
    )
    return F.transform(flat, lambda x, i: _rule(group, i, x["tag"], x["regex"], x["tag"]))


def flatten_rules(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Parsed rule files to the flat table, in one pass over them."""
    key, value = (lambda e: e["key"]), (lambda e: e["value"])
    emoji_class = lambda e: F.concat(
        F.lit("(?:["),
        F.regexp_replace(e["value"], r"([\[\]\\^&~|-])", r"\\$1"),
        F.lit("])+"),
    )
    emoji_words = lambda e: F.concat(
        F.lit("(?i)(?:"), F.array_join(e["value"], "|"), F.lit(")+")
    )
    groups = [
        _from_map("char", "incorrect.char", key, value),
        _from_map("word", "incorrect.word", key, value),
        _from_pairs("monde", "incorrect.monde"),
        _from_pairs("sentence", "incorrect.sentence"),
        _from_pairs("sentence_fn", "incorrect.sentence_eval"),
        _from_map("single_ko", "single.ko", key, value),
        _from_map("single_en", "single.en", value, key),
        _from_map("punct", "punct", value, key),
        _from_pairs("special", "special_token"),
        _from_map("emoji_set", "emoji.unicode", emoji_class, key),
        _from_map("emoji_text", "emoji.text", emoji_words, key),
        _from_lists("base", "structed.base"),
        _from_lists("extern", "structed.extern"),
    ]
    none = F.array().cast(
        "array<struct<group:string,ord:int,key:string,pattern:string,replacement:string>>"
    )
    rules = F.explode(F.concat(*[F.coalesce(g, none) for g in groups])).alias("rule")
    keep = keep or []
    return files.select(*keep, rules).select(*keep, "rule.*")


def load_rules(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested rule JSON to the flat rule table."""
    files = spark.read.schema(RULE_FILE_SCHEMA).option("multiLine", multi_line).json(path)
    return flatten_rules(files)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and their number in it.

    Files are read in splits.  A line's place is its split's start and its place in the
    split, which is the order Spark reads it in.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
    )
    within = Window.partitionBy("file", "split").orderBy("place")
    numbered = lines.withColumn("nth", F.row_number().over(within) - 1)
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = numbered.join(splits, ["file", "split"]).select(
        "file", (F.col("before") + F.col("nth")).cast("int").alias("ord"), strip(F.col("line")).alias("line")
    )
    return placed.where(F.length("line") > 0)


def _numbered_lines(files: DataFrame) -> DataFrame:
    numbered = files.select(F.posexplode(F.split("value", r"\r?\n", -1)).alias("ord", "line"))
    return numbered.withColumn("line", strip(F.col("line"))).where(F.length("line") > 0)


def load_faces(spark: SparkSession, path: str, with_file: bool = False) -> DataFrame:
    """Text faces, one per line, as ``face`` rules; lower-case like the text they
    are looked up in.  ``ord`` is the line's number in its file; ``with_file`` names it."""
    return _faces(_lines(spark, path), ["file"] if with_file else [])


def _faces(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return lines.select(
        *(keep or []),
        F.lit("face").alias("group"),
        "ord",
        F.col("line").alias("key"),
        F.lower("line").alias("pattern"),
        F.lit("[TEXT_EMOJI]").alias("replacement"),
    )


def load_pairs(
    spark: SparkSession, path: str, group: str = "word", with_file: bool = False
) -> DataFrame:
    """``from -> to`` lines as dictionary rules, numbered as in ``load_faces``."""
    return _pairs(_lines(spark, path), group, ["file"] if with_file else [])


def _pairs(lines: DataFrame, group: str, keep: list[str] | None = None) -> DataFrame:
    pair = F.split("line", r"\s+->\s+", 2)
    return lines.where(F.col("line").contains(" -> ")).select(
        *(keep or []),
        F.lit(group).alias("group"),
        "ord",
        pair[0].alias("key"),
        pair[0].alias("pattern"),
        pair[1].alias("replacement"),
    )


def load_tags(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Special-token vocabulary as ``tag`` rules."""
    files = (
        spark.read.schema("additional_special_tokens ARRAY<STRING>")
        .option("multiLine", multi_line)
        .json(path)
    )
    return _tags(files)


def _tags(files: DataFrame) -> DataFrame:
    return files.select(F.posexplode("additional_special_tokens").alias("ord", "tag")).select(
        F.lit("tag").alias("group"),
        "ord",
        F.col("tag").alias("key"),
        F.col("tag").alias("pattern"),
        F.col("tag").alias("replacement"),
    )


def cheap_emoji_set(pattern: str) -> str:
    """An ``emoji_set`` pattern of ``flatten_rules`` with its many characters as ranges."""
    if not (pattern.startswith("(?:[") and pattern.endswith("])+")):
        return pattern
    chars = re.sub(r"\\(.)", r"\1", pattern[4:-3], flags=re.S)
    return f"(?:{char_class(chars)})+" if chars else pattern


@dataclass(frozen=True)
class RuleSet:
    """Rules by group, in order: what the steps take."""

    char: Pairs = field(default_factory=list)
    word: Pairs = field(default_factory=list)
    monde: Pairs = field(default_factory=list)
    sentence: Pairs = field(default_factory=list)
    sentence_fn: Pairs = field(default_factory=list)
    single_ko: Pairs = field(default_factory=list)
    single_en: Pairs = field(default_factory=list)
    punct: Pairs = field(default_factory=list)
    special: Pairs = field(default_factory=list)
    emoji_set: Pairs = field(default_factory=list)
    emoji_text: Pairs = field(default_factory=list)
    base: Pairs = field(default_factory=list)
    extern: Pairs = field(default_factory=list)
    face: Pairs = field(default_factory=list)
    tag: Pairs = field(default_factory=list)

    @classmethod
    def collect(cls, rules: "DataFrame | RuleSet") -> "RuleSet":
        """A rule table as a rule set.

        Rules end up as literals of the plan: a rule file is configuration, whose
        size does not grow with the posts.
        """
        if isinstance(rules, RuleSet):
            return rules
        rows = rules.collect()
        groups: dict[str, Pairs] = {}
        for row in sorted(rows, key=lambda r: (r["group"], r["ord"])):
            pattern = row["pattern"]
            if row["group"] == "emoji_set":
                pattern = cheap_emoji_set(pattern)
            groups.setdefault(row["group"], []).append((pattern, row["replacement"]))
        unknown = set(groups) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown rule groups: {sorted(unknown)}")
        return cls(**groups)

    def adding(self, **groups: Pairs) -> "RuleSet":
        """This set with rules appended to some groups."""
        return replace(self, **{name: [*getattr(self, name), *new] for name, new in groups.items()})

    @property
    def tags(self) -> list[str]:
        return [tag for tag, _ in self.tag]

    @cached_property
    def face_pattern(self) -> str | None:
        """All faces as one pattern: leftmost, first in order."""
        alternatives = key_pattern(face for face, _ in self.face)
        return JAVA_FLAGS + alternatives if alternatives else None


def restoring_jamo(spark: SparkSession) -> DataFrame:
    """The ``single_ko`` rules every chain needs after compatibility folding."""
    rows = [
        ("single_ko", i, old, old, new) for i, (old, new) in enumerate(jamo_restoration().items())
    ]
    return literal_rows(spark, RULE_SCHEMA, rows)


def default_rules(spark: SparkSession) -> DataFrame:
    """The small rule set shipped with the package.

    Package files are on the driver only, so they are parsed from their text.
    """

    def text_of(name: str) -> DataFrame:
        text = (DATA / name).read_text(encoding="utf-8")
        return literal_rows(spark, "value STRING", [(text,)])

    def parsed(name: str, schema: str) -> DataFrame:
        return text_of(name).select(F.from_json("value", schema).alias("file")).select("file.*")

    after_file = F.col("ord") + 1000
    return (
        flatten_rules(parsed("rules.json", RULE_FILE_SCHEMA))
        .unionByName(restoring_jamo(spark))
        .unionByName(
            _pairs(_numbered_lines(text_of("pairs.txt")), "word").withColumn("ord", after_file)
        )
        .unionByName(_faces(_numbered_lines(text_of("faces.txt"))))
        .unionByName(_tags(parsed("tags.json", "additional_special_tokens ARRAY<STRING>")))
    )


def rules_json(rules: dict) -> str:
    """A rule dictionary as the JSON ``load_rules`` reads."""
    return json.dumps(rules, ensure_ascii=False)
