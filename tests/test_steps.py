"""Hand-made rows for each step, and laws that hold for its output on random text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postweave.functions import hangul, steps
from postweave.functions.regex import java_pattern, required_literal, required_texts
from postweave.functions.text import (
    MARK,
    collapse_tag,
    dict_replace,
    java_replacement,
    rewrite_matches,
    squeeze,
    strip,
)
from postweave.functions.unicode_fold import fold_column, jamo_restoration, map_chars
from postweave.functions.windows import sentences
from postweave.operators.normalize import normalize
from postweave.sources.rules import RuleSet, default_rules

TAGS = lambda c: steps.collapse_tags(c, ["[a]", "[b]"])
OVERLAPPING = lambda c: steps.collapse_tags(c, ["ab", "ba"])
DICTIONARY = [("ab", "1"), ("abc", "2"), ("ca", "가나"), ("bca", "3"), ("b", ""), ("cab", "4")]

GOLDEN = [
    (strip, " \t\x1c　a b\n\x1f", "a b"),
    # nicknames
    (steps.clean_nickname, "user-abc", ""),
    (steps.clean_nickname, "user-abcd", "abcd"),
    (steps.clean_nickname, "user-abcdefgh", ""),
    (steps.clean_nickname, " @user-가나 ", "가나"),
    (steps.clean_nickname, "name-x1y", "name"),
    (steps.clean_nickname, "na-me_x1", "namex1"),
    (steps.clean_nickname, "aaab", "aab"),
    (steps.clean_nickname, "가!나?다", "가나다"),
    (steps.clean_nickname, None, None),
    (steps.drop_trailing_digits, "a12b345", "a12b"),
    (steps.drop_isolated_letter, "가a나 가A양 가b컵", "가나 가A양 가b컵"),
    (steps.default_nickname, "", "[DEFAULT_NICK]"),
    (steps.default_nickname, "abc1", "[DEFAULT_NICK]"),
    (steps.default_nickname, "가나", "[DEFAULT_NICK]"),
    (steps.default_nickname, "가나다", "가나다"),
    # runs
    (steps.squeeze_long_runs, "aaaa 1000 5 000 ㅋㅋㅋㅋ", "aa 1000 5 00 ㅋㅋ"),
    (steps.squeeze_long_runs, "1aaaa\n\n\n\n", "1aaa\n\n\n\n"),
    # jamo
    (steps.close_jamo_gaps, "ㅋ ㅋ 1 ㅋ!ㅋ 가", "ㅋㅋㅋㅋ 가"),
    (steps.close_jamo_gaps, "ㅋ\x1cㅋ", "ㅋㅋ"),
    (steps.drop_ones_between_syllables, "가11나1다 1가", "가나다 1가"),
    (steps.split_laughter, "앜ㅋㅋ", "아 ㅋㅋ "),
    (steps.split_laughter, "가ㅋㅋ", "가 ㅋㅋ "),
    (steps.split_laughter, "핳ㅎ낳ㅌ앜", "하 ㅎ 낳 ㅌ 앜"),
    (steps.tidy_jamo, "ㅜ ㅜ", " ㅜ   ㅜ   ㅜ "),
    (steps.tidy_jamo, "가1나 ㄱㅏ ㅏ", "가나  가 "),
    (hangul.compose, "ㄱㅏㅂㅅㅣ ㄱㅏㅂㅅ ㄱㅗㅏ", "갑시 값 과"),
    (hangul.decompose, "값 과 a", "ㄱㅏㅄ ㄱㅘ a"),
    # marks, vowels, crying
    (steps.sort_marks, "wow!!??", "wow?!"),
    (steps.sort_marks, "ok.,", "ok.."),
    (steps.sort_marks, "ok~~,!", "ok..!"),
    (steps.shorten_vowels, "가아아아 가아", "가 가아"),
    (steps.shorten_vowels, "기이이 고오오 구우우", "기 고오오 구우우"),
    (steps.unify_crying, "후쿠쿠", "ㅎㅠㅠ"),
    (steps.unify_crying, "푸쿠", "ㅠㅠ"),
    (steps.unify_crying, "쿠쿠", "ㅋㅠㅠ"),
    (steps.drop_i_between_syllables, "가ㅣ나다ㅣ라 가ㅣㅣ나", "가나다라 가ㅣㅣ나"),
    (steps.laugh_z, "zzz z", "ㅋㅋ z"),
    # spacing
    (steps.tidy_marks, "3.14 , a .b", "3.14, a. b"),
    (steps.tidy_marks, "1,000.5 ?! x", "1,000.5?! x"),
    (steps.join_spaced_letters, "안 녕 하 세요 (b)", "안녕하 세요 (b)"),
    (steps.join_spaced_letters, "a b c de", "abc de"),
    (steps.join_spaced_letters, "ท น", "ทน"),
    # tags
    (lambda c: collapse_tag(c, "[num]"), "[num] [num] x", "[num]x"),
    (TAGS, "[a] [a][b] [b] x [a]", "[a][b]x [a]"),
    (OVERLAPPING, "ab a b", "abab"),
    (steps.upper_tags, "hi [text_emoji] [a1] [x]", "hi [TEXT_EMOJI] [a1] [X]"),
    (steps.upper_tags, f"[x]{MARK}[y]", f"[X]{MARK}[Y]"),
    # characters: words as Python sees them, without marks and with all numbers
    (steps.keep_known_chars, None, "[EMPTY]"),
    (steps.keep_known_chars, "[[a]]☆ 가ㅋ", "[a] 가ㅋ"),
    (steps.keep_known_chars, "ที่นี่", "ทน"),
    (steps.keep_known_chars, "हिन्दी", "हनद"),
    (steps.keep_known_chars, "a❶b", "a❶b"),
    (steps.keep_known_chars, "a‿b", "ab"),
    (steps.keep_known_chars, "a\x1cb", "a\x1cb"),
    # dictionaries
    (lambda c: dict_replace(c, DICTIONARY), "abcab", "1가나"),
    (lambda c: dict_replace(c, DICTIONARY), f"xb{MARK}ab", f"x{MARK}1"),
    (lambda c: map_chars(c, {"a": "", "b": "X", "c": "YZ"}), "ab1c", "X1YZ"),
    (lambda c: map_chars(c, {"a": "", "b": "X"}), "abc", "Xc"),
    (lambda c: map_chars(c, {}), "abc", "abc"),
]


def test_golden_rows(spark):
    row = spark.range(1).select(
        *[fn(F.lit(text).cast("string")).alias(f"g{i}") for i, (fn, text, _) in enumerate(GOLDEN)]
    ).first()
    wrong = [(text, row[i], want) for i, (_, text, want) in enumerate(GOLDEN) if row[i] != want]
    assert not wrong


def texts(alphabet, seed=1, n=800, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


# step, characters to draw from, what must not be left
LEFT_OUT = [
    ("gaps", steps.close_jamo_gaps, "ㅋㅎㅏ가1 !?", r"[ㄱ-ㅎㅏ-ㅣ][\s0-9?!]+[ㄱ-ㅎㅏ-ㅣ]"),
    ("ones", steps.drop_ones_between_syllables, "가나1 ", "[가-힣]1+[가-힣]"),
    ("laughter", steps.split_laughter, "앜핳닽가ㅋㅎㅌㅊ a", "[가-힣][ㅋㅎㅌㅊ]"),
    ("jamo", steps.tidy_jamo, "ㅜㅣㅋㅎㄱㅏ가앜값 1!?a", "[ㅏㅐㅑㅓㅣ]"),
    ("marks", steps.sort_marks, "~.,?!a", r"!!|\?\?|~~|\.{3}|!\?|,\.|[?!][.,~]"),
    ("crying", steps.unify_crying, "후휴푸퓨쿠큐ㅜㅠa", "[쿠큐푸퓨후휴][쿠큐푸퓨ㅜㅠ]"),
    ("drop_i", steps.drop_i_between_syllables, "가나ㅣ ", "[가-힣]ㅣ[가-힣]"),
    ("known", steps.keep_known_chars, "[]a☆가ㅋ1 ~\n_éท่❶‿", r"[☆่‿]|^\s|\s$"),
    ("runs", steps.squeeze_long_runs, "aa1ㅋ!", r"(?<!\d)(\D)(?<!\d.)\1\1\1"),
    ("tidy", steps.tidy_marks, "1a.,!? ^\n", r"\s\s"),
    ("upper", steps.upper_tags, ["[", "]", "a", "_", "1", "[b]"], r"\[[A-Z_]*[a-z][a-zA-Z_]*\]"),
    ("z", steps.laugh_z, "zza ", "zz"),
]


@pytest.mark.parametrize("name, step, alphabet, never", LEFT_OUT, ids=[c[0] for c in LEFT_OUT])
def test_what_a_step_leaves_no_more(apply, name, step, alphabet, never):
    values = texts(alphabet)
    wrong = [(v, g) for v, g in zip(values, apply(step, values)) if re.search(never, g)]
    assert not wrong, wrong[:5]


SETTLES = {
    "marks": (steps.sort_marks, "~.,?!a"),
    "squeeze": (lambda c: squeeze(c), "aa1ㅋ!~ "),
    "tag": (lambda c: collapse_tag(c, "[a]"), ["[a]", " ", "x"]),
    "gaps": (steps.close_jamo_gaps, "ㅋㅎ가1 !"),
    "ones": (steps.drop_ones_between_syllables, "가나1"),
    "laughter": (steps.split_laughter, "앜가ㅋㅎa "),
    "crying": (steps.unify_crying, "후푸쿠ㅜㅠa"),
    "tidy": (steps.tidy_marks, "1a.,!? ^"),
    "upper": (steps.upper_tags, "[]ab_"),
    "compose": (hangul.compose, "ㄱㅅㅏㅗ가값 "),
    "nickname": (steps.default_nickname, "a1-가나다"),
}


@pytest.mark.parametrize("name", SETTLES)
def test_a_second_time_changes_nothing(apply, name):
    step, alphabet = SETTLES[name]
    once = apply(step, texts(alphabet, n=500))
    assert apply(step, once) == once


# What a step may not touch: the text without these is the same before and after.
KEEPS = {
    "gaps": (steps.close_jamo_gaps, "ㅋㅎ가a1 !", r"[\s0-9?!]"),
    "laughter": (steps.split_laughter, "가나ㅋㅎa ", " "),
    "marks": (steps.sort_marks, "~.,?!ab ", "[~.,?!]"),
    "tidy": (steps.tidy_marks, "1a.,!? ^", r"\s"),
    "spaced": (lambda c: steps.join_spaced_letters(strip(c)), "ab가나 ()", r"\s"),
    "tags": (TAGS, ["[a]", "[b]", " ", "x"], r"\[[ab]\]|\s"),
}


@pytest.mark.parametrize("name", KEEPS)
def test_a_step_keeps_the_rest(apply, name):
    step, alphabet, free = KEEPS[name]
    values = texts(alphabet, n=500)
    assert [re.sub(free, "", g) for g in apply(step, values)] == [re.sub(free, "", v) for v in values]


def test_compose_undoes_decompose(apply):
    values = texts("가나값뷁힣 a", longest=10)
    assert apply(lambda c: hangul.compose(hangul.decompose(c)), values) == values


def test_a_dictionary_is_one_alternation(apply):
    """Python's own engine says what leftmost and first-in-order give."""
    values = texts(f"abcd{MARK}")
    table = dict(DICTIONARY)
    pattern = re.compile("|".join(map(re.escape, table)))
    want = [pattern.sub(lambda m: table[m[0]], v) for v in values]
    assert apply(lambda c: dict_replace(c, DICTIONARY), values) == want


def test_rewrites_of_texts_with_and_without_the_mark(apply):
    values = texts(f"ab1{MARK}", n=600)
    got = apply(lambda c: rewrite_matches(c, "[ab]+", lambda m: F.concat(F.lit("<"), F.reverse(m), F.lit(">"))), values)
    assert got == [re.sub("[ab]+", lambda m: f"<{m[0][::-1]}>", v) for v in values]
    whole = apply(lambda c: F.array_join(sentences(c), "|"), ["a. b!? c", f"a.{MARK} b", "", "."])
    assert whole == ["a.|b!?|c", f"a.|{MARK} b", "", ".|"]


RULE_PATTERNS = [
    r"\w+", r"\W", r"\d+", r"\s+", r"\S+", r"\bก", r"a\b", r"\Ba", r"[\w.]+", r"[^\w\s]", r"[^\W\d]+", r"[\W_]+", r"[a\S]",
    r"(?P<x>a)(?P=x)", r"(?P<a_b>.)1(?P=a_b)", r"[^[]", r"a{,2}b", r"[a&&b]", r"[]a]+", r"b\Z", r"a{b", r"x{}", r"(?i)É",
    r"(?#no)a", r"\x1c", r"น", r"[\x1c-\x1f]", r"a|^b", r".\Z", r"(?s).b", r"\N{LATIN SMALL LETTER A}", r"(?:a(?i:B))",
    r"\b1", r"\ba1?", r"\w\b", r"1\b", r"\d{1,2}\b", r"\b\d+\b", r"\ba?1", r"\b\w{,1}é", r"[ab]+\.", r"é\[+1?", r"\\d\b",
    r"(?<=\w)1", r"[b^]", r"\v", r"\.", r"(a)(b)?\1",
]


def test_rule_patterns_mean_what_python_means(spark):
    values = [*texts("ab1_ .กที่ด❶‿\x1c\né[É&{}x\x0b", n=400, longest=8), "नहीं ⅷ ²", "aXbB aaab", "\x85\xa0　"]
    rows = spark.createDataFrame(list(enumerate(values)), "i INT, c STRING").repartition(2)
    out = rows.select("i", *[F.regexp_replace("c", java_pattern(p), "<>").alias(f"p{k}") for k, p in enumerate(RULE_PATTERNS)])
    wrong = []
    for r in out.collect():
        for k, p in enumerate(RULE_PATTERNS):
            want = re.sub(p, "<>", values[r["i"]])
            if r[f"p{k}"] != want:
                wrong.append((p, values[r["i"]], r[f"p{k}"], want))
    assert not wrong, wrong[:6]


@pytest.mark.parametrize(
    "pattern, held",
    [
        (r"https?://\S+", "://"), (r"[a-z]+@[a-z-]+", "@"), (r"\d{4}-\d{2}", "-"), (r"\d[\d,]*\s*원", "원"), ("a*", None),
        ("(ab)c?", None), ("a|b", None), (r"a\.b", "a.b"), ("x{0,2}y", "y"), ("(?i)abc", None), (r"[]a]+#", "#"), ("a+b", "a"),
    ],
)
def test_what_every_match_holds(pattern, held):
    found = required_literal(pattern)
    assert found == held
    for text in texts("ab1@-:/.원xy#", n=300):
        assert held is None or not re.search(pattern, text) or held in text


@pytest.mark.parametrize("pattern", ["(a)?(?(1)b|c)", "(?L)a", "[a", "a\\"])
def test_patterns_java_cannot_say_are_refused(pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


CHAIN_GOLDEN = [
    ("갠춘해 ㅋ ㅋ", "괜찮아 ㅋㅋ"),
    ("Hello!!?? :)", "hello?! [TEXT_EMOJI]"),
    ("zzzz", "ㅋㅋ"),
    ("3.14 a", "[FLOAT]a"),
    ("ＡＢ　①", "ab 1"),
    ("2024-01-02", "[DATE]"),
    ("漢字*", ""),
    (None, "[EMPTY]"),
]


def test_the_chain_by_hand(spark):
    rules = RuleSet.collect(default_rules(spark))
    rows = [(i, "user-가나다", text) for i, (text, _) in enumerate(CHAIN_GOLDEN)]
    done = normalize(spark.createDataFrame(rows, "id INT, nickname STRING, comment STRING"), rules)
    got = {r["id"]: r["comment"] for r in done.collect()}
    assert [got[i] for i in range(len(CHAIN_GOLDEN))] == [want for _, want in CHAIN_GOLDEN]


CHAIN_PARTS = [
    "갠춘해", "조아욤", "ㅋ", " ", "  ", "ㅠㅠ", "1", "1000", "가ㅣ나", "앜ㅋㅋ", "아아아", "후쿠쿠", "!!??", ".,", "~",
    "zzz", "3.14", ":)", "🎉", "[num]", "①ｅ", "é", "ㄱㅏㅇ", "a", "b", "the", "漢", "https://a.b/c ", "한국", "…", "*",
    "\n", "2024-01-02", "1,000원", "안녕  하세요", "ㄱ ㅅ", "ㄳ", "​", "ß", "(", ")", "&", "haha", "#tag", "ท่",
]


def test_the_chain_keeps_its_laws(spark):
    rules = RuleSet.collect(default_rules(spark))
    values = texts(CHAIN_PARTS, n=2000, longest=12)
    rows = [(i, "이름", text) for i, text in enumerate(values)]
    df = spark.createDataFrame(rows, "id INT, nickname STRING, comment STRING").repartition(4)
    never = re.compile(r"[漢*☆​①🎉]|zz|갠춘해|조아욤|\[[a-z_]+\]|[가-힣]1[가-힣]|\s\s\s|[?!]{2}[?!]|…|[A-Z](?![A-Z_]*\])")
    for r in normalize(df, rules).collect():
        assert not never.search(r["comment"]), (values[r["id"]], r["comment"])
        assert r["nickname"] == "[DEFAULT_NICK]"


def test_folding_only_some_rows_is_folding_all(spark):
    import unicodedata

    table = jamo_restoration()
    values = texts("ㄱㅋㅏㅣㄳ가각①ｅéß́ᄀa ", n=2000, longest=8)
    df = spark.createDataFrame(list(enumerate(values)), "i INT, c STRING").withColumn(
        "before", hangul.compose(F.col("c"))
    )
    for r in fold_column(df.withColumn("out", F.col("before")), "out", table).collect():
        folded = unicodedata.normalize("NFKC", r["before"])
        want = "".join(table.get(ch, ch) for ch in folded if not unicodedata.combining(ch))
        assert r["out"] == want, r


def test_long_runs_do_not_exhaust_the_stack(apply):
    # Runs that recursive matching would not survive.
    n = 50_000
    assert apply(lambda c: collapse_tag(c, "[a]"), ["[a] " * n]) == ["[a]"]
    assert apply(TAGS, ["[a] " * n]) == ["[a]"]
    assert apply(steps.tidy_jamo, ["ㅜ " * n])[0].split() == ["ㅜ", "ㅜ", "ㅜ"]
    assert apply(steps.tidy_marks, [" " * n + "a"]) == [" a"]
    assert apply(steps.join_spaced_letters, ["a b " * n])[0] == "ab" * n


def test_many_keys_cost_about_what_few_do(spark):
    import time

    def seconds(n: int) -> float:
        pairs = [(f"key{i:05d}x", f"v{i}") for i in range(n)]
        rows = spark.range(0, 20_000, 1, 4).select(
            F.concat(F.lit("some key"), F.lpad((F.col("id") % n).cast("string"), 5, "0"), F.lit("x text key00001x")).alias("c")
        )
        df = rows.select(dict_replace(F.col("c"), pairs).alias("c"))
        best = []
        for _ in range(3):
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        return min(best)

    assert seconds(5_000) <= 2 * seconds(100) + 1.5


def test_replacement_templates():
    assert java_replacement(r"\1x\g<2>0$\\") == "$1x$2\\0\\$\\\\"


@pytest.mark.parametrize(
    "step",
    [
        hangul.compose, steps.unify_spaces, steps.close_jamo_gaps, steps.drop_ones_between_syllables, steps.split_laughter,
        steps.space_jamo, steps.drop_lone_vowels, steps.unify_crying, steps.laugh_z, steps.upper_tags,
        steps.drop_i_between_syllables, lambda c: steps.unify_letters(c, [("[ɑⲁ]+", "a")]),
    ],
)
def test_patterns_run_only_where_a_text_holds_their_characters(spark, step):
    rows = spark.createDataFrame([("x",)], "c STRING").select(step(F.col("c")).alias("c"))
    plan = rows._jdf.queryExecution().analyzed().toString().lower()
    assert "contains(" in plan


def test_required_texts():
    assert required_texts("[ɑⲁ]+") == ["ɑ", "ⲁ"]
    assert required_texts("(?:[❤💕])+") == ["❤", "💕"]
    assert required_texts("ab|cd+") == ["ab", "cd"]
    assert sorted(required_texts("(?i)(?:하하{2,}|ab)+")) == ["AB", "Ab", "aB", "ab", "하"]
    for unsure in ("a|b*", "a|", "[^ab]", "[a-c]", "[ab]?", "(?i)ask", "(ab)+", "[0-9]+(?:kg|km)"):
        assert required_texts(unsure) is None


def test_many_rules_with_their_own_characters_are_resolved(spark):
    """Each step is resolved by itself: the rounds of the analyzer do not add up over the chain."""
    rules = RuleSet(
        monde=[(f"m{i}x", f"n{i}") for i in range(12)], sentence=[(f"s{i}x", f"t{i}") for i in range(12)],
        special=[(f"p{i}x", f"q{i}") for i in range(24)], base=[(f"b{i}x", f"c{i}") for i in range(24)],
    )
    rows = spark.createDataFrame([(1, "m7x s11x p9x b0x")], "id LONG, comment STRING")
    assert normalize(rows, rules, nickname=None).first()["comment"] == "n7 t11 q9 c0"


def test_chunks_are_joined_as_one_chunk_after_the_other(apply):
    """Held against the chain of matches that each start where the last one ended."""
    values = [v.strip() for v in texts("ab가 \n!.,@❤&#ㅣ(", n=3000, longest=12)]

    def walked(c):
        c = F.regexp_replace(c, r"([(\[{)\]}])", " $1")
        chunk = java_pattern(rf"\G\s*+({steps._IN_CHUNK}(?:{steps._AFTER_CHUNK}*[!?@.,❤])?)\s*+")
        c = F.rtrim(F.regexp_replace(F.regexp_replace(c, steps._SPACED, "$1$2"), chunk, "$1 "))
        return F.regexp_replace(c, r"([(\[{]) | ([)\]}])", "$1$2")

    assert apply(steps.join_spaced_letters, values) == apply(walked, values)
