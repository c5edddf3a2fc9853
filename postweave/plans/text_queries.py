"""One query per text step, on the decorated corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postweave.functions import hangul, steps
from postweave.functions.hangul import FINALS, INITIALS, VOWELS, open_syllables
from postweave.functions.text import (
    collapse_tag,
    dict_replace,
    regex_chain,
    register_rewrite,
    rewrite_matches,
    rewrite_named,
    sort_chars,
    squeeze,
    strip,
)
from postweave.operators.normalize import nickname_chain, normalize
from postweave.plans.corpus import (
    POSTS_SQL,
    choose,
    decorated,
    documents,
    documents_sql,
    posts,
)
from postweave.plans.registry import Query
from postweave.functions.unicode_fold import jamo_restoration
from postweave.sources.rules import RuleSet, default_rules

# --- SQL helpers: RE2 has no look-around and no back-references ---------------


def rr(c: str, *rules: tuple[str, str]) -> str:
    """Chain of global regular-expression replaces."""
    for pattern, replacement in rules:
        pattern, replacement = (x.replace("'", "''") for x in (pattern, replacement))
        c = f"regexp_replace({c}, '{pattern}', '{replacement}', 'g')"
    return c


def rewrite_sql(c: str, pattern: str, new: str) -> str:
    """Replace matches (called ``x``) by an expression, all else kept."""
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '{pattern}|(?s:.)'), "
        f"lambda x: CASE WHEN regexp_full_match(x, '{pattern}') THEN {new} ELSE x END), '')"
    )


def dict_sql(c: str, pairs: Sequence[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs)
    keys = "|".join(a for a, _ in pairs)
    return rewrite_sql(c, f"(?:{keys})", f"CASE x {cases} END")


# Every character that occurs in runs in the corpus.
RUN_CHARS = (
    "abcdefghijklmnopqrstuvwxyz0123456789éèêëàâçñóòôöõüùúûäáíìîïßœæ"
    "가나다라마바사아자차카타파하ㅋㅎㅠㅜㅣㅏㅓ~!?.,;:=+_/<>'\"-|*#@&%$^()[]{} "
)


def squeeze_sql(c: str, min_run: int, chars: str = RUN_CHARS, guarded: bool = True) -> str:
    """Runs of ``min_run`` or more become two, unless right after a digit."""
    before = "(^|[^0-9])" if guarded else "()"
    for ch in chars:
        one = "\\" + ch if ch.isascii() and not ch.isalnum() and ch not in "\n _" else ch
        c = rr(c, (f"{before}{one}{{{min_run},}}", f"\\1{ch * 2}"))
    return c


def repeat_count_sql(c: str, order: str) -> str:
    return " || ".join(f"repeat('{ch}', length({c}) - length(replace({c}, '{ch}', '')))" for ch in order)


J = "[ㄱ-ㅎㅏ-ㅣ]"
S = "[가-힣]"
WORD = r"\p{L}\p{M}\p{N}_"


def compose_sql(c: str) -> str:
    """Initial + vowel first, marked; then a consonant left behind a marked one."""
    marked = rewrite_sql(
        c,
        f"[{INITIALS}][{VOWELS}]",
        f"chr(1) || chr((44032 + ((instr('{INITIALS}', x[1]) - 1) * 21 + unicode(x[2]) - 12623) * 28)::INTEGER)",
    )
    closed = rewrite_sql(
        marked,
        f"\\x01{S}[{FINALS}]",
        f"chr((unicode(x[2]) + instr('{FINALS}', x[3]))::INTEGER)",
    )
    return f"replace({closed}, chr(1), '')"


def laughter_sql(c: str) -> str:
    final = "((unicode(x[1]) - 44032) % 28)"
    return rewrite_sql(
        c,
        f"{S}[ㅋㅎㅌㅊ]+",
        f"CASE WHEN {final} = instr('{FINALS}', x[2]) THEN chr(unicode(x[1]) - {final}) "
        f"ELSE x[1] END || ' ' || x[2:] || ' '",
    )


def marks_sql(c: str) -> str:
    ordered = "(" + repeat_count_sql("x", "~.,?!") + ")"
    tidy = rr(ordered, (".+,+", ".."), (",{2,}", ".."), (r"\.{2,}", ".."), (r"\?{2,}", "?"), ("!{2,}", "!"), ("~{2,}", "~"))
    return rewrite_sql(c, "[~.,?!]{2,}", tidy)


def nickname_sql(c: str) -> str:
    c = rr(f"trim({c})", ("^@", ""), (r"[^a-zA-Z가-힣0-9\-._]+", ""))
    c = (
        f"(SELECT CASE WHEN regexp_matches(u, '^user-[a-z0-9]+$') "
        f"AND ((length(u) - 5) % 2 = 1 OR length(u) - 5 > 7) THEN '' ELSE u END FROM (SELECT {c} AS u))"
    )
    c = rr(c, (r"^user-([a-zA-Z0-9가-힣\-._]+)$", r"\1"), (r"[\-_][a-zA-Z0-9]{3,}$", ""))
    c = squeeze_sql(c, 3, "abcdefghijklmnopqrstuvwxyz0123456789가나다._-", guarded=False)
    return rr(c, ("[^a-zA-Z가-힣0-9]+", ""))


def default_nickname_sql(c: str) -> str:
    return (
        f"CASE WHEN length({c}) = 0 OR regexp_matches({c}, '^[a-zA-Z0-9\\-_.]+$') "
        f"OR (regexp_matches({c}, '{S}') AND length({c}) < 3) THEN '[DEFAULT_NICK]' ELSE {c} END"
    )


NOT_SIZE = r"[가-\x{C590}\x{C592}-\x{CEF4}\x{CEF6}-힣]"


def isolated_letter_sql(c: str) -> str:
    return rr(c, *[(f"({S})[a-zA-Z]({NOT_SIZE})", r"\1\2")] * 2)


def tidy_marks_sql(c: str) -> str:
    return rr(
        c,
        *[(r"([0-9])\.([0-9])", r"\1[POINT_DOT]\2")] * 2,
        *[(r"([0-9]),([0-9])", r"\1[POINT_COM]\2")] * 2,
        (r"\s*([.,?!^]+)\s*", r"\1 "),
        (r"\s{2,}", " "),
        (r"\[POINT_DOT\]", "."),
        (r"\[POINT_COM\]", ","),
    )


KEPT = rf"[^{WORD}가-힣ㄱ-ㅎㅏ-ㅣ!?%&^()\[\]{{}}\-+=~,./<>;:'\"\s]+"


def known_chars_sql(c: str) -> str:
    c = rr(c, (r"\[+", "["), (r"\]+", "]"), (KEPT, ""))
    allowed = [ch for ch in RUN_CHARS if (ch.isascii() and ch.isalpha()) or "ㄱ" <= ch <= "힣" or ch in "!?%^()[]{}-_+=~,./<>;:'\" "]
    c = squeeze_sql(c, 4, "".join(allowed) + "\n")
    stripped = rr(c, (r"\A\s+|\s+\z", ""))
    return f"coalesce({stripped}, '[EMPTY]')"


# --- rules used by the queries, in both spellings ---------------------------------

WORDS = [("갠춘해", "괜찮아"), ("조아욤", "좋아요"), ("방가욥", "반가워요"), ("욥", "요")]
CHARS = [("뎈", "데"), ("욬", "요")]
RULES = RuleSet(
    word=WORDS,
    char=CHARS,
    monde=[("먼데", "뭔데"), ("몬데", "뭔데")],
    sentence=[(r"(안녕)\s+(하세요)", r"\1\2")],
    sentence_fn=[(r"ㄱ\s+ㅅ", "drop_spaces")],
    single_en=[("[ɑⲁ]+", "a"), ("[οо]+", "o")],
    punct=[("…+", "..."), ("[！❗]", "!"), ("[？❓]", "?")],
    special=[(r"https?://[^\s]+", "[URL]"), (r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", "[EMAIL]")],
    emoji_set=[("(?:[❤💕])+", "[HEART]"), ("(?:[🎉🎊])+", "[PARTY]")],
    emoji_text=[("(?i)(?:하하{2,}|haha+)+", "[SMILE]")],
    base=[(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "[DATE]"), (r"[0-9]{1,2}:[0-9]{2}", "[TIME]"), (r"[0-9][0-9,]*\s*원", "[COST]")],
    extern=[(r"[0-9]+(?:kg|km|cm)", "[UNIT]"), (r"[0-9]+\.[0-9]+", "[FLOAT]")],
    face=[(":-)", "[TEXT_EMOJI]"), (":)", "[TEXT_EMOJI]"), ("^_^", "[TEXT_EMOJI]")],
    tag=[("[num]", "[num]"), ("[x]", "[x]")],
)


def words_sql(c: str) -> str:
    c = rr(dict_sql(dict_sql(c, WORDS), CHARS), *RULES.monde, *RULES.sentence)
    return rewrite_sql(c, r"ㄱ\s+ㅅ", "replace(x, ' ', '')")


def symbols_sql(c: str) -> str:
    faces = (r":-\)|:\)|\^_\^", "[TEXT_EMOJI]")
    return rr(c, *RULES.special, faces, *RULES.emoji_set, *RULES.emoji_text)


def tidy_jamo_sql(c: str) -> str:
    c = rr(c, (r"(?:[ㅜㅣ]\s+)+[ㅜㅣ]", "TEMP_U"), *[(rf"({J})[\s0-9?!]+({J})", r"\1\2")] * 2)
    c = rr(c, *[(f"({S})1+({S})", r"\1\2")] * 2)
    c = rr(laughter_sql(f"replace({c}, 'TEMP_U', 'ㅜ ㅜ ㅜ')"), (f"({J}+)", r" \1 "))
    return rr(compose_sql(c), (f"[{steps.LONE_VOWELS}]+", ""))


def vowels_sql(c: str) -> str:
    return rr(c, *[(f"([{open_syllables(v)}])[{t}]{{2,}}", r"\1") for v, t in steps.STRETCHED.items()])


def crying_sql(c: str) -> str:
    t = "[쿠큐푸퓨ㅜㅠ]+"
    return rr(c, (f"[후휴]{t}", "ㅎㅠㅠ"), (f"[푸퓨]{t}", "ㅠㅠ"), (f"[쿠큐]{t}", "ㅋㅠㅠ"))


def upper_tags_sql(c: str) -> str:
    return rewrite_sql(c, r"\[[a-zA-Z_]+\]", "upper(x)")


# --- the queries ------------------------------------------------------------------


def step(
    text: str, fn: Callable[[Column], Column], sql: Callable[[str], str] | None
) -> Query:
    """A step on ``text``, an SQL expression over ``documents``."""

    def run(spark, sf_dir):
        return documents(spark, sf_dir, c=text).select("id", fn(F.col("c")).alias("out"))

    return Query(
        run, sql and f"WITH d AS ({documents_sql(c=text)}) SELECT id, {sql('c')} AS out FROM d"
    )


def on(*snippets: str, lower: bool = True) -> str:
    """Corpus text with ``snippets``, lower-case as most steps see it."""
    sql = decorated(snippets)
    return f"lower({sql})" if lower else sql


NICKNAMES = "'@user-' || source || " + choose(
    "doc_id",
    ["가나다", "_abc", "가a나", "123", "-x1", "aaaa", " 나나나나 ", "-가-나", "__zz", "가A양"],
)


def _seen_upper(match: Column) -> Column:
    return F.concat(F.lit("<"), F.upper(match), F.lit(">"))


def _named_rewrite(c: Column) -> Column:
    register_rewrite("bracket_upper", _seen_upper)
    return rewrite_named(c, "[a-z]+ing", "bracket_upper")


def _normalize_posts(spark, sf_dir):
    return normalize(posts(spark, sf_dir), default_rules(spark))


def _normalize_nicknames(spark, sf_dir):
    rows = documents(spark, sf_dir, nickname=NICKNAMES)
    return rows.select("id", nickname_chain(F.col("nickname"), RULES).alias("nickname"))


def _nickname_chain_sql() -> str:
    cleaned = f"WITH a AS ({documents_sql(c=NICKNAMES)}), b AS (SELECT id, {nickname_sql('lower(c)')} AS c FROM a)"
    fixed = f", w AS (SELECT id, {words_sql('c')} AS c FROM b)"
    short = isolated_letter_sql(rr("c", (r"[0-9]+$", "")))
    tail = f", e AS (SELECT id, {short} AS c FROM w), f AS (SELECT id, {default_nickname_sql('c')} AS c FROM e)"
    return f"{cleaned}{fixed}{tail} SELECT id, {upper_tags_sql('c')} AS nickname FROM f"


def _more_rules(spark, sf_dir):
    rules = RULES.adding(word=[("the ", "THE_")], sentence=[("([a-z])ing ", r"\1in ")])
    rows = documents(spark, sf_dir, c=on(" 갠춘해", ""))
    return rows.select("id", steps.fix_words(F.col("c"), rules).alias("out"))


def _more_rules_sql() -> str:
    words = [*WORDS, ("the ", "THE_")]
    c = rr(dict_sql(dict_sql("c", words), CHARS), *RULES.monde, *RULES.sentence, ("([a-z])ing ", r"\1in "))
    c = rewrite_sql(c, r"ㄱ\s+ㅅ", "replace(x, ' ', '')")
    return f"WITH d AS ({documents_sql(c=on(' 갠춘해', ''))}) SELECT id, {c} AS out FROM d"


def _lower_columns(spark, sf_dir):
    from postweave.operators.normalize import lower_all

    return lower_all(posts(spark, sf_dir), ["nickname", "comment"])


def _squeeze_to_one(c: str) -> str:
    for ch in "abcdefghijklmnopqrstuvwxyz ":
        c = rr(c, (f"{ch}{{2,}}", ch))
    return c


SPACED = [" a b c-d 가 나 다", " 안 . 녕 하세요 (b c)", " R&D & x", " [a] 가.나.다", ""]

QUERIES: dict[str, Query] = {
    # generic blocks
    "regex_rules": step(
        on(" the 먼데"),
        lambda c: regex_chain(c, [("([a-z])tion", r"\1shun"), ("th([aeiou])", r"d\1"), ("[.,]+", ";")]),
        lambda c: rr(c, ("([a-z])tion", r"\1shun"), ("th([aeiou])", r"d\1"), ("[.,]+", ";")),
    ),
    "dictionary_replace": step(
        on(" 갠춘해 방가욥", " 욥글 조아욤"),
        lambda c: dict_replace(c, [*WORDS, ("the", "THE"), ("there", "X"), ("and", "&"), ("an", "N")]),
        lambda c: dict_sql(c, [*WORDS, ("the", "THE"), ("there", "X"), ("and", "&"), ("an", "N")]),
    ),
    "squeeze_spaces": step(
        on("   aaa", " bbbb  "),
        lambda c: squeeze(c, "[a-z ]", min_run=2, keep=1),
        lambda c: _squeeze_to_one(c),
    ),
    "collapse_tag_runs": step(
        on(" [num] [num]  [num] x", " [num]", " a[num][num]b"),
        lambda c: collapse_tag(c, "[num]"),
        lambda c: rr(c, (r"(?:\[num\]\s*)+", "[num]")),
    ),
    "rewrite_matches": step(
        on(" end"),
        lambda c: rewrite_matches(c, "[a-z]*tion", lambda m: F.concat(F.upper(m), F.length(m))),
        lambda c: rewrite_sql(c, "[a-z]*tion", "upper(x) || length(x)"),
    ),
    "named_rewrite": step(
        on(" sing"),
        _named_rewrite,
        lambda c: rewrite_sql(c, "[a-z]+ing", "'<' || upper(x) || '>'"),
    ),
    "sort_run_characters": step(
        on("?.,!~"), lambda c: sort_chars(c, "~.,?!"), lambda c: repeat_count_sql(c, "~.,?!")
    ),
    "strip_text": step(
        "'  ' || text || chr(10) || chr(9) || ' '", strip, lambda c: rr(c, (r"\A\s+|\s+\z", ""))
    ),
    "compose_jamo": step(
        on(" ㄷㅐㅎㅏㄴㅁㅣㄴㄱㅜㄱ", " ㅋㅋㅋ 가ㄱ ㄱㅏ", " ㅇㅣㄱㅓㄹ ㅂㅗㅏ요", " 꺄ㅠㅠ ㄸㅗ"),
        hangul.compose,
        lambda c: compose_sql(f"replace({c}, 'ㅗㅏ', 'ㅘ')"),
    ),
    "decompose_syllables": step(
        on(" 대한민국 값", " 가나다 까치", " 뷁 a"),
        hangul.decompose,
        lambda c: rewrite_sql(
            c,
            S,
            f"'{INITIALS}'[((unicode(x) - 44032) // 588 + 1)] || chr(12623 + ((unicode(x) - 44032) % 588) // 28) "
            f"|| CASE WHEN (unicode(x) - 44032) % 28 > 0 THEN '{FINALS}'[((unicode(x) - 44032) % 28)] ELSE '' END",
        ),
    ),
    # nickname steps
    "clean_nickname": step(f"lower({NICKNAMES})", steps.clean_nickname, nickname_sql),
    "drop_trailing_digits": step(
        f"lower({NICKNAMES}) || source", steps.drop_trailing_digits, lambda c: rr(c, ("[0-9]+$", ""))
    ),
    "drop_isolated_letter": step(
        "'가a나b다' || " + choose("doc_id", ["가a나", "가A양", "가b컵x힣", "aa가", "c가"]) + " || source",
        steps.drop_isolated_letter,
        isolated_letter_sql,
    ),
    "default_nickname": step(
        "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN source WHEN 2 THEN '가나' WHEN 3 THEN source || '가' ELSE '가a' END",
        steps.default_nickname,
        default_nickname_sql,
    ),
    "normalize_nicknames": Query(_normalize_nicknames, _nickname_chain_sql()),
    # comment steps, in chain order
    "lower_columns": Query(
        _lower_columns,
        f"SELECT id, lower(nickname) AS nickname, lower(comment) AS comment FROM ({POSTS_SQL})",
    ),
    "unify_spaces": step(
        "replace(text, ' ', '\u2002') || '\u2003\u2007x\u2008'",
        steps.unify_spaces,
        lambda c: rr(c, ("[\u2002\u2003\u2007\u2008]+", " ")),
    ),
    "drop_invisible": step(
        on(" **a*b", " \u200b가\u200d나\ufeff", " \U0001f44d\U0001f3fb\U0001f3ff x\ufe0f", ""),
        steps.drop_invisible,
        lambda c: rr(
            c,
            (
                r"[\x{1F3FB}-\x{1F3FF}\x{FE0F}\x{0674}\x{1160}\x{200B}-\x{200D}\x{FEFF}\x{2060}]+",
                "",
            ),
            (r"\*+", ""),
        ),
    ),
    "unify_marks": step(
        on(" ㅋ   ㅋ 와！", " 뭐？❓…", " ㅠ  a"),
        lambda c: steps.unify_marks(c, RULES.punct),
        lambda c: rr(c, *RULES.punct, (rf"({J})\s+", r"\1 ")),
    ),
    "fold_unicode": step(
        on(" ①ｅ ㅋㅋ", " ﬁn e\u0301 é\u0335", " ㄱㅏㅇ ㅠㅠ", ""),
        lambda c: steps.fold_unicode(c, jamo_restoration()),
        # The corpus holds no other character that folding changes.
        lambda c: compose_sql(
            rr(c, ("①", "1"), ("ｅ", "e"), ("ﬁ", "fi"), ("e\u0301", "é"), ("\u0335", ""))
        ),
    ),
    "unify_letters": step(
        on(" ɑⲁ оо ㄷㅇm", " c0m CㅇM", " 漢字 中 x", ""),
        lambda c: steps.unify_letters(c, RULES.single_en),
        lambda c: rr(c, *RULES.single_en, ("(?i)[cㄷ][o0ㅇ]m", "com"), (r"[\x{4E00}-\x{9FFF}]+", "")),
    ),
    "squeeze_long_runs": step(
        on(" aaaa 1000 5 000 ㅋㅋㅋㅋ", " !!!! ???", " 5aaaa 5aaa 11111", " zzz"),
        steps.squeeze_long_runs,
        lambda c: squeeze_sql(c, 3),
    ),
    "fix_words": step(
        on(" 갠춘해 조아욤 뎈", " 먼데 몬데 방가욥", " 안녕  하세요", " ㄱ  ㅅ 욬"),
        lambda c: steps.fix_words(c, RULES),
        words_sql,
    ),
    "rules_added_later": Query(_more_rules, _more_rules_sql()),
    "tidy_jamo": step(
        on(" ㅋ ㅋ 1 ㅋ!ㅋ 가", " ㅜ ㅜ ㅜ 가1나11다", " 앜ㅋㅋ 가ㅎㅎ 핫ㅎ", " ㅏㅑ ㄱㅏ ㄴ ㅇㅣㄴ", ""),
        steps.tidy_jamo,
        tidy_jamo_sql,
    ),
    "close_jamo_gaps": step(
        on(" ㅋ ㅋ 1 ㅋ!ㅋ 가", " ㅠ?!ㅠ", " ㅋ 가"),
        steps.close_jamo_gaps,
        lambda c: rr(c, *[(rf"({J})[\s0-9?!]+({J})", r"\1\2")] * 2),
    ),
    "drop_ones_between_syllables": step(
        on(" 가1나1다11라", " 가1 나", " 1가1"),
        steps.drop_ones_between_syllables,
        lambda c: rr(c, *[(f"({S})1+({S})", r"\1\2")] * 2),
    ),
    "split_laughter": step(on(" 앜ㅋㅋ 가ㅋㅋ", " 핳ㅎㅎㅋ", " 낯ㅊ 닽ㅌㅌ", ""), steps.split_laughter, laughter_sql),
    "sort_marks": step(on(" wow!!??", " ok.,", " ok~~,!", " a,,b..c?!?!", " .,"), steps.sort_marks, marks_sql),
    "shorten_vowels": step(
        on(" 가아아아 가아", " 너어어 애애애", " 교오오 쵸ㅛㅛ", " 히이이이 그으으", " 네에에엥", ""),
        steps.shorten_vowels,
        vowels_sql,
    ),
    "unify_crying": step(on(" 후쿠쿠 쿠쿠", " 푸쿠 큐ㅠㅠ", " 쿠푸쿠 휴ㅜ", ""), steps.unify_crying, crying_sql),
    "tag_symbols": step(
        on(" https://a.b/c?d :) x", " me@site.co.kr :-)", " 🎉🎊 ❤💕", " hahaHAHA 하하하 ^_^", ""),
        lambda c: steps.tag_symbols(c, RULES),
        symbols_sql,
    ),
    "keep_known_chars": step(
        on(" [[a]] ❤☆aaaaaa", " 1111 5555aaaaa ~~~~~", " ㅋㅋㅋㅋㅋ   ", ""),
        steps.keep_known_chars,
        known_chars_sql,
    ),
    "join_spaced_letters": step(on(*SPACED), lambda c: steps.join_spaced_letters(strip(c)), None),
    "drop_i_between_syllables": step(
        on(" 가ㅣ나다ㅣ라", " 가ㅣㅣ나", " 가ㅣ나ㅣ다ㅣ라"),
        steps.drop_i_between_syllables,
        lambda c: rr(c, *[(f"({S})ㅣ({S})", r"\1\2")] * 2),
    ),
    "tag_structured": step(
        on(" 2024-01-02 10:30", " 1,000원 5 kg", " 10km 3.14", ""),
        lambda c: steps.tag_structured(c, RULES),
        lambda c: rr(c, *RULES.base, *RULES.extern),
    ),
    "tidy_marks": step(on(" 3.14 , a .b", " 1,000 ! ?x", " a ^ b . . c", " 1.2.3 ,4"), steps.tidy_marks, tidy_marks_sql),
    "collapse_tags": step(
        on(" [num] [num] x", " [x][x] [num]  [x]", ""),
        lambda c: steps.collapse_tags(c, RULES.tags),
        lambda c: rr(c, (r"(?:\[num\]\s*)+", "[num]"), (r"(?:\[x\]\s*)+", "[x]")),
    ),
    "laugh_z": step(on(" zzzz", " pizza zz", ""), steps.laugh_z, lambda c: rr(c, ("z{2,}", "ㅋㅋ"))),
    "upper_tags": step(on(" hi [text_emoji] [a1] [x]", " [[num]]", ""), steps.upper_tags, upper_tags_sql),
    "normalize_posts": Query(_normalize_posts),
}
