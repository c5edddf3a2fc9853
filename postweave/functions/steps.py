"""The steps of the normalization chain, each ``Column -> Column``.

Names follow what a step does.  Loops to a fixed point and match callbacks of
the usual imperative form are single native replaces here; the tests hold each
against a small Python restatement.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postweave.functions import hangul
from postweave.functions.hangul import JAMO, JAMO_CHARS, SYLLABLE, open_syllables
from postweave.functions.regex import java_pattern
from postweave.functions.text import (
    LETTERS,
    NOT_PLAIN,
    WHITE_SPACE,
    char_class,
    char_span,
    collapse_tag,
    dict_replace,
    holds_any,
    java_quote,
    key_pattern,
    let,
    regex_chain,
    rewrite_matches,
    rewrite_named,
    sort_chars,
    squeeze,
    strip,
    where_held,
)
from postweave.functions.unicode_fold import fold_compatibility, map_chars

def _latin(pattern: str) -> str:
    """The characters below U+0100 that a one-character Python pattern matches, for a class:
    Java looks them up in one table."""
    return "".join(java_quote(ch) for ch in map(chr, range(256)) if re.fullmatch(pattern, ch))


EMPTY_COMMENT = "[EMPTY]"
DEFAULT_NICKNAME = "[DEFAULT_NICK]"
TEXT_FACE = "[TEXT_EMOJI]"

# Characters kept by the misc step, marks and order of the
# punctuation step, vowels dropped when alone, stretched-vowel groups.  Frequent
# ranges come first: they are tried in order.
KEPT_CHARS = rf"a-z {SYLLABLE}{JAMO}!?%&^()\[\]{{}}\-+=~,./<>;:'\"\s\w"
# Those of them that Java looks up in one table.
_KEPT_LATIN = _latin(f"[{KEPT_CHARS}]")
SQUEEZED_CHARS = rf"[a-zA-Z{SYLLABLE}{JAMO}!?%^()\[\]{{}}\-_+=~,./<>;:'\"\s]"
PUNCT_ORDER = "~.,?!"
LONE_VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅝㅞㅟㅢㅣ"
STRETCHED = {
    "ㅘㅏㅑ": "ㅏ아",
    "ㅝㅓㅕ": "ㅓ어",
    "ㅙㅞㅐㅒㅔㅖ": "ㅐㅒㅔㅖ애얘에예",
    "ㅛ": "ㅛㅗ요오",
    "ㅣ": "ㅣ이",
    "ㅡ": "ㅡ으",
}
# The two single-character classes, the chunk class and the
# trailing marks of the spaced-letter step.
_LETTER_BEFORE = rf"[\w{SYLLABLE}{JAMO}!?%&^\-+=~,./<>;:'\"]"
_LETTER_AFTER = rf"[\w{SYLLABLE}{JAMO}!?%^\-+=~,./<>;:'\"]"
_BETWEEN = r"[\s!?^@.,ㅣ~❤]+"
_IN_CHUNK = rf"(?:[a-z]++|[{SYLLABLE}]++|[{JAMO}!?%^()\[\]{{}}\-+=~,./<>;:'\"\w]++)++"
_AFTER_CHUNK = r"[ !?@.,❤\s]"
# A stand-alone character and its separators before another one, or else a chunk;
# tried only where the last match ended, so matches cover a prefix of the text.
_SPACED = java_pattern(
    rf"\G(?:\b({_LETTER_BEFORE})\b{_BETWEEN}(?=\b{_LETTER_AFTER}\b)|(\s*+{_IN_CHUNK}{_AFTER_CHUNK}*+))"
)
# What ``_SPACED`` can join, in a text with a space ahead: a word character that stands alone
# ahead of another, or a mark beside the only separator that is a letter.
_SOME_SPACED = java_pattern(
    rf"(?:(?![{_latin(r'\w')}])\W\w(?!\w){_BETWEEN}(?=\b{_LETTER_AFTER}\b)|(?![{_latin(r'\w')}])(?!\w)(?<=\w){_LETTER_BEFORE}ㅣ)"
)
# Chunks, each with the marks behind it, are joined by one space.  What changes lies between
# them: white space and marks up to the next chunk, or the first character that no chunk can
# hold, behind which all is kept.  One space ahead of a chunk is passed over.
_CHUNK_CHARS = rf"{SYLLABLE}{JAMO}!?%^()\[\]{{}}\-+=~,./<>;:'\"\w"
_NO_CHUNK = rf"[^{_CHUNK_CHARS}@❤\s]"
_CHUNK_AHEAD = java_pattern(rf"\A\s*+{_IN_CHUNK}")
_BETWEEN_CHUNKS = java_pattern(
    rf"(?![{_latin(f'[{_CHUNK_CHARS}]')}])(?! [{_latin(f'(?![!?.,])[{_CHUNK_CHARS}]')}])(?![가-힣])"
    rf"(?:(?=[\s@❤])(?! (?!{_NO_CHUNK})[^!?@.,❤\s])"
    rf"((?:{_AFTER_CHUNK}*[!?@.,❤])?)\s*+({_NO_CHUNK}(?s:.*+))?+|({_NO_CHUNK}(?s:.*+)))"
)


# --- nickname -------------------------------------------------------------


def clean_nickname(c: Column) -> Column:
    """Strip, drop ``@`` and odd characters, judge ``user-`` ids, drop suffixes,
    squeeze runs, keep letters, syllables and digits."""
    c = F.regexp_replace(strip(c), "^@", "")
    c = F.regexp_replace(c, r"[^a-zA-Z가-힣0-9\-._]+", "")
    # An id that is longer than seven or of odd length is a generated one.
    c = F.regexp_replace(c, "^user-(?:[a-z0-9]{8,}|(?:[a-z0-9]{2}){0,3}[a-z0-9])$", "")
    c = F.regexp_replace(c, r"^user-([a-zA-Z0-9가-힣\-._]+)$", "$1")
    c = F.regexp_replace(c, "[-_][a-zA-Z0-9]{3,}$", "")
    c = squeeze(c, min_run=2, keep=2)
    return F.regexp_replace(c, "[^a-zA-Z가-힣0-9]+", "")


def drop_trailing_digits(c: Column) -> Column:
    return F.regexp_replace(c, java_pattern(r"(?<!\d)\d++$"), "")


def drop_isolated_letter(c: Column) -> Column:
    """Drop a lone Latin letter between syllables unless 양 or 컵 follows."""
    return F.regexp_replace(c, f"(?<=[{SYLLABLE}])[a-zA-Z](?=[{SYLLABLE}])(?!양|컵)", "")


def is_default_nickname(c: Column) -> Column:
    """Empty, letters-digits-marks only, or Hangul and shorter than three."""
    return let(
        c,
        lambda nick: (F.length(nick) == 0)
        | nick.rlike(r"^[a-zA-Z0-9\-_.]+$")
        | (nick.rlike(f"[{SYLLABLE}]") & (F.length(nick) < 3)),
    )


def default_nickname(c: Column) -> Column:
    return let(
        c,
        lambda nick: F.when(is_default_nickname(nick), DEFAULT_NICKNAME).otherwise(nick),
    )


# --- Unicode --------------------------------------------------------------


def unify_spaces(c: Column) -> Column:
    spaces = "\u2002\u2003\u2007\u2008"
    return where_held(c, spaces, lambda text: F.regexp_replace(text, f"[{spaces}]+", " "))


def drop_invisible(c: Column) -> Column:
    """Drop skin tones, variation and joining marks, then every ``*``."""
    invisible = NOT_PLAIN + r"[\x{1F3FB}-\x{1F3FF}\uFE0F\u0674\u1160\u200B\u200C\u200D\uFEFF\u2060]+"
    chars = [*char_span("\U0001f3fb", "\U0001f3ff"), *"\ufe0f\u0674\u1160\u200b\u200c\u200d\ufeff\u2060"]
    seen = where_held(c, chars, lambda text: F.regexp_replace(text, invisible, ""))
    return F.replace(seen, F.lit("*"), F.lit(""))


def unify_marks(c: Column, punct: Sequence[tuple[str, str]]) -> Column:
    """Variants of a mark become the mark; one space after a jamo."""
    spaced = java_pattern(rf"([{JAMO}])\s+")
    return where_held(regex_chain(c, punct), JAMO_CHARS, lambda text: F.regexp_replace(text, spaced, "$1 "))


def fold_unicode(c: Column, single_ko: Mapping[str, str]) -> Column:
    """Compose jamo, NFKC, drop combining marks, map single characters.

    ``normalize`` uses ``unicode_fold.fold_column``, the same step for only the
    rows that need the round trip through Python.
    """
    return map_chars(fold_compatibility(hangul.compose(c)), single_ko)


def unify_letters(c: Column, single_en: Sequence[tuple[str, str]]) -> Column:
    """Look-alike letters, disguised ``com``, and no CJK ideographs."""
    c = regex_chain(c, single_en)
    # All that is read as "com" and is not that.
    disguised = [f"{o}{m}" for o in "o0Oㅇ" for m in "mM" if o + m != "om"] + ["Com", "ㄷom"]
    c = where_held(c, disguised, lambda text: F.regexp_replace(text, "(?iu)[cㄷ][o0ㅇ]m", "com"))
    ideographs = char_span("\u4e00", "\u9fff")
    return where_held(c, ideographs, lambda text: F.regexp_replace(text, r"[\u4E00-\u9FFF]+", ""))


def squeeze_long_runs(c: Column) -> Column:
    """Three or more of a character become two, unless right after a digit."""
    return squeeze(c, min_run=3, keep=2, not_after=r"\d")


# --- dictionaries and grammar ---------------------------------------------


def fix_words(c: Column, rules) -> Column:
    """Word and character dictionaries, then the three ordered rule lists."""
    c = dict_replace(dict_replace(c, rules.word), rules.char)
    c = regex_chain(regex_chain(c, rules.monde), rules.sentence)
    for pattern, function in rules.sentence_fn:
        c = rewrite_named(c, pattern, function)
    return c


# --- spaces and jamo ------------------------------------------------------


def mark_spaced_vowels(c: Column) -> Column:
    spaced = java_pattern(r"(?:[ㅜㅣ]\s++(?=[ㅜㅣ]))++[ㅜㅣ]")
    return where_held(c, "ㅜㅣ", lambda text: F.regexp_replace(text, spaced, "TEMP_U"))


def restore_spaced_vowels(c: Column) -> Column:
    return F.replace(c, F.lit("TEMP_U"), F.lit("ㅜ ㅜ ㅜ"))


def close_jamo_gaps(c: Column) -> Column:
    """Delete spaces, digits, ``?`` and ``!`` between two jamo."""
    gap = java_pattern(rf"(?<=[{JAMO}])[\s0-9?!]+(?=[{JAMO}])")
    return where_held(c, JAMO_CHARS, lambda text: F.regexp_replace(text, gap, ""))


def drop_ones_between_syllables(c: Column) -> Column:
    ones = f"(?<=[{SYLLABLE}])1+(?=[{SYLLABLE}])"
    return where_held(c, "1", lambda text: F.regexp_replace(text, ones, ""))


def split_laughter(c: Column) -> Column:
    """Set a laughing run off from its syllable; drop a final that belongs to it."""

    def split_one(match: Column) -> Column:
        head = F.substring(match, 1, 1)
        run = F.substr(match, F.lit(2))
        same = hangul.final_index(head) == F.instr(
            F.lit(hangul.FINALS), F.substring(match, 2, 1)
        )
        return F.concat(
            F.when(same, hangul.without_final(head)).otherwise(head), F.lit(" "), run, F.lit(" ")
        )

    laughing = "ㅋㅎㅌㅊ"
    return where_held(
        c, laughing, lambda text: rewrite_matches(text, f"[{SYLLABLE}]{char_class(laughing)}+", split_one)
    )


def space_jamo(c: Column) -> Column:
    return where_held(c, JAMO_CHARS, lambda text: F.regexp_replace(text, f"([{JAMO}]+)", " $1 "))


def drop_lone_vowels(c: Column) -> Column:
    lone = f"{char_class(LONE_VOWELS)}+"
    return where_held(c, LONE_VOWELS, lambda text: F.regexp_replace(text, lone, ""))


def tidy_jamo(c: Column) -> Column:
    """All of the jamo repairs, in order."""
    c = drop_ones_between_syllables(close_jamo_gaps(mark_spaced_vowels(c)))
    c = space_jamo(split_laughter(restore_spaced_vowels(c)))
    # Jamo runs now stand alone, so taking syllables apart and putting them
    # together again could only join jamo within a run: composing is enough.
    return drop_lone_vowels(hangul.compose(c))


# --- marks and stretched text ---------------------------------------------


def sort_marks(c: Column) -> Column:
    """Sort each run of marks and squeeze it."""

    def tidy(run: Column) -> Column:
        run = F.regexp_replace(sort_chars(run, PUNCT_ORDER), ".+,+", "..")
        return F.regexp_replace(F.regexp_replace(run, r"\.{2,}", ".."), r"([?!~])\1+", "$1")

    return rewrite_matches(c, "[~.,?!]{2,}", tidy)


def shorten_vowels(c: Column) -> Column:
    """A syllable stretched by two or more of its own vowel keeps none of them."""

    trails = "".join(STRETCHED.values())

    def shorten(text: Column) -> Column:
        stretched = holds_any(text, trails) & text.rlike(f"{char_class(trails)}{{2}}")
        return F.when(stretched, _without_trails(text)).otherwise(text)

    return let(c, shorten)


def _without_trails(c: Column) -> Column:
    for vowels, trail in STRETCHED.items():
        # The few trail characters are looked for first; the long syllable class
        # is only tried in front of them.
        before = char_class(open_syllables(vowels))
        pattern = f"(?=[{trail}])(?<={before})[{trail}]{{2,}}"
        c = where_held(c, trail, lambda text, pattern=pattern: F.regexp_replace(text, pattern, ""))
    return c


def unify_crying(c: Column) -> Column:
    """Crying syllables become initial + ㅠㅠ."""
    trail = "[쿠큐푸퓨ㅜㅠ]+"
    for start, crying in (("후휴", "ㅎㅠㅠ"), ("푸퓨", "ㅠㅠ"), ("쿠큐", "ㅋㅠㅠ")):
        pattern = f"[{start}]{trail}"
        c = where_held(
            c, start, lambda text, pattern=pattern, crying=crying: F.regexp_replace(text, pattern, crying)
        )
    return c


def laugh_z(c: Column) -> Column:
    return where_held(c, ["zz"], lambda text: F.regexp_replace(text, "z{2,}", "ㅋㅋ"))


# --- tags -----------------------------------------------------------------


def tag_symbols(c: Column, rules) -> Column:
    """Special spans, text faces, emoji and emoji-like text become tags."""
    c = regex_chain(c, rules.special)
    if rules.face_pattern:
        starts = [face[0] for face, _ in rules.face if face]
        c = where_held(c, starts, lambda text: F.regexp_replace(text, rules.face_pattern, TEXT_FACE))
    return regex_chain(c, [*rules.emoji_set, *rules.emoji_text])


def tag_structured(c: Column, rules) -> Column:
    """Numbers, dates, costs and other structured spans become tags."""
    return regex_chain(c, [*rules.base, *rules.extern])


def _meet(a: str, b: str) -> bool:
    """Whether ``b`` holds ``a``, or can begin inside ``a`` and go on behind it."""
    return (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b))))


def collapse_tags(c: Column, tags: Sequence[str]) -> Column:
    if any(_meet(a, b) for a in tags for b in tags):
        for tag in tags:
            c = collapse_tag(c, tag)
        return c
    # No two tags share characters: one pass does the same as one per tag.
    any_tag = key_pattern(tags)
    if not any_tag:
        return c
    run = java_pattern(rf"({any_tag})\s*+(?:\1\s*+)*+")
    return where_held(c, {tag[0] for tag in tags if tag}, lambda text: F.regexp_replace(text, run, "$1"))


def upper_tags(c: Column) -> Column:
    return where_held(c, "[", lambda text: rewrite_matches(text, r"\[[a-zA-Z_]+\]", F.upper))


# --- misc -----------------------------------------------------------------


def keep_known_chars(c: Column) -> Column:
    """Single brackets, known characters only, runs of four or more cut, stripped;
    a missing comment becomes ``[EMPTY]``."""
    for bracket in "[]":
        pattern = f"\\{bracket}+"
        c = where_held(
            c,
            [bracket * 2],
            lambda text, pattern=pattern, bracket=bracket: F.regexp_replace(text, pattern, bracket),
        )
    c = F.regexp_replace(c, java_pattern(f"(?![{_KEPT_LATIN}])(?![가-힣])[^{KEPT_CHARS}]+"), "")
    c = squeeze(c, SQUEEZED_CHARS, min_run=4, keep=2, not_after=r"\d")
    return F.coalesce(strip(c), F.lit(EMPTY_COMMENT))


def join_spaced_letters(c: Column) -> Column:
    """Join letters that stand alone with spaces or marks between them.

    Takes stripped text and reads it as chunks.  A chunk may start with a series
    of stand-alone characters, each with separators after it and another
    stand-alone character behind those: the separators go.  Chunks are trimmed
    and joined with one space.  From the first place where no chunk can start,
    the rest is kept as it is.
    """
    c = where_held(c, "([{)]}", lambda text: F.regexp_replace(text, r"([(\[{)\]}])", " $1"))
    c = let(
        c,
        lambda text: F.when(
            F.concat(F.lit(" "), text).rlike(_SOME_SPACED), F.regexp_replace(text, _SPACED, "$1$2")
        ).otherwise(text),
    )
    trimmed = let(
        c,
        lambda text: F.when(
            text.rlike(_CHUNK_AHEAD), F.regexp_replace(F.ltrim(text, F.lit(WHITE_SPACE)), _BETWEEN_CHUNKS, "$1 $2$3")
        ).otherwise(text),
    )
    return where_held(
        F.rtrim(trimmed), "([{)]}", lambda text: F.regexp_replace(text, r"([(\[{]) | ([)\]}])", "$1$2")
    )


def drop_i_between_syllables(c: Column) -> Column:
    between = f"(?<=[{SYLLABLE}])ㅣ(?=[{SYLLABLE}])"
    return where_held(c, "ㅣ", lambda text: F.regexp_replace(text, between, ""))


def tidy_marks(c: Column) -> Column:
    """No space before a mark and one after it, but not inside numbers."""
    # Letters are rejected first; \G or look-behind start a match at the first
    # space of a run, once.
    # A letter, one behind a space, and marks with the one space they should have are passed over.
    passed = rf"(?![{_latin(r'[^.,?!^\s]')}])(?! [{LETTERS}])(?![.,?!^]++ [{LETTERS}])(?![가-힣])"
    start = rf"{passed}(?=[.,?!^\s])(?:\G|(?<!\s))\s*+"
    inside_number = r"(?!(?<=\d)[.,](?=\d))"
    c = F.regexp_replace(c, java_pattern(rf"{start}{inside_number}([.,?!^]++)\s*+"), "$1 ")
    several = java_pattern(rf"(?![{_latin(r'\S')}])(?! [{LETTERS}])(?![가-힣])\s{{2,}}")
    return let(
        c,
        lambda text: F.when(
            F.contains(text, F.lit("  ")) | holds_any(text, WHITE_SPACE.replace(" ", "")),
            F.regexp_replace(text, several, " "),
        ).otherwise(text),
    )
