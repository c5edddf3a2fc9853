"""Hangul syllable arithmetic as native column expressions.

A syllable is ``0xAC00 + (initial * 21 + vowel) * 28 + final`` (Unicode, Hangul
Syllable Composition).  Loose jamo are compatibility jamo (U+3131..U+3163).

``compose`` reads left to right: an initial and a vowel make a syllable; a
consonant after them is its final unless a vowel follows; two vowels or two
finals that have a compound form are merged; everything else, ready syllables
included, is left alone.  ``decompose`` writes each syllable as its two or three
jamo, and ``compose`` undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postweave.functions.text import char_class, char_span, let, rewrite_matches, where_held

# Jamo in Unicode syllable order, and the compound forms.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
COMPOUND_VOWELS = {
    "ㅗㅏ": "ㅘ", "ㅗㅐ": "ㅙ", "ㅗㅣ": "ㅚ", "ㅜㅓ": "ㅝ", "ㅜㅔ": "ㅞ", "ㅜㅣ": "ㅟ", "ㅡㅣ": "ㅢ",
}
COMPOUND_FINALS = {
    "ㄱㅅ": "ㄳ", "ㄴㅈ": "ㄵ", "ㄴㅎ": "ㄶ", "ㄹㄱ": "ㄺ", "ㄹㅁ": "ㄻ", "ㄹㅂ": "ㄼ",
    "ㄹㅅ": "ㄽ", "ㄹㅌ": "ㄾ", "ㄹㅍ": "ㄿ", "ㄹㅎ": "ㅀ", "ㅂㅅ": "ㅄ",
}

SYLLABLE = "가-힣"
JAMO = "ㄱ-ㅣ"
JAMO_CHARS = char_span("ㄱ", "ㅣ")
FIRST_SYLLABLE = 0xAC00
FIRST_VOWEL = 0x314F

_VOWEL = char_class(VOWELS)
COMPOSABLE = (
    f"{char_class(INITIALS)}(?:{'|'.join(COMPOUND_VOWELS)}|{_VOWEL})"
    f"(?:(?:{'|'.join(COMPOUND_FINALS)}|{char_class(FINALS)})(?!{_VOWEL}))?"
)


def syllable(initial: int, vowel: int, final: int = 0) -> str:
    """One syllable from its indices; for building fixed patterns."""
    return chr(FIRST_SYLLABLE + (initial * len(VOWELS) + vowel) * (len(FINALS) + 1) + final)


def open_syllables(vowels: str) -> str:
    """All syllables without a final that have one of ``vowels``."""
    return "".join(
        syllable(initial, VOWELS.index(vowel))
        for vowel in vowels
        for initial in range(len(INITIALS))
    )


def char_of(code: Column) -> Column:
    """The character of a code point in U+0800..U+FFFF (three UTF-8 bytes)."""

    def utf8(cp: Column) -> Column:
        high = F.shiftright(cp, 12).bitwiseOR(F.lit(0xE0))
        middle = F.shiftright(cp, 6).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
        low = cp.bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
        packed = F.shiftleft(high, 16).bitwiseOR(F.shiftleft(middle, 8)).bitwiseOR(low)
        return F.decode(F.unhex(F.hex(packed.cast("long"))), "UTF-8")

    return let(code, utf8)


def final_index(c: Column) -> Column:
    """Index of the final consonant of a syllable, 0 for none."""
    return F.pmod(F.ascii(c) - F.lit(FIRST_SYLLABLE), F.lit(28))


def without_final(c: Column) -> Column:
    """The syllable with its final consonant taken off."""
    return char_of(F.ascii(c) - final_index(c))


def _merged(c: Column, table: dict[str, str]) -> Column:
    for pair, compound in table.items():
        c = F.replace(c, F.lit(pair), F.lit(compound))
    return c


def compose(c: Column) -> Column:
    """Build syllables from loose jamo."""

    def build(jamo: Column) -> Column:
        # The first character is an initial followed by a vowel, so merging
        # pairs can only touch the vowel and final parts.
        def from_parts(parts: Column) -> Column:
            initial = F.instr(F.lit(INITIALS), F.substring(parts, 1, 1)) - 1
            vowel = F.ascii(F.substring(parts, 2, 1)) - FIRST_VOWEL
            final = F.when(
                F.length(parts) > 2, F.instr(F.lit(FINALS), F.substring(parts, 3, 1))
            ).otherwise(0)
            return char_of((initial * 21 + vowel) * 28 + final + FIRST_SYLLABLE)

        return let(_merged(_merged(jamo, COMPOUND_VOWELS), COMPOUND_FINALS), from_parts)

    return where_held(c, VOWELS, lambda text: rewrite_matches(text, COMPOSABLE, build))


def decompose(c: Column) -> Column:
    """Write each syllable as initial, vowel and final jamo."""

    def split_up(one: Column) -> Column:
        index = F.ascii(one) - F.lit(FIRST_SYLLABLE)
        return let(
            index,
            lambda i: F.concat(
                F.substring(F.lit(INITIALS), F.floor(i / 588).cast("int") + 1, F.lit(1)),
                char_of(F.floor(F.pmod(i, F.lit(588)) / 28).cast("int") + FIRST_VOWEL),
                F.when(
                    F.pmod(i, F.lit(28)) > 0,
                    F.substring(F.lit(FINALS), F.pmod(i, F.lit(28)), F.lit(1)),
                ).otherwise(""),
            ),
        )

    return rewrite_matches(c, f"[{SYLLABLE}]", split_up)
