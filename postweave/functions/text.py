"""Building blocks for rule-driven text rewriting: ``Column -> Column``.

Rule patterns are written in Python ``re`` syntax (that is how rule files come)
and translated once (``functions.regex``) to the Java syntax Spark runs.  Patterns
always reach Spark as literals, so each task compiles them once.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postweave.functions.regex import JAVA_FLAGS, java_pattern, required_literal, required_texts

# Java looks single characters below U+0100 up in one table, but tests ranges one by one:
# letters written out are one test.
LETTERS = "abcdefghijklmnopqrstuvwxyz"

# Ahead of a class that holds neither: rejects most characters of most texts.
NOT_PLAIN = f"(?![{LETTERS} ])(?![가-힣])"

_GROUP_REF = re.compile(r"\\(?:g<(\d+)>|(\d{1,2}))|\\(.)|(.)", re.S)


def java_quote(text: str) -> str:
    """Pattern that matches ``text`` literally, inside or outside a class."""
    return "".join(ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch for ch in text)


def java_literal(text: str) -> str:
    """Replacement that stands for ``text`` literally."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def java_replacement(template: str) -> str:
    """A Python replacement template (``\\1``) as a Java one (``$1``)."""
    out, after_ref = [], False
    for named, numbered, escaped, plain in _GROUP_REF.findall(template):
        if named or numbered:
            out.append("$" + (named or numbered))
            after_ref = True
            continue
        char = plain or {"n": "\n", "t": "\t", "r": "\r"}.get(escaped, escaped)
        # A digit right after a reference would be read as part of its number.
        out.append("\\" + char if after_ref and char.isdigit() else java_literal(char))
        after_ref = False
    return "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often it is used.

    A step that names its input twice would otherwise double the expression
    tree at each level of a long chain.
    """
    return F.transform(F.array(value), body)[0]


# Up to this many characters or starts of characters are looked for one by one.
FEW = 16


def holds_any(text: Column, chars: Iterable[str]) -> Column:
    """Whether ``text`` holds one of ``chars``; of many, whether it holds a character that
    starts with the same bytes as one of them.

    A search for bytes costs a hundredth of a pattern, so a step that can only change texts
    with certain characters asks for those first.  Few ``chars`` may be longer texts.
    """
    wanted = sorted(set(chars))
    if len(wanted) <= FEW:
        return reduce(or_, [F.contains(text, F.lit(one)) for one in wanted])
    starts = {one.encode()[:2] for one in wanted}
    if len(starts) > FEW:
        starts = {start[:1] for start in starts}
    return reduce(or_, [F.contains(text.cast("binary"), F.lit(start)) for start in sorted(starts)])


def where_held(c: Column, chars: Iterable[str], step: Callable[[Column], Column]) -> Column:
    """``step`` for texts that hold one of ``chars``; for a step that leaves all others alone."""
    return let(c, lambda text: F.when(holds_any(text, chars), step(text)).otherwise(text))


def char_span(first: str, last: str) -> list[str]:
    """All characters from ``first`` to ``last``."""
    return [chr(code) for code in range(ord(first), ord(last) + 1)]


# The white space Python strips.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space, not spaces only."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def regex_chain(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply ordered ``(pattern, replacement)`` rules, each on the last one's output."""
    rules = list(rules)
    # Each question is a level of nested functions, which the analyzer resolves one a round.
    held = required_texts if len(rules) <= FEW else _only_literal
    for pattern, replacement in rules:
        c = _replaced(c, pattern, java_replacement(replacement), held(pattern))
    return c


def _only_literal(pattern: str) -> list[str] | None:
    literal = required_literal(pattern)
    return None if literal is None else [literal]


def _replaced(c: Column, pattern: str, replacement: str, held: list[str] | None) -> Column:
    """One rule; texts without any of the characters that a match must hold are left alone."""
    java = java_pattern(pattern)
    if held is None or len(held) > FEW:
        return F.regexp_replace(c, java, replacement)
    return where_held(c, held, lambda text: F.regexp_replace(text, java, replacement))


# Stands around matches while a text is cut; a character of no script.
MARK = "\uf8fe"


def cut_at(text: Column, pattern: str, replacement: str) -> Column:
    """``text``, which holds no mark, cut at the marks that ``replacement`` puts into matches
    of a Java ``pattern``.

    One replace by a literal pattern, compiled once a task, and a split at one plain
    character; a split by a pattern compiles for each row.
    """
    marked = F.regexp_replace(text, pattern, replacement)
    return F.split(marked, MARK, -1)


def rewrite_matches(c: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace each match of a Java ``pattern`` (never empty) by ``fn(match)``.

    The text is cut into the pieces between matches and the matches themselves,
    so the work per row grows with the matches, not with the characters.
    """

    def joined(marked: Column) -> Column:
        new = F.transform(
            F.split(marked, MARK, -1),
            lambda part, i: F.when(i % 2 == 1, F.coalesce(fn(part), F.lit(""))).otherwise(part),
        )
        return F.when(F.contains(marked, F.lit(MARK)), F.array_join(new, "")).otherwise(marked)

    def with_marks_inside(text: Column) -> Column:
        between = F.split(text, pattern, -1)
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        merged = F.zip_with(
            between,
            F.transform(matches, fn),
            lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))),
        )
        return F.array_join(merged, "")

    def rewritten(text: Column) -> Column:
        cut = let(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), joined)
        return F.when(F.contains(text, F.lit(MARK)), with_marks_inside(text)).otherwise(cut)

    return let(c, rewritten)


# Java tests the parts of a class, and the branches of an alternation, one after
# the other, and a class of three or more ranges is several times slower than one
# of two.  So frequent characters get a cheap test of their own ahead of such a
# class, and above this many parts they are put into groups behind a range test.
GROUP = 8


def char_ranges(chars: Iterable[str]) -> list[tuple[str, str]]:
    """Characters as sorted ranges of neighbouring code points."""
    ranges: list[list[int]] = []
    for code in sorted({ord(ch) for ch in chars}):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return [(chr(first), chr(last)) for first, last in ranges]


def _range(first: str, last: str) -> str:
    return java_quote(first) if first == last else f"{java_quote(first)}-{java_quote(last)}"


def char_class(chars: Iterable[str]) -> str:
    """Pattern for one of ``chars``, cheap for many of them too."""
    ranges = char_ranges(chars)
    pattern = _grouped([(first, last, _range(first, last)) for first, last in ranges], "[{}]", "")
    return f"(?:(?=[{_range(ranges[0][0], ranges[-1][1])}]){pattern})" if len(ranges) > GROUP else pattern


def _grouped(parts: list[tuple[str, str, str]], form: str, joint: str) -> str:
    """``(first, last, pattern)`` parts in order, in groups behind range tests."""
    if len(parts) <= GROUP:
        return form.format(joint.join(pattern for _, _, pattern in parts))
    size = max(GROUP, -(-len(parts) // GROUP))
    branches = []
    for start in range(0, len(parts), size):
        group = parts[start : start + size]
        inner = _grouped(group, form, joint)
        branches.append(f"(?=[{_range(group[0][0], group[-1][1])}]){inner}")
    return f"(?:{'|'.join(branches)})"


def _factored(keys: Sequence[str]) -> str:
    """Alternation of ``keys`` with shared prefixes written once.

    Keys that share a start are tried together, so a position in the text costs
    the length of a key and not the number of keys.
    """
    heads: dict[str, list[str]] = {}
    for key in keys:
        if key:
            heads.setdefault(key[0], []).append(key[1:])
    parts = []
    for head in sorted(heads):
        tails = heads[head]
        rest = _factored(tails)
        parts.append((head, head, java_quote(head) + rest + ("?" if rest and "" in tails else "")))
    return _grouped(parts, "(?:{})", "|") if parts else ""


def key_pattern(keys: Iterable[str]) -> str | None:
    """Pattern for "leftmost, and there the first key in order" over literal keys."""
    kept: list[str] = []
    seen: set[str] = set()
    for key in keys:
        # A key that starts with an earlier key can never win.
        if key and not any(key[:n] in seen for n in range(1, len(key) + 1)):
            kept.append(key)
            seen.add(key)
    # Among the kept keys a longer one always comes before its own prefixes, so
    # the longest match is the first match.  First characters go ahead: most
    # positions are rejected by them.
    return f"(?={char_class(key[0] for key in kept)}){_factored(kept)}" if kept else None


def dict_replace(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Simultaneous literal replacement: leftmost match, first key in order."""
    table = {key: value for key, value in pairs if key}
    if not table:
        return c
    if all(len(key) == 1 and len(value) <= 1 for key, value in table.items()):
        kept = sorted(table, key=lambda key: not table[key])
        # Characters without a partner, at the end, are dropped.
        return F.translate(c, "".join(kept), "".join(table[key] for key in kept))
    held = table if len(table) <= FEW else {key[0] for key in table}
    return where_held(c, held, lambda text: rewrite_matches(text, key_pattern(table), literal_lookup(table)))


def literal_lookup(table: Mapping[str, str]) -> Callable[[Column], Column]:
    """Look a key up in a literal: slots by checksum, a few entries in each."""
    slots: list[dict[str, str]] = [{} for _ in range(max(1, len(table) // 2))]
    for key, value in table.items():
        slots[zlib.crc32(key.encode()) % len(slots)][key] = value
    # One literal, which the optimizer folds; a call per entry would take seconds.
    text = json.dumps(slots, ensure_ascii=False)
    literal = F.from_json(F.lit(text), "array<map<string,string>>")
    return lambda hit: F.element_at(F.get(literal, (F.crc32(hit) % len(slots)).cast("int")), hit)


def squeeze(
    c: Column,
    chars: str = ".",
    min_run: int = 3,
    keep: int = 2,
    not_after: str | None = None,
) -> Column:
    """Cut runs of one character: ``min_run`` or more become ``keep``.

    ``chars`` is a one-character pattern; a run does not start right after
    ``not_after``.
    """
    # The repetition is tested first: it fails at once almost everywhere.
    first = "(.)(?=\\1)" if chars == "." else "((?s:.))(?=\\1)"
    member = "" if chars == "." else f"(?<={chars})"
    guard = f"(?<!{not_after}(?s:.))" if not_after else ""
    pattern = f"{JAVA_FLAGS}{first}(?=\\1{{{min_run - 1}}}){member}{guard}\\1+"
    return F.regexp_replace(c, pattern, "$1" * keep)


def collapse_tag(c: Column, tag: str) -> Column:
    """A run of the same tag, with any white space after each, becomes one tag."""
    # Possessive: iterative in Java, so very long runs cannot exhaust the stack.
    pattern = java_pattern(rf"(?:{java_quote(tag)}\s*+)++")
    return F.regexp_replace(c, pattern, java_literal(tag))


def sort_chars(c: Column, order: str) -> Column:
    """Characters of ``order`` found in ``c``, sorted by their place in ``order``."""
    return let(
        c,
        lambda text: F.concat(
            *[
                F.repeat(F.lit(ch), F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit(""))))
                for ch in order
            ]
        ),
    )


_REWRITES: dict[str, Callable[[Column], Column]] = {
    "upper": F.upper,
    "lower": F.lower,
    "drop_spaces": lambda hit: F.regexp_replace(hit, java_pattern(r"\s+"), ""),
    "first_char": lambda hit: F.substring(hit, 1, 1),
}


def register_rewrite(name: str, fn: Callable[[Column], Column]) -> None:
    """Make ``fn`` (match column -> text column) available to rules by ``name``."""
    _REWRITES[name] = fn


def rewrite_named(c: Column, pattern: str, name: str) -> Column:
    """``rewrite_matches`` with a registered function."""
    if name not in _REWRITES:
        raise KeyError(f"no rewrite function registered under {name!r}")
    return rewrite_matches(c, java_pattern(pattern), _REWRITES[name])
