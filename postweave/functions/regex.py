"""Python ``re`` patterns as the Java patterns that Spark runs, with Python's meaning.

Word characters, digits and white space are Python's: letters, all numbers and ``_``, no
marks; decimal digits; also U+001C-1F.  Java's own Unicode classes differ in all
three.  Escapes that only Java has (``\\G``, ``\\p{..}``, ``\\x{..}``, ``\\z``) pass through.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import product

# ``.`` and ``$`` know "\n" as the only line end.
JAVA_FLAGS = "(?d)"

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SETS = {"w": WORD, "d": DIGIT, "s": SPACE}
_ASCII = {"w": "a-zA-Z0-9_", "d": "0-9", "s": r"\t-\r "}

_COUNT = re.compile(r"\{(\d*)(?:(,)(\d*))?\}")
_FLAGS = re.compile(r"\(\?([aiLmsux]*)(?:-([imsx]+))?([:)])")
_NAME = re.compile(r"\(\?P<(\w+)>|\(\?P=(\w+)\)|\(\?<(?![=!])(\w+)>")


# A digit, a word character or a plain letter that is there at least once.
_WORD_AHEAD = re.compile(r"(?:\\[dw]|[A-Za-z0-9_])(?![*?]|\{0|\{,)")
_WORD_BEHIND = re.compile(r"(?<!\\)\\[dw](?:\+|\{[1-9]\d*(?:,\d*)?\})?\Z")


def required_literal(pattern: str) -> str | None:
    """Characters that every match of ``pattern`` holds, side by side; None if none are sure.

    Only what stands outside groups, classes and alternatives is looked at.
    """
    if "|" in pattern or pattern.startswith("(?"):
        return None
    runs, depth, at = [""], 0, 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "[":
            closed = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]", re.S).match(pattern, at)
            if not closed:
                return None
            at = closed.end()
            runs.append("")
            continue
        literal = ch if ch not in "\\()[]{}*+?.^$" else None
        size = 1
        if ch == "\\":
            size = 2
            following = pattern[at + 1 : at + 2]
            literal = following if following and not following.isalnum() else None
        depth += (ch == "(") - (ch == ")")
        after = pattern[at + size : at + size + 1]
        counted = _COUNT.match(pattern, at) if ch == "{" else None
        if counted:
            size = len(counted[0])
        if literal and not depth and after not in ("*", "?", "{"):
            runs[-1] += literal
        else:
            runs.append("")
        if after == "+":
            runs.append("")
        at += size
    best = max(runs, key=lambda run: (sum(not c.isalnum() and c != " " for c in run), len(run)))
    return best or None


_ALTERNATIVES = re.compile(r"\(\?:((?:[^()\[\]\\]|\[[^\[\]\\^][^\[\]\\]*\])*)\)\+?|((?:[^()\[\]\\]|\[[^\[\]\\^][^\[\]\\]*\])*)")
# Not i, k and s: other letters are equal to these where case is ignored.
_CASED = "abcdefghjlmnopqrtuvwxyzABCDEFGHJLMNOPQRTUVWXYZ"
_ONE_CLASS = re.compile(r"\[([^\[\]\\^&-][^\[\]\\&-]*)\](?:\+|\{[1-9]\d*(?:,\d*)?\})?")


def required_texts(pattern: str) -> list[str] | None:
    """Texts one of which every match of ``pattern`` holds; None if none are sure.

    Beyond ``required_literal``: plain alternatives, classes of listed characters, and ``(?i)``
    ahead of letters that only their own capital is equal to.
    """
    if pattern.startswith("(?i)"):
        # Few letters, as each doubles the ways to write them.
        ends = [text[-3:] for text in required_texts(pattern[4:]) or []]
        if not ends or not all(ch in _CASED or ch.lower() == ch.upper() for ch in "".join(ends)):
            return None
        return ["".join(way) for end in ends for way in product(*[sorted({ch.lower(), ch.upper()}) for ch in end])]
    one = required_literal(pattern)
    if one is not None:
        return [one]
    found = _ALTERNATIVES.fullmatch(pattern)
    if not found:
        return None
    held: list[str] = []
    for part in (found[1] if found[1] is not None else found[2]).split("|"):
        listed = _ONE_CLASS.fullmatch(part)
        literal = required_literal(part)
        if listed:
            held += listed[1]
        elif literal is not None and "[" not in part:
            held.append(literal)
        else:
            return None
    return held


def java_pattern(pattern: str) -> str:
    """``pattern`` in Java syntax with the same meaning; ValueError for what Java lacks."""
    return JAVA_FLAGS + _Translation(pattern).run()


class _Translation:
    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        self.names: dict[str, str] = {}
        self.sets = _SETS

    def run(self) -> str:
        while self.at < len(self.text):
            ch = self.text[self.at]
            if ch == "\\":
                self.out.append(self.escape())
            elif ch == "[":
                self.out.append(self.char_class())
            elif ch == "(":
                self.out.append(self.group())
            elif ch == "{":
                self.out.append(self.count())
            else:
                self.out.append("\\}" if ch == "}" else ch)
                self.at += 1
        return "".join(self.out)

    def java_name(self, name: str) -> str:
        return self.names.setdefault(name, f"g{len(self.names)}x")

    def group(self) -> str:
        if found := _NAME.match(self.text, self.at):
            self.at = found.end()
            if found[2]:
                return rf"\k<{self.java_name(found[2])}>"
            return f"(?<{self.java_name(found[1] or found[3])}>"
        if self.text.startswith("(?#", self.at):
            self.at = self.text.index(")", self.at) + 1
            return ""
        if self.text.startswith("(?(", self.at):
            raise ValueError(f"no conditional groups: {self.text!r}")
        if found := _FLAGS.match(self.text, self.at):
            self.at = found.end()
            on, off, end = found.groups()
            if "L" in on:
                raise ValueError(f"no locale patterns: {self.text!r}")
            if "a" in on:
                self.sets = _ASCII
            java = "".join(f for f in on if f in "imsx")
            # Python ignores the case of all letters.
            java += "u" if "i" in java and self.sets is _SETS else ""
            if not java and not off:
                return "" if end == ")" else "(?:"
            return f"(?{java}{'-' + off if off else ''}{end}"
        self.at += 1
        return "("

    def count(self) -> str:
        found = _COUNT.match(self.text, self.at)
        if not found or (not found[1] and not found[2]):
            self.at += 1
            return "\\{"
        self.at = found.end()
        return "{" + (found[1] or "0") + (found[2] or "") + (found[3] or "") + "}"

    def escape(self) -> str:
        """An escape outside a class."""
        ch = self.text[self.at + 1 : self.at + 2]
        word = self.sets["w"]
        if ch == "b":
            # Beside what is sure to be a word character, one look is enough.
            if _WORD_AHEAD.match(self.text, self.at + 2):
                self.at += 2
                return f"(?<![{word}])"
            if _WORD_BEHIND.search(self.text, 0, self.at):
                self.at += 2
                return f"(?![{word}])"
        simple = {
            "Z": r"\z",
            "b": f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))",
            "B": f"(?:(?<=[{word}])(?=[{word}])|(?<![{word}])(?![{word}]))",
        }
        if ch in simple or (ch and ch in "wdsWDS"):
            self.at += 2
            if ch in simple:
                return simple[ch]
            return f"[{'^' if ch.isupper() else ''}{self.sets[ch.lower()]}]"
        return self.character()

    def character(self) -> str:
        """An escape that stands for one character, or one that Java shares."""
        rest = self.text[self.at :]
        if found := re.match(r"\\N\{([^}]+)\}", rest):
            self.at += found.end()
            return f"\\x{{{ord(unicodedata.lookup(found[1])):X}}}"
        if found := re.match(r"\\U([0-9a-fA-F]{8})", rest):
            self.at += found.end()
            return f"\\x{{{int(found[1], 16):X}}}"
        if found := re.match(r"\\(0[0-7]{0,2}|[1-3][0-7]{2})", rest):
            self.at += found.end()
            return f"\\x{{{int(found[1], 8):X}}}"
        if rest.startswith("\\v"):
            self.at += 2
            return r"\x0B"
        if found := re.match(r"\\[pPx]\{[^}]*\}|\\u[0-9a-fA-F]{4}|\\.", rest, re.S):
            self.at += found.end()
            return found[0]
        raise ValueError(f"pattern ends in an escape: {self.text!r}")

    def char_class(self) -> str:
        start, self.at = self.at, self.at + 1
        negated = self.text[self.at : self.at + 1] == "^"
        self.at += negated
        items: list[str] = []
        without: list[str] = []
        first = True
        while True:
            ch = self.text[self.at : self.at + 1]
            if not ch:
                raise ValueError(f"open class at {start}: {self.text!r}")
            if ch == "]" and not first:
                self.at += 1
                break
            first = False
            after = self.text[self.at + 1 : self.at + 2]
            if ch == "\\" and after and after in "wds":
                items.append(self.sets[after])
                self.at += 2
            elif ch == "\\" and after and after in "WDS":
                without.append(f"[^{self.sets[after.lower()]}]")
                self.at += 2
            elif ch == "\\" and after == "b":
                items.append(r"\x08")
                self.at += 2
            elif ch == "\\":
                items.append(self.character())
            else:
                # What has a meaning in Java's classes only.
                items.append("\\" + ch if ch in "[]&^" else ch)
                self.at += 1
        inside = "".join(items)
        if not without:
            return f"[{'^' if negated else ''}{inside}]"
        either = "|".join(without)
        if negated:
            return f"(?:(?!{either}){f'[^{inside}]' if inside else '(?s:.)'})"
        return f"(?:{f'[{inside}]|' if inside else ''}{either})"
