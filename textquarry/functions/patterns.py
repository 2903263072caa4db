"""Search patterns as Spark columns.

Regular expressions are written in the syntax of linear-time engines (no look-around, no
back-references) and run by Java's; translate() bridges what differs: Unicode classes and case
folding, what a dot and a dollar match, POSIX classes, group names.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex as python_regex
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<offset:bigint,pattern_index:int,length:bigint>>"
_posix = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}


class PatternError(ValueError):
    """A pattern that the syntax doesn't allow."""


def _class(p: str, i: int) -> tuple[str, int]:
    """The Java form of the class that starts at p[i] == '[', and the place after it."""
    out, i, start = "[", i + 1, True
    while i < len(p):
        c = p[i]
        if c == "^" and out == "[":
            out, i = out + "^", i + 1
            continue
        if c == "]" and not start:
            return out + "]", i + 1
        if m := re.match(r"\[:(\^?)(\w+):\]", p[i:]):
            if m[2] not in _posix:
                raise PatternError(f"unknown class [:{m[2]}:]")
            out, i = out + (f"[^{_posix[m[2]]}]" if m[1] else _posix[m[2]]), i + m.end()
        elif c == "[":
            inner, i = _class(p, i)
            out += inner
        elif c == "\\":
            piece, i = _escape(p, i, True)
            out += piece
        elif p.startswith(("--", "~~"), i) and not start:
            raise PatternError("differences of classes aren't supported")
        elif c == "]" or (c == "&" and p[i + 1 : i + 2] != "&" and out[-1] != "&"):
            out, i = out + "\\" + c, i + 1
        else:
            out, i = out + c, i + 1
        start = False
    raise PatternError("unclosed character class")


def _escape(p: str, i: int, inside: bool) -> tuple[str, int]:
    if i + 1 >= len(p):
        raise PatternError("a backslash ends the pattern")
    c = p[i + 1]
    if m := re.match(r"\\[uUx]\{([0-9A-Fa-f]+)\}|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", p[i:]):
        return "\\x{" + next(x for x in m.groups() if x) + "}", i + m.end()
    if c in "pP":
        m = re.match(r"\\[pP](\{\^?([\w=: -]+)\}|[A-Za-z])", p[i:])
        if not m:
            raise PatternError("unfinished property")
        name = re.split("[=:]", m[2] or m[1])[-1].strip().replace(" ", "_")
        negated = (c == "P") != m[1].startswith("{^")
        kind = name if len(name) <= 2 else f"Is{name}"
        return ("\\P{" if negated else "\\p{") + kind + "}", i + m.end()
    if not inside:
        for mark, java in (("b{start}", r"\b(?=\w)"), ("b{end}", r"\b(?<=\w)"), ("<", r"\b(?=\w)"), (">", r"\b(?<=\w)")):
            if p.startswith(mark, i + 1):
                return java, i + 1 + len(mark)
        if c in "bBAz":
            return "\\" + c, i + 2
    if c in "dDsSwWnrtafv":
        return ("\\x0B" if c == "v" else "\\" + c), i + 2
    if c.isalnum():
        raise PatternError(f"unknown escape \\{c}")
    return re.escape(c) if c in "<>" else "\\" + c, i + 2


def translate(pattern: str, lines: bool = False) -> str:
    """The Java regular expression, without flags, for a pattern. lines: ^ and $ hold at every line of a text."""
    out, i, depth, quantified = [], 0, 0, False
    multi = lines or re.search(r"\(\?[a-z]*m", pattern) is not None
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            piece, i = _escape(pattern, i, False)
            out.append(piece)
            quantified = False
            continue
        if c == "[":
            piece, i = _class(pattern, i)
            out.append(piece)
            quantified = False
            continue
        if c == "(":
            depth += 1
            rest = pattern[i:]
            if m := re.match(r"\(\?P?<([A-Za-z_][\w.\[\]]*)>", rest):
                out.append("(")
                i += m.end()
            elif m := re.match(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?(\)|:)", rest):
                on, off = m[1].replace("u", ""), m[2] or ""
                if set(on + off) - set("imsx"):
                    raise PatternError(f"unsupported flags in {m[0]}")
                depth -= m[3] == ")"
                flags = on + ("-" + off if off else "")
                out.append("" if not flags and m[3] == ")" else f"(?{flags}{m[3]}")
                i += m.end()
            elif rest.startswith("(?"):
                raise PatternError("look-around isn't supported")
            else:
                out.append("(")
                i += 1
            quantified = False
            continue
        if c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unopened group")
        if c in "*+?{":
            if c == "{":
                m = re.match(r"\{(\d*)(,?)(\d*)\}", pattern[i:])
                if not m or not (m[1] or m[3]):
                    raise PatternError("bad repetition")
                if m[3] and int(m[1] or 0) > int(m[3]):
                    raise PatternError("bad repetition range")
                c, step = "{" + (m[1] or "0") + m[2] + m[3] + "}", m.end()
            else:
                step = 1
            before = "".join(out)
            if not before or before.endswith(("(", "|", "(?:")) and not before.endswith(("\\(", "\\|")):
                raise PatternError("nothing to repeat")
            if quantified and c != "?":
                raise PatternError("repeated repetition")
            out.append(c)
            quantified, i = not quantified or c != "?", i + step
            continue
        out.append(r"\z" if c == "$" and not multi else c)
        quantified, i = False, i + 1
    if depth:
        raise PatternError("unclosed group")
    return "".join(out)


_meta = re.compile(r"[\\.+*?()|\[\]{}^$#&~-]")
_anchored = re.compile(r"\\[AzbB]|[\^$]|\(\?[a-z]*m")


def escape(text: str) -> str:
    """text as a pattern that matches just it."""
    return _meta.sub(lambda m: "\\" + m[0], text)


@dataclass(frozen=True)
class Matcher:
    """One or more patterns of which any may match. Literals fold ASCII case only, regular expressions Unicode case."""

    patterns: tuple[str, ...]
    regex: bool = True
    ignore_case: bool = False

    def __post_init__(self) -> None:
        if self.regex:
            self.java  # raises on what the syntax doesn't allow  # noqa: B018

    @property
    def literal(self) -> bool:
        """Whether a plain substring search does."""
        return not self.regex or not self.ignore_case and not any(_meta.search(p) for p in self.patterns)

    def _joined(self, lines: bool) -> str:
        own = [translate(p, lines) for p in self.patterns]
        flags = "(?" + ("i" if self.ignore_case else "") + ("m" if lines else "") + "dU)"
        return flags + (own[0] if len(own) == 1 else "|".join(f"(?:{p})" for p in own))

    @cached_property
    def java(self) -> str:
        return self._joined(False) if self.regex else ""

    @cached_property
    def anchored(self) -> bool:
        """Whether a line may match although the text that holds it doesn't."""
        return self.regex and any(_anchored.search(p.replace("\\b", "")) for p in self.patterns)

    def _folded(self, text: Column) -> tuple[Column, list[str]]:
        if not self.ignore_case:
            return text, list(self.patterns)
        return F.translate(text, UPPER, LOWER), [p.translate(str.maketrans(UPPER, LOWER)) for p in self.patterns]

    def matches(self, text: Column) -> Column:
        """Whether the string (a line, a name) matches."""
        if not self.literal:
            return text.rlike(self.java)
        folded, patterns = self._folded(text)
        out = F.lit(False)
        for n, p in enumerate(patterns):
            out = folded.contains(p) if n == 0 else out | folded.contains(p)
        return out

    def in_text(self, text: Column, strict: bool = False) -> Column:
        """Whether a whole text holds a match; ^ and $ hold at its lines, unless strict, where they hold at its ends alone."""
        if strict or not self.anchored:
            return self.matches(text)
        return F.replace(text, F.lit("\r\n"), F.lit("\n")).rlike(self._joined(True))

    def count(self, text: Column, strict: bool = False) -> Column:
        """Matches in a text that don't overlap, as a bigint."""
        if self.regex and not self.literal:
            if self.anchored and not strict:
                return F.regexp_count(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit(self._joined(True))).cast("bigint")
            return F.regexp_count(text, F.lit(self.java)).cast("bigint")
        if len(self.patterns) > 1:
            return F.size(self.spans(text)).cast("bigint")
        folded, (p,) = self._folded(text)
        if not p:
            return (F.octet_length(text) + 1).cast("bigint")
        return ((F.octet_length(folded) - F.octet_length(F.replace(folded, F.lit(p), F.lit("")))) / len(p.encode())).cast("bigint")

    def spans(self, text: Column) -> Column:
        """All matches that don't overlap: byte offset, number of the pattern (0 for regular expressions), length in bytes. Literals end as early as they can."""
        find = _spans(self)

        @F.arrow_udf(SPANS)
        def run(texts: pa.Array) -> pa.Array:
            begins, ends, indices, offsets = array("q"), array("q"), array("i"), array("i", [0])
            for t in texts:
                if t.is_valid:
                    for a, b, n in find(t.as_py()):
                        begins.append(a)
                        ends.append(b)
                        indices.append(n)
                offsets.append(len(begins))
            offset = np.frombuffer(begins, np.int64)
            found = pa.StructArray.from_arrays([pa.array(offset), pa.array(np.frombuffer(indices, np.int32)), pa.array(np.frombuffer(ends, np.int64) - offset)], names=["offset", "pattern_index", "length"])
            return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False)), found)

        return run(text)


def _spans(matcher: Matcher):
    """A function from a text to its matches as (from, to, pattern) in bytes."""
    patterns, ignore_case = matcher.patterns, matcher.ignore_case
    if matcher.regex:
        joined = "|".join(f"(?:{p})" for p in patterns)

        def find(text: str):
            compiled = python_regex.compile(joined, (python_regex.I if ignore_case else 0) | python_regex.V1)
            at, size = 0, 0
            for m in compiled.finditer(text):
                size += len(text[at : m.start()].encode())
                at, length = m.start(), len(m[0].encode())
                yield size, size + length, 0

        return find
    fold = bytes.maketrans(UPPER.encode(), LOWER.encode()) if ignore_case else bytes(range(256))
    raw = [p.encode().translate(fold) for p in patterns]

    def find(text: str):
        data, at = text.encode().translate(fold), 0
        while at <= len(data):
            found = [(data.find(p, at), n) for n, p in enumerate(raw)]
            found = [(a + len(raw[n]), -len(raw[n]), n, a) for a, n in found if a >= 0]
            if not found:
                return
            end, _, n, a = min(found)
            yield a, end, n
            at = end if end > a else end + 1

    return find


def word(pattern: str, literal: bool = False) -> str:
    """The pattern between word borders."""
    return rf"\b{escape(pattern)}\b" if literal else rf"\b(?:{pattern})\b"


def glob(name: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Shell pattern over the whole string: * any characters (slashes too), ? one character."""
    if ignore_case:
        name, pattern = F.lower(name), pattern.lower()
    parts = re.split(r"([*?])", pattern)
    return name.rlike(r"(?s)\A" + "".join({"*": ".*", "?": "."}.get(p, re.sub(r"([^\w\s])", r"\\\1", p)) for p in parts) + r"\z")


def simple_glob(name: Column, pattern: str) -> Column:
    """*mid* contains, *end, start*, else equality; other marks stand for themselves."""
    if len(pattern) > 2 and pattern[0] == pattern[-1] == "*":
        return name.contains(pattern[1:-1])
    if pattern.startswith("*"):
        return name.endswith(pattern[1:])
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern
