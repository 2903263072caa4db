"""Lines and tokens of texts."""

from __future__ import annotations

import re
from collections import Counter

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_breaks = r"[\p{IsWhite_Space}\p{Punct}]+"
# the next character is looked at first: most aren't upper case
_camel = r"(?=\p{IsUppercase})(?:(?<=[^\p{IsUppercase}\p{IsWhite_Space}\p{Punct}])|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase}))"


def lines(text: Column) -> Column:
    """The text's lines: cut at line feeds, one carriage return before each left out; a line feed at the end starts no line."""
    body = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    body = F.when(body.endswith("\n"), F.left(body, F.length(body) - 1)).otherwise(body)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def tokens(text: Column) -> Column:
    """Words in lower case: cut at white space and ASCII punctuation, and inside camelCase and ABCWord."""
    return F.filter(F.transform(F.split(text, f"{_breaks}|{_camel}"), F.lower), lambda t: t != "")


def plain_tokens(text: Column) -> Column:
    """Words in lower case, cut at white space and ASCII punctuation alone."""
    return F.filter(F.transform(F.split(text, _breaks), F.lower), lambda t: t != "")


#: Words whose parts a process keeps, up to so many and of so many characters.
KEPT, LONGEST = 200_000, 64
_parts: dict[str, tuple[str, ...]] = {}
_words = re.compile("[^\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000!-/:-@\\[-`{-~]+").findall
_inside = regex.compile(r"(?<=\P{Uppercase})(?=\p{Uppercase})|(?<=\p{Uppercase})(?=\p{Uppercase}\p{Lowercase})")


def _split(word: str) -> tuple[str, ...]:
    low = word.lower()
    if word.isascii() and word[1:] == low[1:]:
        return (low,)
    return tuple(p.lower() for p in _inside.sub("\n", word).split("\n"))


def token_counts(text: str) -> dict[str, int]:
    """How often each of the text's tokens() occurs, in a Python worker: distinct words are cut and folded once."""
    out: dict[str, int] = {}
    for word, n in Counter(_words(text)).items():
        parts = _parts.get(word)
        if parts is None:
            parts = _split(word)
            if len(word) <= LONGEST:
                if len(_parts) >= KEPT:
                    _parts.clear()
                _parts[word] = parts
        for p in parts:
            out[p] = out.get(p, 0) + n
    return out


def trimmed(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")
