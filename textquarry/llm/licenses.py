"""Fuzzy search for short licence notices.

A notice may differ by up to k edits. Cut into k + 1 pieces, at least one piece must occur
unchanged (pigeonhole), so one automaton over all pieces finds every place where a notice can
be; the regex library's bounded-error matching then verifies the window around it. White space,
line breaks and the marks that start a comment's lines count as one space, so that wrapped notices are found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textquarry.llm.common import map_slices

#: (licence, notice). Matched without regard to case.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms"),
    ("LGPL", "GNU Lesser General Public License"),
    ("AGPL", "GNU Affero General Public License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("proprietary", "All rights reserved"),
    ("SPDX", "SPDX-License-Identifier:"),
)
#: The notice whose licence is the identifier that follows it.
TAG = "SPDX"
#: Characters of a notice for each edit that it may differ by.
CHARS_PER_EDIT = 12


def folded(text: str) -> str:
    """Lower case of the same length: characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


_gap = re.compile(r"[^\S\n]*\n\s*(?:(?:/\*+|\*+/?|//+|#+|;+|%+|--+|\|+|>+)[^\S\n]*(?:\n\s*)?)*|[^\S\n]{2,}|[^\S\n ]")
_identifier = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9.+-]*)").match


def spaced(low: str) -> str:
    """Each run of white space, with the marks that start comment lines in it, as one space."""
    return _gap.sub(" ", low)


def places(low: str) -> Callable[[int], int]:
    """Where a place of spaced(low) lies in low: a gap's is its end."""
    at, shift = [0], [0]
    for m in _gap.finditer(low):
        shift.append(shift[-1] + len(m[0]) - 1)
        at.append(m.end() - shift[-1])
    return lambda i: i + shift[bisect_right(at, i) - 1]


class Scanner:
    def __init__(self, notices: Iterable[tuple[str, str]] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.notices = [(name, folded(n), len(n) // chars_per_edit) for name, n in notices]
        self.patterns = [regex.compile(rf"(?e)(?:{regex.escape(n)}){{e<={k}}}") for _, n, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, notice, k) in enumerate(self.notices):
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds[notice[a:b]].append((i, a))
        self.automaton = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """(licence, start, end, edits) of each place, in order; of notices that overlap, the one with the fewest edits stays, then the longer one, then the one listed first."""
        whole = folded(text)
        low = spaced(whole)
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(low):
            for i, offset in where:
                _, notice, k = self.notices[i]
                start = end - size + 1 - offset
                lo, hi = max(0, start - k), min(len(low), start + len(notice) + k)
                if (own := windows[i]) and lo <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        found = []
        for i, own in windows.items():
            size = len(self.notices[i][1])
            for lo, hi in own:
                for m in self.patterns[i].finditer(low, lo, hi):
                    found.append((sum(m.fuzzy_counts), -size, i, m.start(), m.end()))
        chosen: list[tuple[int, int, int, int]] = []
        for edits, _, i, start, end in sorted(found):
            if all(end <= a or start >= b for a, b, _, _ in chosen):
                chosen.append((start, end, i, edits))
        if not chosen:
            return []
        place, out = places(whole), []
        for a, b, i, edits in sorted(chosen):
            # neither end lies in a gap
            while a < b and low[a] == " ":
                a += 1
            name, start, end = self.notices[i][0], place(a), place(b - 1) + 1
            if name == TAG and (m := _identifier(text, end)):
                name, end = m[1], m.end()
            out.append((name, start, end, edits))
        return out


def licenses(docs: DataFrame, notices: Iterable[tuple[str, str]] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(doc_id, license, start, end, edits, matched): a row for each notice found; start and end count characters from 0.

    Null and empty texts, and texts without a notice, have no row; an empty table gives an
    empty one. A repeated row is reported as often as it occurs, a null id stays null. Whole
    texts are searched at any length. Of notices that overlap the one with the fewest edits stays,
    of ties the longer, then the one listed first. Other columns are ignored whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tuple(notices), chars_per_edit))
    scanners: dict[int, Scanner] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = scanners.get(0) or scanners.setdefault(0, Scanner(*shared.value))
        at, rows = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for name, a, b, edits in scanner.scan(text) if text else ():
                at.append(i)
                rows.append((name, a, b, edits, text[a:b]))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "license", "start", "end", "edits", "matched"])

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, license string, start int, end int, edits int, matched string")
