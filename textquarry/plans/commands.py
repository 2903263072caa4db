"""Command-style front-ends: arguments to specifications, specifications to what a terminal shows.

What can't be served gives exit code 200, so that a caller may run the real tool. The DataFrame
API is the primary one; here results are collected for display, within max_results lines, beyond
which stderr says so.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.corpus import Corpus
from textquarry.functions.patterns import Matcher, PatternError, glob
from textquarry.operators import find as finding
from textquarry.operators import search as s
from textquarry.operators.lsa import semantic_search
from textquarry.plans import render
from textquarry.plans.flags import ACCEPTED, TYPES, kind, long_name
from textquarry.sources.extract import ExtractError, extract
from textquarry.sources.filetree import files

FALLBACK = 200
MAX_RESULTS = 100_000


@dataclass(frozen=True)
class Response:
    exit_code: int
    stdout: str = ""
    stderr: str = ""


def fallback(reason: str) -> Response:
    return Response(FALLBACK, "", f"FALLBACK: {reason}")


@dataclass
class SearchArgs:
    """A parsed line search. output: text, json, count or files."""

    pattern: str = ""
    paths: list[str] = field(default_factory=list)
    json: bool = False
    count: bool = False
    files: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    line_numbers: bool = False
    fixed: bool = False
    word: bool = False
    multiline: bool = False
    dotall: bool = False
    filename: bool = True
    before: int = 0
    after: int = 0
    glob: str | None = None
    type: str | None = None
    max_count: int | None = None
    include: str | None = None
    bm25: str = "off"
    semantic: bool = False

    @property
    def spec(self) -> s.SearchSpec:
        return s.SearchSpec((self.pattern,), not self.fixed, self.ignore_case, self.word, self.before, self.after, None, self.max_count, self.smart_case, self.bm25, None, self.include)


def _number(value: str) -> int:
    return int(value) if value.isdecimal() else 0


def _scoring(args: SearchArgs, arg: str) -> bool:
    if arg == "--semantic":
        args.semantic = True
    elif arg == "--bm25" or arg.startswith("--bm25="):
        args.bm25 = "full" if arg == "--bm25=full" else "tf"
    else:
        return False
    return True


def parse_rg(argv: list[str]) -> SearchArgs | None:
    """The arguments after the command's name; None where a flag isn't one that is served. The first positional is the pattern, the second the path, others don't count."""
    out, positional, context, rest = SearchArgs(), [], 0, list(argv)
    while rest:
        arg = rest.pop(0)
        if arg == "--":
            positional += rest
            break
        if not arg.startswith("-"):
            positional.append(arg)
            continue
        if _scoring(out, arg):
            continue
        what = kind(arg)
        flag, equals, value = arg.partition("=")
        name = long_name(flag)
        if what == "value" and not equals:
            if not rest:
                return None
            value = rest.pop(0)
        if what is None or name not in ACCEPTED:
            return None
        match name:
            case "json" | "count":
                setattr(out, name, True)
            case "files-with-matches":
                out.files = True
            case "ignore-case" | "case-sensitive":
                out.ignore_case, out.smart_case = name == "ignore-case", False
            case "smart-case":
                out.smart_case = True
            case "line-number" | "no-line-number":
                out.line_numbers = name == "line-number"
            case "fixed-strings":
                out.fixed = True
            case "multiline" | "multiline-dotall":
                out.multiline, out.dotall = True, out.dotall or name == "multiline-dotall"
            case "context":
                context = _number(value)
            case "before-context":
                out.before = _number(value)
            case "after-context":
                out.after = _number(value)
            case "glob" | "type":
                setattr(out, name, value)
            case "max-count":
                out.max_count = _number(value)
    if not positional:
        return None
    out.pattern, out.paths = positional[0], positional[1:2] or ["."]
    if context:
        out.before = out.after = context
    return out


_grep = {
    "n": "line_numbers", "line-number": "line_numbers", "i": "ignore_case", "ignore-case": "ignore_case", "l": "files", "files-with-matches": "files", "c": "count", "count": "count",
    "w": "word", "word-regexp": "word", "F": "fixed", "fixed-strings": "fixed", "r": None, "R": None, "recursive": None, "H": None, "h": "no", "no-filename": "no",
}


def parse_grep(argv: list[str]) -> SearchArgs | None:
    """As parse_rg; short flags may be joined, all positionals after the pattern are paths, and the search is always recursive."""
    out, positional, rest = SearchArgs(), [], list(argv)
    while rest:
        arg = rest.pop(0)
        if arg == "--":
            positional += rest
            break
        if _scoring(out, arg):
            continue
        if arg == "--include" or arg.startswith("--include="):
            if arg == "--include" and not rest:
                return None
            out.include = rest.pop(0) if arg == "--include" else arg[10:]
        elif arg.startswith("-") and len(arg) > 1:
            for name in [arg[2:]] if arg.startswith("--") else arg[1:]:
                if name not in _grep or arg.startswith("--") and len(name) == 1:
                    return None
                if name in ("H", "h", "no-filename"):
                    out.filename = name == "H"
                elif _grep[name]:
                    setattr(out, _grep[name], True)
        else:
            positional.append(arg)
    if not positional:
        return None
    out.pattern, out.paths = positional[0], positional[1:] or ["."]
    return out


def parse_find(argv: list[str]) -> dict | None:
    """argument, name, iname, path and entry_type of a file search by globs."""
    rest = list(argv)
    out: dict = {"argument": rest.pop(0) if rest and not rest[0].startswith("-") and rest[0] not in ("(", "!") else "."}
    names = {"-name": "name", "-iname": "iname", "-path": "path", "-type": "entry_type"}
    while rest:
        flag = rest.pop(0)
        if flag not in names or not rest:
            return None
        out[names[flag]] = rest.pop(0)
    return _typed(out)


def _typed(out: dict) -> dict | None:
    t = out.get("entry_type")
    if t is not None:
        out["entry_type"] = {"f": "f", "file": "f", "d": "d", "directory": "d"}.get(t)
    return None if t is not None and out["entry_type"] is None else out


def parse_fd(argv: list[str]) -> dict | None:
    """argument, pattern, ext, entry_type, ignore_case and fixed of a file search by a pattern of names."""
    out: dict = {"argument": "."}
    positional, rest = [], list(argv)
    while rest:
        arg = rest.pop(0)
        if arg in ("-e", "--extension", "-t", "--type"):
            if not rest:
                return None
            out["ext" if arg in ("-e", "--extension") else "entry_type"] = rest.pop(0)
        elif arg in ("-i", "--ignore-case", "-F", "--fixed-strings"):
            out["ignore_case" if arg in ("-i", "--ignore-case") else "fixed"] = True
        elif arg.startswith("-"):
            return None
        else:
            positional.append(arg)
    if positional:
        out["pattern"] = positional[0]
    if len(positional) > 1:
        out["argument"] = positional[1]
    return _typed(out)


_newline = re.compile(r"\n|\\[nsrSWDNPHVRXx0-9]|\[\^|\[\[:|\(\?[a-z]*s")


def _spans_lines(args: SearchArgs) -> bool:
    """Whether a multi-line pattern may match a line feed; such a search isn't served."""
    return "\n" in args.pattern if args.fixed else bool(_newline.search(args.pattern)) or args.dotall and "." in args.pattern


def _missing(command: str, path: str, code: int) -> Response:
    return Response(code, "", f"{command}: {path}: No such file or directory")


def _limited(corpus: Corpus, args: SearchArgs) -> Corpus:
    """The corpus without files that a glob or a type leaves out; their sizes count no more."""
    docs, name = corpus.docs, s.name_of(F.col("path"))
    if args.glob is not None:
        negated, pattern = args.glob.startswith("!"), args.glob.removeprefix("!")
        hit = glob(F.col("path"), "*/" + pattern.lstrip("/")) if "/" in pattern else glob(name, pattern)
        docs = docs.where(~hit if negated else hit)
    if args.type is not None:
        hit = F.lit(False)
        for pattern in TYPES.get(args.type, ()):
            hit |= glob(name, pattern)
        docs = docs.where(hit)
    return replace(corpus, docs=docs)


def _shown(df: DataFrame, most: int, *order: str) -> tuple[str, str]:
    """What goes to stdout and to stderr."""
    rows = df.orderBy(*order).limit(most + 1).select("line").collect()
    return "".join(r.line + "\n" for r in rows[:most]), f"output ends after {most} results\n" if len(rows) > most else ""


def _line_search(spark: SparkSession, command: str, args: SearchArgs, cwd: str, cache, most: int) -> Response:
    try:
        _ = args.spec.matcher
    except PatternError as e:
        return Response(2, "", f"{command}: {e}")
    if args.type is not None and args.type not in TYPES:
        return Response(2, "", f"{command}: unrecognized file type: {args.type}")
    corpora = []
    for p in args.paths:
        path = os.path.join(cwd, p)
        if not os.path.exists(path):
            return _missing(command, p, 2)
        corpus = Corpus.from_path(spark, path, cache)
        if corpus.single_file:
            error = corpus.docs.first().extract_error
            if error is not None:
                return Response(2, "", f"{command}: {path}: {error}")
        corpora.append(_limited(corpus, args))
    if args.semantic and not all(c.single_file for c in corpora):  # one file has nothing to be ranked against
        rows = [r.asDict() for c in corpora for r in semantic_search(c, args.pattern).collect()]
        if not rows:
            return Response(1, "", f"No semantically relevant files found for '{args.pattern}'. Try more specific terms or leave --semantic out.\n")
        return Response(0, render.semantic_text(rows))
    spec = args.spec
    number = lambda df, k: df.withColumn("k", F.lit(k))
    if args.count and not args.json and not (command == "grep" and args.files):
        found = s.union([s.counts(c, spec) for c in corpora]).groupBy("path").agg(F.sum("n").alias("n"))
        out, err = _shown(found.select("path", F.concat_ws(":", *([F.col("path")] if args.filename else []), F.col("n").cast("string")).alias("line")), most, "path")
    elif args.files and not args.json:
        found = s.union([s.paths_with_matches(c, spec) for c in corpora]).distinct()
        out, err = _shown(found.select("path", F.col("path").alias("line")), most, "path")
    else:
        found = s.union([number(s.search(c, spec), k) for k, c in enumerate(corpora)])
        shown = render.match_json(found.drop("k")) if args.json else render.match_text(found.drop("k"), args.line_numbers, args.filename)
        out, err = _shown(shown, most, "path", "line_number")
    return Response(0, out, err) if out else Response(1)


def _find(spark: SparkSession, command: str, args: dict, cwd: str) -> Response:
    argument = args.pop("argument")
    root = os.path.join(cwd, argument)
    if not os.path.exists(root):
        return _missing(command, argument, 1)
    tree, root = files(spark, root, gitignore=False), os.path.realpath(root)
    found = finding.find(tree, root, argument, **args) if command == "find" else finding.fd(tree, root, **args)
    out = "".join(r.display + "\n" for r in finding.ordered(found).select("display").collect())
    return Response(0 if out or command == "find" else 1, out)


def _cat(args: list[str], cwd: str) -> Response:
    numbers, names = False, []
    for a in args:
        if a in ("-n", "--number"):
            numbers = True
        elif a.startswith("-"):
            return fallback(f"unsupported cat flag: {a}")
        else:
            names.append(a)
    if not names or any(n.startswith(("/dev/", "/proc/")) for n in names):
        return fallback("cat: no file that can be served")
    out = []
    for n in names:
        try:
            with open(os.path.join(cwd, n), "rb") as f:
                text = extract(os.path.basename(n), f.read())
        except (OSError, ExtractError) as e:
            return Response(1, "".join(out), f"cat: {n}: {e.strerror if isinstance(e, OSError) else e}\n")
        lines = text.replace("\r\n", "\n").removesuffix("\n").split("\n") if text else []
        out += [f"     {i}\t{x}\n" for i, x in enumerate(lines, 1)] if numbers else [text]
    return Response(0, "".join(out))


def dispatch(spark: SparkSession, command: str, args: list[str], cwd: str = ".", cache=None, max_results: int = MAX_RESULTS) -> Response:
    """Runs rg, grep, find, fd, cat or search (pattern, path and --semantic alone) with its arguments."""
    cwd = os.path.abspath(cwd)
    if command in ("rg", "grep"):
        parsed = parse_rg(args) if command == "rg" else parse_grep(args)
        if parsed is None or parsed.multiline and _spans_lines(parsed):
            return fallback(f"unsupported {command} flags")
        return _line_search(spark, command, parsed, cwd, cache, max_results)
    if command == "search":
        names = [a for a in args if a != "--semantic"]
        if not 1 <= len(names) <= 2 or any(n.startswith("-") for n in names):
            return Response(2, "", "usage: search <pattern> [path] [--semantic]\n")
        parsed = SearchArgs(names[0], names[1:] or ["."], line_numbers=True, semantic="--semantic" in args)
        return _line_search(spark, "search", parsed, cwd, cache, max_results)
    if command in ("find", "fd"):
        own = parse_find(args) if command == "find" else parse_fd(args)
        if own is None:
            return fallback(f"unsupported {command} flags")
        if command == "fd" and own.get("pattern") is not None and not own.get("fixed"):
            try:
                Matcher((own["pattern"],))
            except PatternError:
                return fallback("fd: invalid pattern")
        return _find(spark, command, own, cwd)
    return _cat(args, cwd) if command == "cat" else fallback(f"unknown command: {command}")


