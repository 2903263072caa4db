"""A directory tree as a relation of files, with or without ignore files.

The driver lists the tree (one metadata call an entry); executors open only files that later
filters keep. The tree must lie on a file system that all of them see.
"""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textquarry.schema import FILES

IGNORE_FILES = (".gitignore", ".ignore")
#: Entries of a partition and bytes of its files at most; a larger file is one of its own.
ENTRIES, BYTES = 5_000, 64 << 20


def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern of the path below the ignore file's folder, negated, directories alone) of one line."""
    line = line.rstrip("\n").rstrip("\r")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    only_dirs = line.endswith("/")
    line = line.rstrip("/") if only_dirs else line
    anchored = "/" in line
    line = line.lstrip("/") if anchored else line
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
            while line[i : i + 1] == "*":
                i += 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (m := re.match(r"\[([!^]?)(\]?[^\]]*)\]", line[i:])):
            out, i = out + "[" + ("^/" if m[1] else "") + m[2].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]") + "]", i + m.end()
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    try:
        return re.compile(out + r"\Z", re.S), negated, only_dirs
    except re.error:
        return None


class Ignore:
    """The rules of one folder's ignore files; later rules outweigh earlier ones, nearer folders farther ones."""

    def __init__(self, folder: str, outer: Ignore | None):
        self.folder, self.outer, self.rules = folder, outer, []
        for name in (".git/info/exclude", *IGNORE_FILES):
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    self.rules += [r for r in map(_rule, f) if r]
            except OSError:
                pass

    def ignores(self, path: str, is_dir: bool) -> bool:
        own = path[len(self.folder.rstrip("/")) + 1 :]
        for pattern, negated, only_dirs in reversed(self.rules):
            if (is_dir or not only_dirs) and pattern.match(own):
                return not negated
        return self.outer is not None and self.outer.ignores(path, is_dir)


def _inner(folder: str, outer: Ignore | None) -> Ignore | None:
    """The rules that hold in a folder; those around it where it has none."""
    own = Ignore(folder, outer)
    return own if own.rules else outer


def _outer(root: str) -> Ignore | None:
    out, parts = None, [root]
    while (up := os.path.dirname(parts[-1])) != parts[-1]:
        parts.append(up)
    for folder in reversed(parts[1:]):
        out = _inner(folder, out)
    return out


def walk(root: str, gitignore: bool = True) -> Iterator[tuple[str, str, int, datetime.datetime, bool]]:
    """(name, path, size, mtime, is_dir) of all below root, hidden entries too, root itself left out; links aren't followed. An unreadable folder is an error."""
    if os.path.isfile(root):
        at = os.stat(root)
        yield os.path.basename(root), root, at.st_size, datetime.datetime.fromtimestamp(at.st_mtime), False
        return
    stack = [(root, _outer(root) if gitignore else None)]
    while stack:
        folder, outer = stack.pop()
        rules = _inner(folder, outer) if gitignore else None
        with os.scandir(folder) as entries:
            for e in entries:
                is_dir = e.is_dir(follow_symlinks=False)
                if rules is not None and rules.ignores(e.path, is_dir):
                    continue
                at = e.stat(follow_symlinks=False)
                yield e.name, e.path, at.st_size, datetime.datetime.fromtimestamp(at.st_mtime), is_dir
                if is_dir:
                    stack.append((e.path, rules))


class _Entries(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.gitignore = os.path.realpath(options["path"]), options.get("gitignore", "true").lower() != "false"
        if not os.path.exists(self.root):
            raise FileNotFoundError(f"{options['path']}: No such file or directory")

    def partitions(self) -> list[InputPartition]:
        out, size = [_Entries([])], 0
        for row in walk(self.root, self.gitignore):
            own = 0 if row[4] else row[2]
            if out[-1].rows and (len(out[-1].rows) == ENTRIES or size + own > BYTES):
                out.append(_Entries([]))
                size = 0
            out[-1].rows.append(row)
            size += own
        return out

    def read(self, partition: _Entries) -> Iterator[tuple]:
        yield from partition.rows


class FileTree(DataSource):
    """spark.read.format("filetree").option("gitignore", "false").load(path), once registered."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self):
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def is_file(root: str) -> bool:
    return os.path.isfile(root)


def files(spark: SparkSession, root: str, gitignore: bool = True) -> DataFrame:
    """The file relation of a tree: name, path (absolute, links resolved up to the root), size, mtime, is_dir."""
    if not os.path.exists(root):
        raise FileNotFoundError(f"{root}: No such file or directory")
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("gitignore", str(gitignore).lower()).load(os.path.realpath(root))


def named(files: DataFrame, pattern: str) -> DataFrame:
    """Files (not directories) whose name matches a shell glob with *, ? and [classes]; none for a glob that isn't well-formed."""
    from pyspark.sql import functions as F

    rule = None if pattern.count("[") != pattern.count("]") else _rule("/" + pattern)
    own = files.where("NOT is_dir")
    return own.where(F.lit(False)) if rule is None else own.where(F.col("name").rlike(r"\A" + rule[0].pattern.replace(r"\Z", r"\z")))
