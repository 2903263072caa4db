"""Finding files by name, path and kind over the file relation."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.patterns import Matcher, glob


def ordered(files: DataFrame) -> DataFrame:
    """By path, component by component."""
    return files.orderBy(F.split("path", "/"))


def kind(files: DataFrame, entry_type: str | None) -> DataFrame:
    """f: what isn't a directory (links too); d: directories."""
    return files if entry_type is None else files.where(F.col("is_dir") == F.lit(entry_type == "d"))


def displayed(path: Column, root: str, argument: str) -> Column:
    """The path as a find from `argument` shows it: absolute for an absolute one, else below it."""
    if posixpath.isabs(argument):
        return path
    return F.concat(F.lit(argument.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30))


def find(files: DataFrame, root: str, argument: str | None = None, name: str | None = None, iname: str | None = None, path: str | None = None, entry_type: str | None = None) -> DataFrame:
    """files with `display`, whose name and displayed path match the globs; unordered."""
    out = kind(files, entry_type).withColumn("display", displayed(F.col("path"), root, root if argument is None else argument))
    for c, pattern, fold in (("name", name, False), ("name", iname, True), ("display", path, False)):
        if pattern is not None:
            out = out.where(glob(F.col(c), pattern, fold))
    return out


def extension(name: Column) -> Column:
    """What follows the last dot; empty without one or where it starts the name."""
    return F.regexp_extract(name, r"(?s).\.([^.]*)\z", 1)


def fd(files: DataFrame, root: str, pattern: str | None = None, ext: str | None = None, entry_type: str | None = None, ignore_case: bool = False, fixed: bool = False) -> DataFrame:
    """files with `display`, the path below the root, whose name holds the pattern and has the extension; unordered."""
    out = kind(files, entry_type)
    name = F.col("name")
    if ext is not None:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        out = out.where(F.translate(extension(name), upper, lower) == ext.translate(str.maketrans(upper, lower)))
    if pattern is not None and fixed:
        out = out.where(F.lower(name).contains(pattern.lower()) if ignore_case else name.contains(pattern))
    elif pattern is not None:
        out = out.where(Matcher((pattern,), True, ignore_case).matches(name))
    return out.withColumn("display", F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 30))
