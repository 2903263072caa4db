"""A corpus: documents (path, text, size), from a table or from a directory tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Corpus:
    """docs: path (any type that can be ordered), text (null: not readable), size (bytes as stored). distinct: no path comes twice."""

    docs: DataFrame
    single_file: bool = False
    distinct: bool = False

    @classmethod
    def from_table(cls, df: DataFrame, path: str = "doc_id", text: str = "text") -> Corpus:
        """Documents of a table; their stored size is that of the text."""
        return cls(df.select(F.col(path).alias("path"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("size")))

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, cache=None, gitignore: bool = True) -> Corpus:
        """Documents of a directory tree (or one file), extracted on the executors."""
        from textquarry.sources.extract import extracted
        from textquarry.sources.filetree import files, is_file

        return cls(extracted(files(spark, root, gitignore).where("NOT is_dir"), cache), is_file(root), True)
