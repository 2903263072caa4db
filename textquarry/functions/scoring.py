"""BM25 of a whole pattern as the one term."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def bm25_tf(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """The saturated term frequency, below k1 + 1."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def idf(total: Column, df: Column) -> Column:
    return F.log((total - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, length: Column, average: Column, total: Column, df: Column, k1: float = K1, b: float = B) -> Column:
    return idf(total, df) * bm25_tf(tf, length, average, k1, b)
