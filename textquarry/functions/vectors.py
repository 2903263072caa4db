"""Dense vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm_squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def add_scaled(target: Column, source: Column, weight: float | Column) -> Column:
    """target + weight * source, place by place."""
    return F.zip_with(target, source, lambda x, y: x + y * weight)


def cosine(a: Column, b: Column) -> Column:
    """0 where the product of the norms is below 1e-10."""
    norms = F.sqrt(norm_squared(a)) * F.sqrt(norm_squared(b))
    return F.when(norms < 1e-10, 0.0).otherwise(dot(a, b) / norms)
