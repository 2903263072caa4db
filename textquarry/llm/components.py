"""Connected components of a graph in Spark, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of the edges (u, v) but a component's least, which is the label of the others. Rounds are cut off by written tables; their number grows with the logarithm of the longest path."""
    now, mark = stored(edges.where("u <> v").distinct(), "edges"), None
    while True:
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(after) == mark or not after[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("label"))
        mark = tuple(after)
        now = stored(_small(_large(now)), "edges")
