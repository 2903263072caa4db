"""Extracted texts kept by the hash of the file's bytes, as a Parquet table with a bound on its size."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.schema import CACHE
from textquarry.storage import written

MAX_BYTES = 256 << 20


def newest_that_fit(entries: DataFrame, key: str, last_used: str, max_bytes: int) -> DataFrame:
    """The entries that stay if the oldest go until the rest fit; of equally old ones the lesser key goes first. A sort deals them out in order; parts are added up on their own, the driver adds up the parts' sums."""
    spark = entries.sparkSession
    ordered = written(entries.orderBy(F.desc(last_used), F.desc(key)).withColumn("_m", F.monotonically_increasing_id()), "newest").withColumn("_part", F.shiftright("_m", 33))
    starts, total = [], 0
    for r in ordered.groupBy("_part").agg(F.sum("size").alias("n")).orderBy("_part").collect():
        starts.append((r._part, total))
        total += r.n or 0
    # a row a partition
    starts = F.broadcast(spark.createDataFrame(starts, "_part bigint, _start bigint"))
    inside = F.sum("size").over(Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    return ordered.join(starts, "_part").where(F.col("_start") < max_bytes).withColumn("_total", F.col("_start") + inside).where(F.col("_total") <= max_bytes).select(*entries.columns)


class ExtractCache:
    """get, put and evict whole tables: rows (sha256, text, size, last_used).

    The folder, on any file system that Spark writes to, holds versions; the newest complete one
    counts. Eviction writes a new version before it drops the old ones, so that a crash loses nothing.
    """

    def __init__(self, path: str, max_bytes: int = MAX_BYTES):
        self.path, self.max_bytes = path.rstrip("/"), max_bytes

    def _folder(self, spark: SparkSession):
        """Hadoop's file system and the cache's path in it."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _versions(self, spark: SparkSession) -> list[str]:
        fs, path = self._folder(spark)
        if not fs.exists(path):
            return []
        names = sorted(str(x.getPath().getName()) for x in fs.listStatus(path) if x.isDirectory())
        return [f"{self.path}/{n}" for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def _new(self) -> str:
        return f"{self.path}/v{time.time_ns():020d}-{uuid.uuid4().hex}"

    def table(self, spark: SparkSession) -> DataFrame:
        versions = self._versions(spark)
        if not versions:
            return spark.createDataFrame([], CACHE)
        return spark.read.schema(CACHE).parquet(versions[-1]).groupBy("sha256").agg(F.max_by("text", "last_used").alias("text"), F.max("size").alias("size"), F.max("last_used").alias("last_used"))

    def get(self, contents: DataFrame) -> DataFrame:
        """contents (with a column content) with sha256 and text, null for a miss; hits count as just used."""
        spark = contents.sparkSession
        keyed = contents.withColumn("sha256", F.sha2("content", 256))
        found = written(keyed.join(self.table(spark).select("sha256", "text"), "sha256", "left"), "got")
        self.touch(spark, found.where("text IS NOT NULL").select("sha256").distinct())
        return found

    def _append(self, rows: DataFrame) -> None:
        versions = self._versions(rows.sparkSession)
        rows.write.mode("append").parquet(versions[-1] if versions else self._new())

    def put(self, texts: DataFrame) -> None:
        """Adds (sha256, text) rows as just used, then evicts."""
        rows = texts.select("sha256", "text", F.octet_length("text").cast("bigint").alias("size"), F.current_timestamp().alias("last_used"))
        self._append(rows)
        self.evict(texts.sparkSession)

    def touch(self, spark: SparkSession, keys: DataFrame | list[str]) -> None:
        """Marks entries as just used: (sha256) rows, or a few hashes."""
        keys = keys if isinstance(keys, DataFrame) else spark.createDataFrame([(k,) for k in keys], "sha256 string")
        if self._versions(spark):
            self._append(written(self.table(spark).join(keys, "sha256", "left_semi").withColumn("last_used", F.current_timestamp()).select(*CACHE.names), "touched"))

    def evict(self, spark: SparkSession) -> None:
        table = self.table(spark)
        if (table.agg(F.sum("size")).first()[0] or 0) <= self.max_bytes:
            return
        old = self._versions(spark)
        newest_that_fit(table, "sha256", "last_used", self.max_bytes).select(*CACHE.names).write.parquet(self._new())
        fs, _ = self._folder(spark)
        for path in old:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)

    @staticmethod
    def key(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()
