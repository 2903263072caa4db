"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset and Spark is local, as in tests, a folder of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textquarry-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Whether a query's shuffle files are dropped at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. Shuffle files behind it go once it's written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch between Spark and Python, where the session has Spark's own default: texts are long, and both sides hold whole batches.
BATCH, _ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, str(BATCH))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores where it comes from fewer files than there are cores; filters and column choices still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.rdd().getNumPartitions() > 2 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
