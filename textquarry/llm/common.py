"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from textquarry.storage import small_batches, spread

#: The columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Characters of text that a Python worker holds as Python objects at once.
SLICE_CHARS = 1_000_000
#: Whether a query's shuffle files are dropped at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, dealt out to all cores where its files are fewer."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset and Spark is local (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="textquarry-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and it outlives executors. Shuffle files behind it go once it's written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


_state: dict[str, tuple] = {}


def _give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def worker_state(name: str, owners: tuple, make: Callable[[], object]):
    """What an operator keeps in a Python worker between batches. A worker that turns to another operator, or to other owners (broadcast values, compared by identity), drops what it kept: workers are used again and again, and their caches would add up."""
    now = _state.get("now")
    if now is None or now[0] != name or any(a is not b for a, b in zip(now[1], owners, strict=True)):
        _state.clear()
        if now is not None:
            now = None
            _give_back()
        now = _state["now"] = (name, owners, make())
    return now[2]


class Generations:
    """A bounded cache in two generations: a full young one becomes the old one, whose entries go unless they are asked for again. So what is frequent stays, and no more than twice `limit` entries are kept. Keys longer than `longest` aren't kept."""

    def __init__(self, limit: int, longest: int = 64):
        self.limit, self.longest = limit, longest
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def get(self, key: str):
        found = self.young.get(key)
        return self.old.get(key) if found is None else found

    def find(self, keys: list[str], make: Callable[[list[str]], Iterable]) -> list:
        """The value of each key, never None; make gives those of keys that aren't kept, distinct ones in one call."""
        young, old = self.young, self.old
        missing = set(keys).difference(young)
        if not missing:
            return list(map(young.__getitem__, keys))
        found = {k: old[k] for k in missing if k in old}
        fresh = list(missing.difference(found))
        found.update(zip(fresh, make(fresh), strict=True))
        swap, long = len(young) + len(found) > self.limit, [k for k in fresh if len(k) > self.longest]
        if swap:
            self.old, self.young = young, {}
        self.young.update(found)
        out = [found[k] if k in found else young[k] for k in keys] if swap else list(map(young.__getitem__, keys))
        for k in long:
            del self.young[k]
        return out


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows of the batch in runs of about SLICE_CHARS of text; a single row may be longer."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over small slices of the batches, so that long texts don't pile up in a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield fn(part)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
