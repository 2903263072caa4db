"""Terms of documents: postings, document frequencies, TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from textquarry.corpus import Corpus
from textquarry.functions.text import token_counts
from textquarry.storage import small_batches, written

#: Postings that a worker passes on together.
POSTINGS = 50_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, term, tf) of (path, text), a text at a time."""
    for batch in batches:
        path, rows, terms, counts = batch.column("path"), [], [], []
        for i, text in enumerate(batch.column("text")):
            own = token_counts(text.as_py())
            rows += [i] * len(own)
            terms += own
            counts += own.values()
            if len(rows) >= POSTINGS or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([path.take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["path", "term", "tf"])
                rows, terms, counts = [], [], []


def postings(corpus: Corpus) -> DataFrame:
    """(path, term, tf). A row's terms are counted where it is read; only if a path comes twice are counts shuffled, to be added up."""
    docs = corpus.docs.where("text <> ''")
    small_batches(docs.sparkSession)
    schema = docs.select("path").schema.add("term", StringType()).add("tf", LongType())
    found = docs.select("path", "text").mapInArrow(_counted, schema)
    if corpus.distinct or not docs.groupBy("path").count().where("count > 1").limit(1).count():
        return found
    return found.groupBy("path", "term").agg(F.sum("tf").alias("tf"))


def document_frequencies(post: DataFrame) -> DataFrame:
    """(term, df) from postings."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf(corpus: Corpus) -> DataFrame:
    """(path, term, tf, df, weight): tf * ln(N / df) where it's above zero, so that terms of all documents are left out. Both sides of its join read postings that are written at the call. N counts the documents with a text."""
    post = written(postings(corpus), "postings")
    n = corpus.docs.where("text <> ''").agg(F.count(F.lit(1)).alias("n_docs"))
    out = post.join(document_frequencies(post), "term").crossJoin(F.broadcast(n)).withColumn("weight", F.col("tf") * F.log(F.col("n_docs") / F.col("df")))
    return out.where("weight > 0").select("path", "term", "tf", "df", "weight")
