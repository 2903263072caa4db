"""A corpus pipeline of the operators in textquarry.llm: STAGES in order, each on all that the one before kept.

What the stages do with odd rows: toxicity keeps rows without words (null, empty, marks alone) and
rows with a null id, near duplicates keeps them too and makes rows with one doc_id one row, PII
passes them through, mixing leaves out null and empty texts, takes a null source as one of its
own and, as a mix to target weights does, gives some blocks of large sources no slot and blocks of small ones
several. BPE has a row for each row that it gets. Ties: the document of the least
doc_id stays of a group; the rest is in the operators' docstrings. An empty table gives an
empty one; columns other than those of documents are dropped by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import bpe, mixing, near_dups, pii, toxicity
from textquarry.llm.common import DOCUMENT_COLUMNS, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that aren't toxic by their nearest labelled examples; documents without words stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model, keep=DOCUMENT_COLUMNS, evidence=False).where("NOT toxic").select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document, that of the least doc_id, of each group of near duplicates."""
    return near_dups.without_near_duplicates(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data in their texts replaced by its type."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The parts of docs in the blocks of tokens that shards draw by the sources' target weights: the mix of op1."""
    return mixing.mixed_documents(docs, bpe.Vocabulary.load())


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, tokens and n_tokens of docs, with whether the tokens decode to the text."""
    return bpe.encode(docs, bpe.Vocabulary.load(), keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Trained models, alignments and a tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each result written to the shared folder and read again; a stage's table goes once the next is written."""
    spark_path = spark._jvm.org.apache.hadoop.fs.Path
    last = None
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            spark_path(last).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark_path(last), True)
        last = path
    return docs
