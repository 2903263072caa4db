"""The queries that apply each operator, with its defaults, to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import bpe, licenses, mixing, near_dups, neighbours, pii, quality, repeats, token_counts, toxicity
from textquarry.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of 2048 tokens that the mix of all documents' sources draws, a row a slot."""
    return mixing.mix(table(spark, sf_dir, "documents"), bpe.Vocabulary.load())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity in every document."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, and whether they decode to its text."""
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.Vocabulary.load())


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document to drop as a near copy, with the one that stays."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, verdict and nearest labelled examples of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of at least 50 words that occurs more than once."""
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in every document."""
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, content and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), bpe.Vocabulary.load())


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors to each one whose id is divisible by 50."""
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % neighbours.EVERY == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mixing, op2_pii, op3_bpe, op4_near_duplicates, op5_toxicity, op6_repeats, op7_licenses, op8_quality, op9_token_counts, op10_neighbours)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The others can't be put in SQL: they run trained models, a tokenizer, an edit distance or a fuzzy pattern."""
    return {"op10_neighbours": neighbours.SQL}
