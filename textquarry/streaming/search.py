"""Search over a stream of documents: the line search needs no state, and neither do BM25 scores against fixed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textquarry.corpus import Corpus
from textquarry.operators.search import SearchSpec, search


def search_stream(docs: DataFrame, spec: SearchSpec, path: str = "doc_id", text: str = "text", stats: DataFrame | None = None) -> DataFrame:
    """search() over a streaming table. stats: one row n_docs, avg_size, df from operators.search.statistics() over a fixed corpus, needed where the spec asks for BM25."""
    if spec.bm25 != "off" and stats is None:
        raise ValueError("BM25 over a stream needs the statistics of a fixed corpus")
    if spec.max_results is not None:
        raise ValueError("a stream has no first results")
    return search(Corpus.from_table(docs, path, text), spec, stats)
