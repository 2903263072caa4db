"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the frequent pre-tokens, sent compactly as one Arrow string array
(a buffer of bytes and one of offsets) with a byte for each one's length in tokens; a worker looks
all pieces of its texts up in it at once, by Arrow's hash table over these buffers, and no Python
object is made for them. What it misses goes to the worker's own cache, which encodes each new string
once. No pre-token of a text is ever shuffled to be counted: only the short summaries that
partitions make for the table are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.bpe import CACHE, LONGEST_CACHED, Encoder, Vocabulary, chunks_of
from textquarry.llm.common import Generations, map_slices, worker_state

#: Entries of the table of frequent pre-tokens, and pre-tokens that a partition's summary keeps. Both bear on speed alone: counts are the same with any table.
TABLE_SIZE, SUMMARY = 50_000, 20_000
#: Counters that a partition keeps while it reads; those that fall behind go (lossy counting).
COUNTERS = 200_000


def frequent(docs: DataFrame, vocabulary: Vocabulary, table_size: int = TABLE_SIZE, summary: int = SUMMARY) -> tuple[pa.Array, np.ndarray]:
    """The commonest pre-tokens of all documents, without the space before them, and their lengths in tokens (254 at most). Each partition counts its own and passes on the commonest; equal counts are in the order of the strings."""

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(chunks_of(text)[1:])
                if len(seen) > COUNTERS:
                    seen = Counter(dict(seen.most_common(COUNTERS // 2)))
        top = [(c, n) for c, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if len(c) <= LONGEST_CACHED][:summary]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([c for c, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    counted = docs.select("text").where("text IS NOT NULL").mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    # the table's size is its bound
    found = [r.piece for r in counted.orderBy(F.desc("n"), "piece").limit(table_size).select("piece").collect()]
    sizes = np.array([len(x) // 4 for x in Encoder(vocabulary).spaced(found)], np.int64)
    use = sizes < 255
    return pa.array(found, pa.string()).filter(pa.array(use)), sizes[use].astype(np.uint8)


class _Counts:
    """A worker's second tier."""

    def __init__(self, vocabulary: Vocabulary):
        self.encoder = Encoder(vocabulary)
        self.known = Generations(CACHE, LONGEST_CACHED)

    def spaced(self, strings: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.encoder.spaced(strings)]

    def of(self, texts: pa.Array, pieces: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each text; a null one has 0."""
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = cut.offsets.to_numpy()
        # runs of white space aren't single spaces: such texts are cut like the encoder does
        odd = np.flatnonzero(pc.match_substring_regex(pc.fill_null(texts, ""), r"(?s)^ | $|[\s\x{85}\p{Z}\x1c-\x1f\v]{2}").to_numpy(zero_copy_only=False))
        flat = cut.flatten()
        head = offsets[:-1]
        plain = np.ones(len(texts), bool)
        plain[odd] = False
        count = np.zeros(len(flat), np.int64)
        at = pc.index_in(flat, pieces) if len(pieces) else pa.nulls(len(flat), pa.int32())
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        count[hit] = sizes[at.drop_null().to_numpy()]
        inside = np.repeat(plain, np.diff(offsets))
        inside[head] = False
        miss = np.flatnonzero(~hit & inside)
        if len(miss):
            found = flat.take(pa.array(miss)).dictionary_encode()
            own = np.array(self.known.find(found.dictionary.to_pylist(), self.spaced), np.int64)
            count[miss] = own[found.indices.to_numpy()]
        count[~inside] = 0
        sums = np.concatenate([[0], np.cumsum(count)])
        out = sums[offsets[1:]] - sums[offsets[:-1]]
        begin = flat.take(pa.array(head)).to_pylist()
        for i in odd.tolist():
            begin[i], *rest = chunks_of(texts[i].as_py())
            out[i] = sum(self.known.find(rest, self.spaced))
        starts = self.encoder.starts.find(begin, self.encoder._cut)
        return out + np.array([len(x) // 4 for x in starts], np.int64)


def token_counts(docs: DataFrame, vocabulary: Vocabulary, table: tuple[pa.Array, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, n_tokens bigint) for every row of docs.

    Repeated rows and null ids give a row each; other columns are ignored whatever their names.
    A null text has a null count, an empty one 0; texts are counted whole at any length. An
    empty table gives an empty one. table: from frequent(); made from docs where it is None.
    """
    context = docs.sparkSession.sparkContext
    shared, first = context.broadcast(vocabulary), context.broadcast(frequent(docs, vocabulary) if table is None else table)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = worker_state("token_counts", (shared.value,), lambda: _Counts(shared.value))
        texts = batch.column("text")
        n = counts.of(texts, *first.value)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, mask=texts.is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "n_tokens"])

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint")
