"""Random projection of term counts: a seeded Gaussian row for each term, no statistics of the corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.corpus import Corpus
from textquarry.functions.text import plain_tokens
from textquarry.functions.vectors import cosine
from textquarry.storage import small_batches

#: Bytes of rows that a process keeps; words whose rows are added up together; bytes of a word that are hashed in bulk.
ROWS_BYTES, WORDS, BULK = 112 << 20, 20_000, 40


class _Rows:
    """Rows of buckets in the order in which they were asked for: all are in one matrix, `place` has the row of each bucket, -1 where there's none yet."""

    def __init__(self, buckets: int, dim: int):
        self.place, self.n = np.full(buckets, -1, np.int32), 0
        # pages that aren't touched take no memory
        self.table = np.empty((max(1, min(buckets, ROWS_BYTES // (4 * dim))), dim), np.float32)


_kept: dict[tuple[int, int, int], _Rows] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fnv1a(term: str) -> int:
    """The 64-bit FNV-1a hash of the term's bytes."""
    h = 0xCBF29CE484222325
    for byte in term.encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hashed(terms: pa.StringArray) -> np.ndarray:
    """fnv1a() of each term: those of up to BULK bytes a byte at a time for all of them."""
    if not len(terms):
        return np.empty(0, np.uint64)
    size = pc.binary_length(terms).to_numpy().astype(np.int64)
    start = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms)].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    out = np.full(len(terms), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(size, kind="stable")
    sizes = size[order]
    for i in range(min(BULK, int(sizes[-1]))):
        own = order[np.searchsorted(sizes, i, side="right") :]
        out[own] = (out[own] ^ data[start[own] + i]) * np.uint64(0x100000001B3)
    for i in np.flatnonzero(size > BULK).tolist():
        out[i] = fnv1a(terms[i].as_py())
    return out


@dataclass(frozen=True)
class RandomProjection:
    """dim: length of the vectors; buckets: distinct rows, into which terms are hashed; seed."""

    dim: int = 256
    buckets: int = 100_000
    seed: int = 20_26

    def _made(self, buckets: np.ndarray) -> np.ndarray:
        """The rows of the buckets: normal numbers by Box and Muller's way from hashed counters, so that all are made at once and are the same in every process."""
        half = -(-self.dim // 2)
        counters = buckets.astype(np.uint64)[:, None] * np.uint64(half) + np.arange(half, dtype=np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64))
        first = _mixed(counters * np.uint64(0xD6E8FEB86659FD93))
        u, v = ((first >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24), (_mixed(first ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(40)).astype(np.float32) * np.float32(2 * np.pi * 2**-24)
        size = np.sqrt(np.float32(-2) * np.log(u))
        return np.concatenate([size * np.cos(v), size * np.sin(v)], axis=1)[:, : self.dim] / np.float32(np.sqrt(self.dim))

    def _placed(self, terms: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """A matrix and the row of each term in it."""
        bucket = (hashed(terms) % np.uint64(self.buckets)).astype(np.int64)
        kept = _kept.get((self.seed, self.dim, self.buckets))
        if kept is None:
            _kept.clear()
            kept = _kept[self.seed, self.dim, self.buckets] = _Rows(self.buckets, self.dim)
        missing = np.unique(bucket[kept.place[bucket] < 0])
        if kept.n + len(missing) > len(kept.table):
            kept.place[:], kept.n, missing = -1, 0, np.unique(bucket)
            if len(missing) > len(kept.table):
                return self._made(missing), np.searchsorted(missing, bucket)
        for at in range(0, len(missing), 1024):
            own = missing[at : at + 1024]
            kept.table[kept.n : kept.n + len(own)] = self._made(own)
            kept.place[own] = np.arange(kept.n, kept.n + len(own))
            kept.n += len(own)
        return kept.table, kept.place[bucket]

    def rows(self, terms: list[str]) -> np.ndarray:
        """Each term's row, whose entries have variance 1 / dim."""
        table, place = self._placed(pa.array(terms, pa.string()))
        return table[place]

    def row(self, term: str) -> np.ndarray:
        return self.rows([term])[0]

    def vector(self, words: list[str]) -> np.ndarray:
        out = np.zeros(self.dim)
        for w in words:
            out += self.row(w)
        return out

    def vectors(self, words: pa.ListArray) -> np.ndarray:
        """A row for each list of words, null ones at zero: the sums of the rows of their distinct words, in order, times how often each occurs, so that a text's vector doesn't depend on those beside it. Long lists are cut into runs."""
        out = np.zeros((len(words), self.dim))
        flat, size = words.flatten(), words.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(size)
        i = 0
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + WORDS, side="right")))
            begin = ends[i] - size[i]
            for a in range(0, ends[j - 1] - begin, WORDS):
                own = flat.slice(begin + a, min(WORDS, ends[j - 1] - begin - a)).dictionary_encode()
                order = pc.sort_indices(own.dictionary).to_numpy()
                table, row = self._placed(own.dictionary.take(pa.array(order)))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                doc = np.repeat(np.arange(j - i), size[i:j])[a : a + WORDS]
                key, n = np.unique(doc * len(order) + place[own.indices.to_numpy()], return_counts=True)
                doc, row, n = key // len(order), row[key % len(order)], n.astype(np.float64)
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).tolist()
                for b, c in zip(first, [*first[1:], len(doc)]):
                    out[i + doc[b]] += n[b:c] @ table[row[b:c]]
            i = j
        return out

    def project(self, text: Column) -> Column:
        """array<double>: the sum of the rows of the text's words; null for null."""
        own = self

        @F.arrow_udf("array<double>")
        def run(words: pa.Array) -> pa.Array:
            flat = own.vectors(words)
            offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * own.dim, mask=np.append(words.is_null().to_numpy(zero_copy_only=False), False))
            return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))

        return run(plain_tokens(text))

    def score(self, corpus: Corpus, query: str) -> DataFrame:
        """(path, score): cosine of each document with the query."""
        q = self.project(F.lit(query))
        docs = corpus.docs.where("text IS NOT NULL")
        small_batches(docs.sparkSession)
        wanted = F.broadcast(docs.sparkSession.range(1).select(q.alias("q")))
        return docs.select("path", self.project(F.col("text")).alias("v")).crossJoin(wanted).select("path", cosine(F.col("v"), F.col("q")).alias("score"))
