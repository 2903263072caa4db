"""Toxicity from the nearest labelled examples.

Documents are TF-IDF vectors over all words of the examples: (1 + ln tf) * idf * rf.
idf counts all documents; rf, the relevance frequency log2(2 + toxic / others) of the examples that
hold a term, is the usual supervised factor of text classification. No term is left out, so that
clean documents have neighbours of their own kind too.

The nearest examples by exact cosine come from a block-max inverted index. Examples lie in
blocks. The lists of rare terms are read in full; those of the HEAD commonest terms are long and
weigh little, so a block's are only read if the block's greatest sum over the rare terms and the
block's greatest weights of the common ones can still reach the nearest found so far. The
neighbours vote with weights that fall with distance; votes are calibrated by isotonic
regression on the examples themselves, each left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_slices, slices, stored, worker_state
from textquarry.llm.repeats import Words

#: Labelled rows that the index holds at most: those first in the order of a hash of doc_id.
EXAMPLES = 4000
#: Neighbours; the calibrated score from which a document is toxic.
NEIGHBOURS, THRESHOLD = 15, 0.5
#: Examples in a block, common terms, documents and postings that are looked at together. They bear on time alone.
BLOCK, HEAD, TOGETHER, POSTINGS = 64, 512, 256, 1_000_000
#: Strings that a worker's table holds; it bears on time alone.
KNOWN = 300_000

_words = re.compile(r"[^\W_]+").findall


class Counts:
    """Counts the words of texts over a vocabulary; words outside it don't count.

    What white space divides is looked up by a 64-bit hash in an open table of arrays, which
    stays in the processor's cache; only strings that aren't in it are cut into words. A full
    table is emptied.
    """

    def __init__(self, vocabulary: list[str]):
        self.index = {t: i for i, t in enumerate(vocabulary)}
        self._empty(KNOWN)

    def _empty(self, limit: int) -> None:
        self.limit, self.used, bits = limit, 0, max(1, (2 * limit - 1).bit_length())
        self.keys, self.entry, self.shift = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64(64 - bits)
        self.start, self.size, self.flat = np.zeros(limit, np.int64), np.zeros(limit, np.int64), np.empty(0, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 for none."""
        out, slot, left = np.full(len(h), -1, np.int64), (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.entry[slot[left[hit]]]
            left = left[~hit & (key != 0)]
            slot[left] = (slot[left] + 1) % len(self.keys)
        return out

    def _add(self, h: np.ndarray, chunks: list[str]) -> None:
        """Entries for distinct hashes that have none."""
        get = self.index.get
        lists = [[i for w in _words(c) if (i := get(w)) is not None] for c in chunks]
        own = np.arange(self.used, self.used + len(h))
        self.size[own] = np.fromiter(map(len, lists), np.int64, len(h))
        self.start[own] = len(self.flat) + np.cumsum(self.size[own]) - self.size[own]
        self.flat = np.concatenate([self.flat, np.array([i for x in lists for i in x], np.int32)])
        self.used += len(h)
        slot, left = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]], self.entry[slot[free]] = h[free], own[free]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) % len(self.keys)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts, one after another: where each one's terms start (and the end), the terms, ascending, and their counts. A null text has none."""
        words = Words(pc.utf8_lower(texts))
        h = words.hashes()
        h[h == 0] = 1
        entry = self._find(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            if self.used + len(new) > self.limit:
                miss = np.arange(len(h))
                new, first = np.unique(h, return_index=True)
                self._empty(max(KNOWN, len(new)))
            at, raw = miss[first], words.raw.tobytes()
            self._add(new, [raw[a:b].decode() for a, b in zip(words.first[at].tolist(), words.last[at].tolist())])
            entry[miss] = self._find(h[miss])
        n = self.size[entry]
        doc = np.repeat(np.repeat(np.arange(len(texts)), np.diff(words.starts)), n)
        size = max(len(self.index), 1)
        key, count = np.unique(doc * size + self.flat[_ranges(self.start[entry], n)], return_counts=True)
        return np.searchsorted(key, np.arange(len(texts) + 1) * size), key % size, count


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class Index:
    """Block-max inverted index over the examples' unit vectors."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, at: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, k: int = NEIGHBOURS, block: int = BLOCK, head: int = HEAD):
        self.k, self.block, n = k, block, len(ids)
        df = np.bincount(term, minlength=terms)
        common = np.sort(np.lexsort((np.arange(terms), -df))[:head])
        self.place = np.full(terms, -1, np.int64)
        self.place[common] = np.arange(len(common))
        doc = np.repeat(np.arange(n), np.diff(at))
        dense = np.zeros((n, len(common)))
        use = self.place[term] >= 0
        dense[doc[use], self.place[term[use]]] = weight[use]
        # like vectors share blocks, which keeps the bounds close
        order = np.lexsort((ids, dense.max(1), dense.argmax(1))) if len(common) and n else np.arange(n)
        self.ids, self.toxic = np.asarray(ids, np.int64)[order], np.asarray(toxic, np.float64)[order]
        self.blocks = -(-n // block)
        self.dense = np.zeros((self.blocks * block, len(common)))
        self.dense[:n] = dense[order]
        self.top = self.dense.reshape(self.blocks, block, -1).max(1) if n else np.zeros((0, len(common)))
        where = np.empty(n, np.int64)
        where[order] = np.arange(n)
        rare = np.flatnonzero(~use)
        rare = rare[np.lexsort((where[doc[rare]], term[rare]))]
        self.where, self.what = where[doc[rare]].astype(np.int32), weight[rare]
        self.start = np.searchsorted(term[rare], np.arange(terms + 1))
        self.number = {int(x): i for i, x in enumerate(self.ids.tolist())}
        #: Blocks whose common lists were read, of how many.
        self.opened, self.seen = 0, 0

    def nearest(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, without: list[int | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector the numbers and cosines of its k nearest examples, nearest first, of equal ones (to nine places) the lower doc_id; examples at cosine zero don't count as near. without: an example's doc_id that isn't looked at."""
        reads = self.start[term + 1] - self.start[term]
        total = np.concatenate([[0], np.cumsum(reads)])
        a = 0
        while a < len(at) - 1:
            b = max(a + 1, min(a + TOGETHER, int(np.searchsorted(total[at], total[at[a]] + POSTINGS, side="right")) - 1))
            lo, hi = at[a], at[b]
            yield from self._nearest(np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), term[lo:hi], weight[lo:hi], reads[lo:hi], without[a:b])
            a = b

    def _nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, reads: np.ndarray, without: list[int | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, size, k = len(without), self.blocks * self.block, self.k
        if not size:
            yield from ((np.empty(0, np.int64), np.empty(0)) for _ in range(n))
            return
        query = np.zeros((n, self.dense.shape[1]))
        use = self.place[term] >= 0
        query[doc[use], self.place[term[use]]] = weight[use]
        own = _ranges(self.start[term], reads)
        sums = np.bincount(np.repeat(doc, reads) * size + self.where[own], np.repeat(weight, reads) * self.what[own], n * size).astype(float).reshape(n, size)
        for q, w in enumerate(without):
            if w is not None:
                sums[q, self.number[w]] = -np.inf
        bounds = sums.reshape(n, self.blocks, self.block).max(2) + query @ self.top.T
        scores = np.full((n, size), -np.inf)
        best = np.full((n, k), 0.0)
        first = bounds.argmax(1)
        left = np.ones((n, self.blocks), bool)
        for step in range(self.blocks + 1):
            # each document's most promising block first, then block by block what can still be near
            for b in np.unique(first).tolist() if not step else (step - 1,):
                at = np.flatnonzero((first == b) if not step else left[:, b] & (bounds[:, b] > 0) & (bounds[:, b] >= best[:, 0] - 1e-8))
                if not len(at):
                    continue
                self.opened += len(at)
                left[at, b] = False
                here = slice(b * self.block, (b + 1) * self.block)
                found = np.round(sums[at, here] + query[at] @ self.dense[here].T, 9)
                scores[at, here] = found
                both = np.concatenate([best[at], found], 1)
                best[at] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                # the least of the k best so far
                best[at, 0], best[at, best[at].argmin(1)] = best[at].min(1), best[at, 0]
        self.seen += n * self.blocks
        for q in range(n):
            near = np.flatnonzero((scores[q] > 0) & (scores[q] >= best[q, 0]))
            near = near[np.lexsort((self.ids[near], -scores[q, near]))[:k]]
            yield near, scores[q, near]

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        """The toxic share of the votes of k neighbours, each 1 / (1.0001 - cosine); where fewer are at a cosine above 0, the rest, all equally far, vote as examples do on average. 0 without neighbours."""
        if not len(near):
            return 0.0
        w, rest = 1 / (1.0001 - np.minimum(cosines, 1.0)), (self.k - len(near)) / 1.0001
        return float(((w * self.toxic[near]).sum() + rest * self.toxic.mean()) / (w.sum() + rest))


def isotonic(votes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best rising fit: for votes from x[i] on the calibrated score is y[i]."""
    levels = np.unique(votes)
    blocks: list[list[float]] = []
    for v in levels:
        at = votes == v
        blocks.append([v, float(toxic[at].sum()), float(at.sum())])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Vocabulary, weights, index and calibration; its size is bounded by the examples'."""

    def __init__(self, vocabulary: list[str], weight: np.ndarray, ids: list[int], toxic: list[int], at: np.ndarray, term: np.ndarray, count: np.ndarray):
        self.vocabulary, self.weight = vocabulary, weight
        #: Examples that hold a term.
        self.held = np.bincount(term, minlength=len(weight))
        self.index = Index(np.array(ids, np.int64), np.array(toxic), at, term, self.unit(at, term, count), len(weight))
        # an example's own vector is what it would be if it weren't one: without terms that it alone holds
        votes = np.array([self.index.vote(*x) for x in self.index.nearest(at, term, self.unit(at, term, count, np.ones(len(ids), bool)), ids)])
        self.x, self.y = isotonic(votes, np.array(toxic, float)) if len(ids) else (np.empty(0), np.empty(0))

    def unit(self, at: np.ndarray, term: np.ndarray, count: np.ndarray, examples: np.ndarray | None = None) -> np.ndarray:
        """Weights of the terms of texts, each text's to length 1."""
        w = (1 + np.log(count)) * self.weight[term]
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        if examples is not None:
            w = np.where(examples[doc] & (self.held[term] == 1), 0.0, w)
        norm = np.sqrt(np.bincount(doc, w * w, len(at) - 1))
        return w / np.where(norm > 0, norm, 1.0)[doc]

    def calibrated(self, vote: float) -> float:
        at = int(np.searchsorted(self.x, vote, side="right")) - 1
        return float(self.y[max(at, 0)]) if len(self.y) else 0.0


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """From labelled documents (labels' doc_id and toxic, docs' doc_id and text), of which at most `examples` are used, and the document counts of their terms in all of docs. Rows with a null id, label or text don't count; of rows with one doc_id the first by label and text does as an example. Without usable rows of both labels every score is 0."""
    spark = docs.sparkSession
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    # only ids that docs holds are drawn, so that a filtered corpus still fills the sample
    ids = docs.select("doc_id").where("text IS NOT NULL AND doc_id IS NOT NULL").distinct()
    drawn = labels.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    rows = stored(docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(stored(drawn, "drawn")), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "examples")

    def seen(batches):
        for batch in batches:
            n: Counter[tuple[str, int]] = Counter()
            for text, label in zip(pc.utf8_lower(batch.column("text")).to_pylist(), batch.column("toxic").to_pylist()):
                n.update((t, label) for t in set(_words(text)))
            yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in n], pa.string()), "toxic": pa.array([x for _, x in n], pa.int32()), "n": pa.array(list(n.values()), pa.int64())})

    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1, 0) or sum(totals.values()) == totals[1]:
        return Model([], np.zeros(0), [], [], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    held = rows.select("text", "toxic").mapInArrow(seen, "term string, toxic int, n bigint").groupBy("term").agg(of(F.col("toxic") == 1).alias("a"), of(F.col("toxic") != 1).alias("b")).toArrow().sort_by("term")
    vocabulary = held.column("term").to_pylist()
    shared = spark.sparkContext.broadcast(vocabulary)

    def documents(batches):
        """Documents of the partition that hold each term; -1: documents."""
        n, all_ = np.zeros(len(shared.value), np.int64), 0
        counts = worker_state("toxicity terms", (shared.value,), lambda: Counts(shared.value))
        for batch in batches:
            for part in slices(batch):
                n += np.bincount(counts(part.column("text"))[1], minlength=len(n))
                all_ += part.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], all_))], names=["term", "n"])

    counted = docs.select("text").where("text IS NOT NULL").mapInArrow(documents, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df = np.ones(len(vocabulary))
    df[term[term >= 0]] = n[term >= 0]
    a, b = held.column("a").to_numpy(), held.column("b").to_numpy()
    weight = np.log(n[term < 0].sum() / df) * np.log2(2 + a / np.maximum(b, 1))

    def vectors(batches):
        counts = Counts(shared.value)
        for batch in batches:
            at, i, count = counts(batch.column("text"))
            lists = (pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (i, count))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], names=["doc_id", "toxic", "i", "n"])

    found = rows.mapInArrow(vectors, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, i array<int>, n array<int>").toArrow().sort_by("doc_id").combine_chunks()
    lists, counts = found.column("i").combine_chunks(), found.column("n").combine_chunks()
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return Model(vocabulary, weight, found.column("doc_id").to_pylist(), [int(x == 1) for x in found.column("toxic").to_pylist()], at, lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64))


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",), evidence: bool = True) -> DataFrame:
    """docs' columns in keep, with score in [0, 1], toxic (score >= threshold) and evidence: the nearest examples with their similarity and label, nearest first (left out where evidence is False). A column in keep that has one of these names is replaced.

    A row for every row of docs, repeated ones and null ids included; an example isn't its own
    evidence. A null or empty text, or one without a word of the examples, has score 0, isn't
    toxic and has no evidence. Of equal similarities the lower example comes first. Whole texts
    count at any length; columns outside keep are ignored whatever their names. An empty table
    gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        counts = worker_state("toxicity", (m,), lambda: Counts(m.vocabulary))
        at, term, count = counts(batch.column("text"))
        without = [x if x in m.index.number else None for x in batch.column("doc_id").to_pylist()]
        weight = m.unit(at, term, count, np.array([w is not None for w in without], bool))
        scores, near = [], []
        for p, s in m.index.nearest(at, term, weight, without):
            scores.append(m.calibrated(m.index.vote(p, s)) if len(p) else 0.0)
            near.append((p, s))
        columns = [*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())]
        if evidence:
            flat = np.concatenate([p for p, _ in near]) if near else np.empty(0, np.int64)
            fields = [pa.array(m.index.ids[flat]), pa.array(np.concatenate([s for _, s in near]) if near else np.empty(0)), pa.array(m.index.toxic[flat].astype(np.int32))]
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) for p, _ in near)]), pa.int32()), pa.StructArray.from_arrays(fields, names=["example", "similarity", "toxic"])))
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "toxic", *(("evidence",) if evidence else ())])

    keep = tuple(c for c in keep if c not in ("score", "toxic", "evidence"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, toxic boolean" + (", evidence array<struct<example:bigint,similarity:double,toxic:int>>" if evidence else "")
    return map_slices(docs.select(*dict.fromkeys((*keep, "doc_id", "text"))), run, schema)
