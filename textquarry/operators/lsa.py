"""Latent semantic analysis: TF-IDF, truncated SVD, cosine ranking of documents and their lines.

Only the right singular vectors (one row a document) and the singular values are kept, fitted on
all documents. The factorisation works on the terms' rows, which stay distributed: up to
GRAM_DOCS documents it sums the Gram matrix over blocks of terms, beyond that it runs block
Lanczos with thick restarts until all wanted vectors have converged, and raises if they don't.
What is broadcast and added up in a round is SLICE_BYTES at most (or one number a document, if
that's more); the driver keeps its basis in a mapped file.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textquarry.corpus import Corpus
from textquarry.functions.text import lines, tokens, trimmed
from textquarry.operators.terms import postings
from textquarry.storage import shared_folder, written

DIMENSIONS, GRAM_DOCS = 128, 1500
#: Vectors that a round adds to the basis, vectors of the basis before a restart (at least twice those wanted), rounds after which fitting fails.
WIDTH, BASIS, ROUNDS = 64, 768, 300
#: Wanted vectors have converged when each residual is below this share of the greatest eigenvalue.
TOLERANCE = 1e-10
SLICE_BYTES = 1 << 26
#: Rows of a matrix that are added together; terms and, about, weights that are multiplied together.
BLOCK, TERMS, WEIGHTS = 512, 4096, 100_000
#: Rows of V that the driver sends at once.
VECTORS = 20_000
TOP_DOCS, TOP_LINES, LEAST_SCORE, LEAST_LINE = 20, 5, 1e-8, 10


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and weights of each term."""
    docs, weights = batch.column("docs"), batch.column("weights")
    at = docs.offsets.to_numpy() - docs.offsets[0].as_py()
    d, w = docs.flatten().to_numpy(), weights.flatten().to_numpy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield d[a:b], w[a:b]


def _sparse(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of terms of about WEIGHTS weights: where each term starts, documents, weights."""
    docs, weights = batch.column("docs"), batch.column("weights")
    at = docs.offsets.to_numpy().astype(np.int64) - docs.offsets[0].as_py()
    d, w = docs.flatten().to_numpy(), weights.flatten().to_numpy()
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + WEIGHTS, side="right")) - 1)
        yield at[i:j] - at[i], d[at[i] : at[j]], w[at[i] : at[j]]
        i = j


def _summed(rows: DataFrame, shape: tuple[int, int], part) -> np.ndarray:
    """The sum over all partitions of part(batch, total): each worker adds up its own, blocks of rows are then added on the executors, so that the driver gets one matrix."""

    def run(batches):
        total, any_ = np.zeros(shape), False
        for batch in batches:
            for a in range(0, batch.num_rows, TERMS):
                part(batch.slice(a, TERMS), total)
                any_ = True
        for a in range(0, shape[0], BLOCK) if any_ else ():
            yield pa.RecordBatch.from_pydict({"block": pa.array([a], pa.int64()), "m": pa.array([total[a : a + BLOCK].tobytes()], pa.binary())})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": f.block.iloc[:1], "m": [sum(np.frombuffer(m) for m in f.m).tobytes()]})

    out = np.zeros(shape)
    for r in rows.mapInArrow(run, "block bigint, m binary").groupBy("block").applyInPandas(add, "block bigint, m binary").collect():
        out[r.block : r.block + BLOCK] = np.frombuffer(r.m).reshape(-1, shape[1])
    return out


def _condensed(rows: DataFrame) -> DataFrame:
    """(docs, weights) with the Gram matrix of rows: terms of a single document only add to its diagonal, so that a document's are one row. As many partitions as there are cores, as each has a matrix of its own."""
    one = F.size("docs") == 1
    single = rows.where(one).groupBy(F.col("docs")[0].alias("doc")).agg(F.sqrt(F.sum(F.col("weights")[0] * F.col("weights")[0])).alias("weight"))
    all_ = rows.where(~one).select("docs", "weights").union(single.select(F.array("doc"), F.array("weight")))
    return written(all_.repartition(rows.sparkSession.sparkContext.defaultParallelism), "gram")


def _product(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    """The Gram matrix times v."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(v))

    def multiply(batch: pa.RecordBatch, total: np.ndarray) -> None:
        v = shared.value
        for at, d, w in _sparse(batch):
            w = w[:, None]
            y = np.repeat(np.add.reduceat(w * v[d], at), np.diff(np.append(at, len(d))), axis=0)
            # added up by document
            order = np.argsort(d, kind="stable")
            own = d[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            total[own[first]] += np.add.reduceat((w * y)[order], first)

    try:
        return _summed(rows, v.shape, multiply)
    finally:
        shared.destroy()


def _mapped(n: int, width: int) -> np.ndarray:
    """A matrix in a file that is gone with it."""
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, np.float64, "w+", shape=(n, width))


def _lanczos(rows: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of the Gram matrix, greatest first, and their vectors."""
    width = max(1, min(n, WIDTH, SLICE_BYTES // (8 * n)))
    most = min(n, max(BASIS, 2 * k + 2 * width))
    basis = _mapped(n, most)
    x = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((n, width)))[0]
    basis[:, :width] = x
    small, dim, step = np.zeros((0, 0)), width, 4096

    def turned(turn: np.ndarray, to: np.ndarray) -> None:
        for a in range(0, n, step):
            to[a : a + step, : turn.shape[1]] = basis[a : a + step, :dim] @ turn

    for _ in range(ROUNDS):
        y = _product(rows, x)
        own = basis[:, :dim]
        h = own.T @ y
        y -= own @ h
        again = own.T @ y
        y -= own @ again
        h += again
        grown = np.zeros((dim, dim))
        grown[: len(small), : len(small)] = small
        grown[:, dim - x.shape[1] :] = h
        grown[dim - x.shape[1] :, :] = h.T
        small = grown
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x_next, r = np.linalg.qr(y)
        # the basis times small is the Gram matrix times the basis but for its last columns, which miss x_next @ r
        left = np.linalg.norm(r @ turn[dim - x.shape[1] :], axis=0) if dim < n else np.zeros(dim)
        if dim >= k and (left[:k] <= TOLERANCE * max(values[0], 0.0)).all():
            v = _mapped(n, k)
            turned(turn[:, :k], v)
            return values[:k], v
        width = min(x.shape[1], n - dim)
        if dim + width > most:
            keep = min(dim, max(k + (most - k) // 3, k))
            turned(turn[:, :keep], basis)
            small, dim = np.diag(values[:keep]), keep
        # where the basis is invariant, x_next has directions that are no longer orthogonal to it
        own = basis[:, :dim]
        for _ in range(2):
            x_next -= own @ (own.T @ x_next)
            x_next = np.linalg.qr(x_next)[0]
        x = x_next[:, :width]
        basis[:, dim : dim + width] = x
        dim += width
    raise RuntimeError(f"LSA: {int((left[:k] > TOLERANCE * values[0]).sum())} of {k} singular vectors have not converged in {ROUNDS} rounds")


def _factors(rows: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """V (documents x k) and the singular values, greatest first."""
    if n <= GRAM_DOCS:

        def gram(batch: pa.RecordBatch, total: np.ndarray) -> None:
            for a in range(0, batch.num_rows, BLOCK):
                x = np.zeros((min(BLOCK, batch.num_rows - a), n))
                for i, (d, w) in enumerate(_lists(batch.slice(a, BLOCK))):
                    x[i, d] = w
                total += x.T @ x

        values, v = np.linalg.eigh(_summed(rows, (n, n), gram))
        values, v = values[::-1][:k], v[:, ::-1][:, :k]
    else:
        values, v = _lanczos(_condensed(rows), n, k)
    return v, np.sqrt(np.maximum(values, 0))


def _numbered(paths: DataFrame) -> DataFrame:
    """(path, doc): doc counts from 0 in the order of the paths."""
    rows = written(paths.orderBy("path").select("path", F.monotonically_increasing_id().alias("m")), "order").select("path", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("place"))
    starts, total = [], 0
    for r in sorted(rows.groupBy("part").count().collect()):
        starts.append((r.part, total))
        total += r["count"]
    return written(rows.join(F.broadcast(paths.sparkSession.createDataFrame(starts, "part bigint, start bigint")), "part").select("path", (F.col("start") + F.col("place")).alias("doc")), "numbered")


def _table(spark, v: np.ndarray) -> DataFrame:
    """(doc, vec) of a matrix's rows, written in runs of rows so that the driver never holds them all."""
    path = f"{shared_folder(spark)}/tables/v-{uuid.uuid4().hex}"
    for a in range(0, len(v), VECTORS):
        m = np.ascontiguousarray(v[a : a + VECTORS])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
        spark.createDataFrame(pa.table({"doc": pa.array(np.arange(a, a + len(m))), "vec": lists}), "doc bigint, vec array<double>").write.mode("append").parquet(path)
    return spark.read.schema("doc bigint, vec array<double>").parquet(path)


@dataclass
class LsaModel:
    """doc_vectors(path, vec); terms(term, idf, docs, weights) with numbers of fitted documents; v; sigma."""

    doc_vectors: DataFrame
    terms: DataFrame
    v: np.ndarray
    sigma: np.ndarray

    @classmethod
    def fit(cls, corpus: Corpus, k: int = DIMENSIONS, fit_docs: int | None = None) -> LsaModel:
        """On all documents; with fit_docs on so many of them, those first in the order of a hash of their path, and the others are folded in (at zero if they have no term of those)."""
        spark = corpus.docs.sparkSession
        docs = corpus.docs.where("text <> ''")
        post = written(postings(corpus), "postings")
        n_docs = docs.count()
        df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") < n_docs)
        idf = df.select("term", F.log(F.lit(float(n_docs)) / F.col("df")).alias("idf"))
        n = n_docs if fit_docs is None else min(n_docs, fit_docs)
        paths = _numbered(docs.select("path") if n == n_docs else docs.select("path").orderBy(F.xxhash64("path"), "path").limit(n))
        weighed = post.join(idf, "term").select("path", "term", (F.col("tf") * F.col("idf")).alias("weight"), "idf")
        numbered = weighed.join(paths, "path")
        grouped = numbered.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("doc", "weight")).alias("p"))
        rows = written(grouped.select("term", "idf", F.col("p.doc").alias("docs"), F.col("p.weight").alias("weights")), "terms")
        k = min(k, n)
        v, sigma = _factors(rows, n, k) if k else (np.zeros((0, 0)), np.zeros(0))
        model = cls(post.select("path").limit(0).select("path", F.array().cast("array<double>").alias("vec")), rows, v, sigma)
        if k:
            model.doc_vectors = paths.join(_table(spark, v), "doc").select("path", "vec")
            if n < n_docs:
                rest = docs.select("path").join(paths, "path", "left_anti")
                folded = model._folded(weighed.join(paths, "path", "left_anti"))
                zero = F.array_repeat(F.lit(0.0), k)
                model.doc_vectors = model.doc_vectors.union(rest.join(folded, "path", "left").select("path", F.coalesce("vec", zero).alias("vec")))
        return model

    @property
    def inverse(self) -> np.ndarray:
        """1 / sigma, 0 where sigma is negligible."""
        least = 1e-10 * max(1.0, self.sigma[0] if len(self.sigma) else 1.0)
        return np.where(self.sigma > max(least, 1e-7 * (self.sigma[0] if len(self.sigma) else 0)), 1 / np.maximum(self.sigma, 1e-300), 0)

    def term_vectors(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, idf, vec): rows of U, of the given terms alone if there are any. V is broadcast in slices of columns."""
        rows = self.terms if terms is None else written(self.terms.join(terms.select("term").distinct(), "term", "left_semi"), "terms")
        k = len(self.sigma)
        step = max(1, SLICE_BYTES // (8 * max(1, len(self.v))))
        slices = [self._sliced(rows, i, a, a + step) for i, a in enumerate(range(0, max(k, 1), step))]
        if len(slices) == 1:
            return slices[0].select("term", "idf", "vec")
        whole = reduce(DataFrame.union, slices).groupBy("term").agg(F.first("idf").alias("idf"), F.array_sort(F.collect_list(F.struct("i", "vec"))).alias("p"))
        return whole.select("term", "idf", F.flatten("p.vec").alias("vec"))

    def _sliced(self, rows: DataFrame, i: int, a: int, b: int) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(self.v[:, a:b]), self.inverse[a:b]))

        def run(frames):
            v, inverse = shared.value
            for f in frames:
                yield pd.DataFrame({"term": f.term, "idf": f.idf, "i": i, "vec": pd.Series([(w @ v[d]) * inverse for d, w in zip(f.docs, f.weights)], dtype=object)})

        return rows.mapInPandas(run, "term string, idf double, i int, vec array<double>")

    def _folded(self, weighed: DataFrame) -> DataFrame:
        """(path, vec) of documents from their (path, term, weight)."""
        parts = weighed.join(self.term_vectors().select("term", "vec"), "term").select("path", "weight", "vec")
        inverse = self.inverse

        def run(batches):
            """Sums of a batch's rows by document, so that fewer vectors are shuffled."""
            for batch in batches:
                x = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1) * batch.column("weight").to_numpy()[:, None]
                keys = batch.column("path").dictionary_encode()
                at = keys.indices.to_numpy()
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1])) if len(at) else np.empty(0, np.int64)
                sums = np.add.reduceat(x[order], first) * inverse if len(at) else x
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * len(inverse)), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(at[order][first])), lists], names=["path", "vec"])

        schema = parts.select("path", "vec").schema
        zero = F.array_repeat(F.lit(0.0), len(inverse))
        rows = parts.repartition("path").sortWithinPartitions("path").mapInArrow(run, schema)
        return rows.groupBy("path").agg(F.collect_list("vec").alias("all")).select("path", F.aggregate("all", zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)).alias("vec"))

    def project(self, text: str) -> np.ndarray:
        """The text's place in the space: its known terms' tf * idf through U, over sigma."""
        spark = self.terms.sparkSession
        words = spark.range(1).select(F.explode(tokens(F.lit(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
        found = self.terms.join(F.broadcast(words), "term").select("tf", "idf", "docs", "weights").toArrow()
        q = np.zeros(len(self.sigma))
        for batch in found.to_batches():
            for tf, idf, (d, w) in zip(batch.column("tf").to_pylist(), batch.column("idf").to_pylist(), _lists(batch)):
                q += tf * idf * (w @ self.v[d]) * self.inverse
        return q * self.inverse

    def rank(self, text: str) -> DataFrame:
        """(path, score) of every document: the cosine with the text, 0 where a norm is negligible."""
        q = self.project(text)
        norm = float(np.linalg.norm(q))
        shared = self.terms.sparkSession.sparkContext.broadcast(q)

        def run(frames):
            for f in frames:
                x = np.stack(f.vec.to_numpy()) if len(f) else np.zeros((0, len(q)))
                bottom = np.linalg.norm(x, axis=1) * norm
                yield pd.DataFrame({"path": f.path, "score": np.where(bottom < 1e-10, 0.0, x @ shared.value / np.maximum(bottom, 1e-300))})

        return self.doc_vectors.mapInPandas(run, self.doc_vectors.select("path").schema.add("score", DoubleType()))

    def save(self, path: str) -> None:
        self.doc_vectors.write.parquet(f"{path}/doc_vectors")
        self.terms.write.parquet(f"{path}/terms")
        spark = self.terms.sparkSession
        spark.createDataFrame([(json.dumps(self.sigma.tolist()), json.dumps(self.v.shape))], "sigma string, shape string").write.parquet(f"{path}/factors")
        for a in range(0, max(len(self.v), 1), VECTORS):
            spark.createDataFrame([(a, bytearray(np.ascontiguousarray(self.v[a : a + VECTORS]).tobytes()))], "start bigint, m binary").write.mode("append").parquet(f"{path}/v")

    @classmethod
    def load(cls, spark, path: str) -> LsaModel:
        row = spark.read.parquet(f"{path}/factors").first()
        n, k = json.loads(row.shape)
        v = _mapped(n, k) if n * k else np.zeros((n, k))
        for r in spark.read.parquet(f"{path}/v").toLocalIterator():
            v[r.start : r.start + VECTORS] = np.frombuffer(bytes(r.m)).reshape(-1, k)
        return cls(spark.read.parquet(f"{path}/doc_vectors"), spark.read.parquet(f"{path}/terms"), v, np.array(json.loads(row.sigma)))


def semantic_search(corpus: Corpus, query: str, model: LsaModel | None = None, top_docs: int = TOP_DOCS, top_lines: int = TOP_LINES) -> DataFrame:
    """(path, rank, score, line_number, line_content, line_score): the best documents, best first, with their best lines in the order of the text.

    Documents below 1e-8 are left out, and so are lines of fewer than 10 bytes; of equal scores
    the lesser path and the earlier line come first.
    """
    spark = corpus.docs.sparkSession
    model = LsaModel.fit(corpus) if model is None else model
    best = model.rank(query).where(F.col("score") >= LEAST_SCORE).orderBy(F.desc("score"), "path").limit(top_docs)
    order = written(best.selectExpr("*", "row_number() OVER (ORDER BY score DESC, path) AS rank"), "best")
    own = corpus.docs.join(F.broadcast(order), "path").select("path", "rank", "score", F.posexplode(lines(F.col("text"))).alias("i", "line_content"))
    own = own.where(F.octet_length(trimmed(F.col("line_content"))) >= LEAST_LINE)
    words = own.select("path", "i", F.explode(tokens(F.col("line_content"))).alias("term")).groupBy("path", "i", "term").agg(F.count(F.lit(1)).alias("tf"))
    words = written(words, "line_terms")
    q = model.project(query)
    shared = spark.sparkContext.broadcast((q, model.inverse))
    joined = words.join(model.term_vectors(words), "term")

    def score(f: pd.DataFrame) -> pd.DataFrame:
        q, inverse = shared.value
        x = ((f.tf * f.idf).to_numpy()[:, None] * np.stack(f.vec.to_numpy())).sum(0) * inverse
        bottom = np.linalg.norm(x) * np.linalg.norm(q)
        return pd.DataFrame({"path": f.path.iloc[:1], "i": f.i.iloc[:1], "line_score": [0.0 if bottom < 1e-10 else float(x @ q / bottom)]})

    scored = joined.groupBy("path", "i").applyInPandas(score, joined.select("path", "i").schema.add("line_score", DoubleType()))
    all_lines = own.join(scored, ["path", "i"], "left").withColumn("line_score", F.coalesce("line_score", F.lit(0.0)))
    top = all_lines.selectExpr("*", "row_number() OVER (PARTITION BY path ORDER BY round(line_score, 12) DESC, i) AS place").where(F.col("place") <= top_lines)
    return top.select("path", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"), (F.col("i") + 1).cast("bigint").alias("line_number"), "line_content", F.round("line_score", 6).alias("line_score")).orderBy("rank", "line_number")
