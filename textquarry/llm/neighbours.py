"""Nearest neighbours of every vector by vantage-point trees, one to a shard.

Pivots drawn by a hash of the id cut the vectors into cells, cells too large for one tree into
shards. A shard's tree splits its points by the median distance from a vantage point. A query
searches its own shard first; the distance of its k-th neighbour there is the radius with which
the triangle inequality rules out other shards, and then subtrees. Every lower bound is
multiplied by `factor` before it is compared: at 1 nothing that could hold a neighbour is ruled
out and the search is exact, larger factors rule out more and may miss some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import stored

#: Neighbours of a vector; what lower bounds are multiplied by.
NEIGHBOURS, FACTOR = 10, 1.0
#: Points of a shard about, pivots at most (they are broadcast), queries that meet a shard at once, points of a leaf.
SHARD, PIVOTS, QUERIES, LEAF = 16_384, 4096, 32_768, 256
#: Shards of a cell at most, pairs of query and shard that are handed on at once.
PARTS, ROUTES = 1_000_000, 65_536
#: The query set of op10: vectors whose id is divisible by it.
EVERY = 50
#: Squared distances count to so many decimals, distances that bounds are compared with are this much longer: rounding then never rules out an equal neighbour.
DECIMALS, SLACK = 9, 5e-5
_FOUND = "vec_id bigint, ids array<bigint>, squares array<double>"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b, not negative."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(d, 0, out=d)


class Tree:
    """A vantage-point tree as nested tuples: (vantage, median, inside, outside), or the numbers of a leaf's points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.ids, self.points, self.leaf = ids, points, leaf
        self.halves = (points * points).sum(1) / 2
        self.visited = 0
        self.root = self._build(np.arange(len(ids)))

    def _build(self, own: np.ndarray):
        if len(own) <= self.leaf:
            return own
        # the point farthest from the first one sees the others at the most different distances
        vantage = self.points[own[int(squared(self.points[own[:1]], self.points[own])[0].argmax())]]
        d = np.sqrt(squared(vantage[None], self.points[own])[0])
        order = np.argsort(d, kind="stable")
        half = len(own) // 2
        if d[order[0]] == d[order[-1]]:
            return own  # equal points: no distance divides them
        return vantage, float(d[order[half]]), self._build(own[order[:half]]), self._build(own[order[half:]])

    def search(self, own: np.ndarray | None, queries: np.ndarray, k: int, factor: float, radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of each query's k nearest points, those of the own id left out; -1 and inf where there are fewer. radius: squared distance beyond which nothing is wanted."""
        n = len(queries)
        ids, squares = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
        limit = np.full(n, np.inf) if radius is None else radius.copy()

        norms, k_all = (queries * queries).sum(1), k + (own is not None)

        def keep(rows: np.ndarray, names: np.ndarray, d: np.ndarray) -> None:
            """Merges found (query, id, squared distance) triples into the lists."""
            order = np.lexsort((names, d, rows))
            rows, names, d = rows[order], names[order], d[order]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            size = np.diff(np.append(first, len(rows)))
            place = np.arange(len(rows)) - np.repeat(first, size)
            line = np.repeat(np.arange(len(first)), size)
            new_i, new_d = np.full((len(first), k), -1, np.int64), np.full((len(first), k), np.inf)
            best = place < k
            new_i[line[best], place[best]], new_d[line[best], place[best]] = names[best], d[best]
            rows = rows[first]
            all_d, all_i = np.concatenate([squares[rows], new_d], 1), np.concatenate([ids[rows], new_i], 1)
            order = np.lexsort((all_i, all_d), axis=1)[:, :k]
            squares[rows], ids[rows] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            limit[rows] = np.minimum(limit[rows], squares[rows, -1])

        def leaf(points: np.ndarray, at: np.ndarray) -> None:
            for a in range(0, len(points), 4 * self.leaf):  # leaves of equal points may be large
                part = points[a : a + 4 * self.leaf]
                self.visited += len(part) * len(at)
                x = self.points[part]
                # the product less half the point's norm falls as the distance grows
                near = queries[at] @ x.T
                near -= self.halves[part]
                slack = 1e-9 + 1e-12 * (norms[at] + 2 * float(self.halves[part].max()))
                least = (norms[at] - limit[at]) / 2 - slack
                free = np.flatnonzero(~np.isfinite(limit[at]))
                if len(free) and len(part) > k_all:
                    least[free] = np.partition(near[free], len(part) - k_all, axis=1)[:, len(part) - k_all] - slack[free]
                r, c = np.nonzero(near >= least[:, None])
                rows, names = at[r], self.ids[part][c]
                gap = queries[rows] - x[c]
                d = np.round(np.einsum("ij,ij->i", gap, gap), DECIMALS)
                good = d <= limit[rows]
                if own is not None:
                    good &= names != own[rows]
                if good.any():
                    keep(rows[good], names[good], d[good])

        def descend(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                leaf(node, at)
                return
            vantage, median, inside, outside = node
            d = np.sqrt(squared(queries[at], vantage[None])[:, 0]) - median
            for first, then, mine in ((inside, outside, d < 0), (outside, inside, d >= 0)):
                here, gap = at[mine], np.abs(d[mine])
                descend(first, here)
                descend(then, here[gap * factor <= np.sqrt(limit[here]) + SLACK])

        for a in range(0, n, 4096):
            descend(self.root, np.arange(a, min(a + 4096, n)))
        ids[~np.isfinite(squares)] = -1
        return ids, squares


def _frame(own: np.ndarray, ids: np.ndarray, squares: np.ndarray) -> pd.DataFrame:
    good = ids >= 0
    lists = {n: pd.Series([x[g] for x, g in zip(v, good)], dtype=object) for n, v in (("ids", ids), ("squares", squares))}
    return pd.DataFrame({"vec_id": own, **lists})


def _sharded(vectors: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """The vectors with their cell, shard and distance from the cell's pivot; the pivots."""
    n = vectors.count()
    if not n:
        return vectors.selectExpr("vec_id", "embedding", "0L cell", "0D far", "0L shard"), np.zeros((0, 0))
    wanted = min(PIVOTS, -(-n // size))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()
    pivots = np.array([r.embedding for r in chosen], np.float64).reshape(len(chosen), -1)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cells, far = np.zeros(len(f), np.int64), np.zeros(len(f))
            for a in range(0, len(f), 2048):
                d = squared(np.stack(f.embedding.iloc[a : a + 2048].to_numpy()), shared.value)
                cells[a : a + 2048], far[a : a + 2048] = d.argmin(1), np.sqrt(d.min(1))
            yield pd.DataFrame({"vec_id": f.vec_id, "embedding": f.embedding, "cell": cells, "far": far})

    placed = stored(vectors.mapInPandas(place, "vec_id bigint, embedding array<double>, cell bigint, far double"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    # PIVOTS cells at most
    split = placed.join(F.broadcast(sizes), "cell").withColumn("shard", F.col("cell") * PARTS + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")))
    return stored(split.drop("parts"), "shards"), pivots


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR, size: int = SHARD, leaf: int = LEAF, queries: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): for every vector its k nearest others by Euclidean distance, from rank 1. queries: a condition on vec_id; only vectors that meet it are searched for, among all.

    Squared distances count to nine decimals; of equal ones the lower id comes first. Vectors
    with null or unfit entries (NaN, infinite), null or empty ones, those with a null id and
    those whose length isn't the commonest one (of equally common lengths the longest) take no
    part. Rows with one id are one vector, the least of them. Different ids with one and the same
    vector are neighbours at distance 0. A table of fewer than k + 1 vectors gives shorter
    lists, an empty one an empty result. Other columns are ignored whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good)
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = stored(rows, "vectors")
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    points, pivots = _sharded(rows.where(F.size("embedding") == (common.d if common else 0)), size)

    points = points.withColumn("asked", F.lit(True) if queries is None else F.coalesce(queries, F.lit(False)))

    def home(f: pd.DataFrame) -> pd.DataFrame:
        q = f[f.asked]
        if not len(q):
            return _frame(np.empty(0, np.int64), np.empty((0, k), np.int64), np.empty((0, k)))
        tree = Tree(f.vec_id.to_numpy(), np.stack(f.embedding.to_numpy()), leaf)
        ids = q.vec_id.to_numpy()
        return _frame(ids, *tree.search(ids, np.stack(q.embedding.to_numpy()), k, factor))

    # a row a cell, PIVOTS at most
    bounds = points.groupBy("cell").agg(F.max("far").alias("far"), (F.max("shard") % PARTS + 1).alias("parts")).orderBy("cell").collect()
    first = points.groupBy("shard").applyInPandas(home, _FOUND)
    if sum(b.parts for b in bounds) > 1:
        first = stored(first, "near")
        radius = F.when(F.size("squares") == k, F.element_at("squares", -1)).otherwise(F.lit(float("inf")))
        # a query alone in its shard has found nothing there
        asked = points.where("asked").join(first.select("vec_id", radius.alias("radius")), "vec_id", "left").fillna(float("inf"), "radius")
        shared = spark.sparkContext.broadcast((pivots, np.array([b.cell for b in bounds]), np.array([b.far for b in bounds]), np.array([b.parts for b in bounds])))

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, cells, far, parts = shared.value
            for frame in frames:
                for a in range(0, len(frame), 512):
                    f = frame.iloc[a : a + 512]
                    d = np.sqrt(squared(np.stack(f.embedding.to_numpy()), pivots))
                    # outside the ball around a cell's pivot; beyond the plane between two pivots
                    least = np.maximum(d[:, cells] - far[None], (d[:, cells] - d.min(1)[:, None]) / 2)
                    reach = np.sqrt(f.radius.to_numpy())[:, None] + SLACK
                    q, c = np.nonzero(least * factor <= reach)
                    ids, radius, embedding, own = (f[x].to_numpy() for x in ("vec_id", "radius", "embedding", "shard"))
                    # the shards of the cells, in runs
                    ends = np.cumsum(parts[c])
                    for lo in range(0, int(ends[-1]) if len(ends) else 0, ROUTES):
                        at = np.arange(lo, min(lo + ROUTES, int(ends[-1])))
                        row = np.searchsorted(ends, at, side="right")
                        shard = cells[c[row]] * PARTS + at - (ends - parts[c])[row]
                        row, shard = q[row][other := shard != own[q[row]]], shard[other]
                        yield pd.DataFrame({"shard": shard, "vec_id": ids[row], "radius": radius[row], "embedding": embedding[row]})

        routes = stored(asked.mapInPandas(route, "shard bigint, vec_id bigint, radius double, embedding array<double>"), "routes")
        groups = F.broadcast(stored(routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("groups")), "groups"))
        asking = routes.join(groups, "shard").select("shard", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("groups")).alias("part"), "vec_id", "radius", "embedding")
        answering = points.join(groups, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("part"), "vec_id", "embedding")

        def visit(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(p):
                return _frame(np.empty(0, np.int64), np.empty((0, k), np.int64), np.empty((0, k)))
            tree = Tree(p.vec_id.to_numpy(), np.stack(p.embedding.to_numpy()), leaf)
            return _frame(q.vec_id.to_numpy(), *tree.search(None, np.stack(q.embedding.to_numpy()), k, factor, q.radius.to_numpy()))

        first = first.unionByName(asking.groupBy("shard", "part").cogroup(answering.groupBy("shard", "part")).applyInPandas(visit, _FOUND))
    pairs = F.flatten(F.collect_list(F.arrays_zip(F.col("squares"), F.col("ids"))))
    best = first.groupBy("vec_id").agg(F.slice(F.array_sort(pairs), 1, k).alias("near"))
    return best.select("vec_id", F.posexplode("near").alias("p", "x")).select("vec_id", (F.col("p") + 1).cast("bigint").alias("rank"), F.col("x.ids").alias("neighbour_id"), F.sqrt("x.squares").alias("distance"))


#: neighbours() with its defaults of the vectors whose id is divisible by EVERY, among all, for DuckDB; the search is exact at FACTOR 1.
SQL = f"""
WITH e AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
d AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), {DECIMALS}) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, neighbour_id) AS rank FROM d)
SELECT vec_id, rank, neighbour_id, sqrt(s) AS distance FROM r WHERE rank <= {NEIGHBOURS}
"""
