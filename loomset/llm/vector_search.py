"""Exact top-k by inner product with a pivot-distance index.

Vectors are lifted to points at one distance from the origin, so that the largest inner
product is the smallest distance. Each point is keyed by its nearest pivot and its
distance to it; a search expands the sorted annuli around the pivots and stops where the
triangle inequality rules out the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.workers import share
from loomset.sources.storage import stored

#: The pivots and first bounds come from so many vectors at most, the first by the hash of their id.
SAMPLE = 2048
PIVOTS = 64
#: Vectors of an index block, rows of an annulus within it, and queries of a block.
BLOCK = 16_384
ANNULUS = 512
QUERY_BLOCK = 1024
#: Ranges of the index that all workers know; larger indexes have several blocks a range.
MAX_SPANS = 500_000
#: Above this bound on a sum of products, doubles are not exact and integers are used.
EXACT = 2.0**52
#: Below every score, and its negative is a number too.
LOWEST = -(2**62)


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, null where one is null or not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different points, each the farthest from those before it."""
    chosen = [0] if len(points) else []
    far = np.linalg.norm(points - points[0], axis=1) if len(points) else np.zeros(0)
    while 0 < len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def _lift(vectors: np.ndarray, radius2: float) -> np.ndarray:
    """Points at the distance ``sqrt(radius2)`` from the origin, one component longer."""
    x = vectors.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(radius2 - (x * x).sum(1), 0.0))])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(1)[None]
    return np.sqrt(np.maximum(square, 0.0))


class Searcher:
    """The pivots, the lift and the first bounds that all tasks share; its size is fixed."""

    def __init__(self, sample_ids: np.ndarray, sample: np.ndarray, radius2: float, k: int):
        self.width, self.radius2, self.k = sample.shape[1], radius2, k
        self.sample_ids, self.sample = sample_ids, sample
        self.pivots = choose_pivots(_lift(sample, radius2), PIVOTS)
        #: what rounding can add to a distance between lifted points
        self.slack = 1e-6 * math.sqrt(max(radius2, 1.0)) + 1e-3

    def key(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest pivot and the distance to it."""
        far = _distances(_lift(vectors, self.radius2), self.pivots)
        near = far.argmin(1)
        return near, far[np.arange(len(far)), near]

    def first_bounds(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """A score that each query's k-th best is not below, from the sample's other vectors."""
        scores = _product(queries, self.sample)
        scores = np.where(ids[:, None] == self.sample_ids[None], LOWEST, scores)
        if scores.shape[1] < self.k:
            return np.full(len(queries), LOWEST)
        return np.partition(scores, -self.k, axis=1)[:, -self.k]

    def reach(self, ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances to the pivots, the distance within which each query's best can be)."""
        q2 = (queries.astype(float) ** 2).sum(1)
        lifted = np.column_stack([queries.astype(float), np.zeros(len(queries))])
        bound = self.first_bounds(ids, queries).astype(float)
        radius = np.sqrt(np.maximum(self.radius2 + q2 - 2.0 * bound + self.slack, 0.0)) + self.slack
        return _distances(lifted, self.pivots), radius

    def search(self, ids: np.ndarray, vectors: np.ndarray, pivot: np.ndarray, dist: np.ndarray,
               query_ids: np.ndarray, queries: np.ndarray) -> pd.DataFrame:
        """The best of one index block for each query: sorted annuli, nearest bound first."""
        order = np.lexsort((ids, dist, pivot))
        ids, vectors, pivot, dist = ids[order], vectors[order], pivot[order], dist[order]
        cuts = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1])))
        cuts = np.unique(np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]))
        ends = np.append(cuts[1:], len(ids))
        q2 = (queries.astype(float) ** 2).sum(1)
        lifted = np.column_stack([queries.astype(float), np.zeros(len(queries))])
        # no point of an annulus is nearer to a query than this, by any of the pivots
        to_pivot, far = _distances(lifted, self.pivots), _distances(_lift(vectors, self.radius2), self.pivots)
        near, far = np.minimum.reduceat(far, cuts), np.maximum.reduceat(far, cuts)
        low = np.zeros((len(queries), len(cuts)))
        for p in range(len(self.pivots)):
            d = to_pivot[:, p : p + 1]
            low = np.maximum(low, np.maximum(near[None, :, p] - d, d - far[None, :, p]))
        low -= self.slack
        bound = self.first_bounds(query_ids, queries)
        best_score = np.full((len(queries), self.k), LOWEST)
        best_id = np.full((len(queries), self.k), np.iinfo(np.int64).max)
        for at in low.min(0).argsort(kind="stable"):
            least = np.maximum(low[:, at], 0) ** 2
            # distance^2 = radius^2 + |q|^2 - 2 score, so a score above the bound needs a distance below this
            open_ = np.flatnonzero(least <= self.radius2 + q2 - 2.0 * bound.astype(float) + self.slack)
            if not len(open_):
                continue
            rows = slice(cuts[at], ends[at])
            scores = _product(queries[open_], vectors[rows])
            own = query_ids[open_][:, None] == ids[rows][None]
            both = np.concatenate([best_score[open_], np.where(own, LOWEST, scores)], axis=1)
            names = np.concatenate([best_id[open_], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids[rows], scores.shape))], axis=1)
            top = np.lexsort((names, -both), axis=1)[:, : self.k]
            best_score[open_] = np.take_along_axis(both, top, 1)
            best_id[open_] = np.take_along_axis(names, top, 1)
            bound[open_] = np.maximum(bound[open_], best_score[open_][:, -1])
        found = best_id != np.iinfo(np.int64).max
        rows, _ = np.nonzero(found)
        return pd.DataFrame({"query_id": query_ids[rows], "vec_id": best_id[found], "score": best_score[found]})


class Spans:
    """Ranges of the index: for each pivot its ranges of distances, in order. They are disjoint."""

    def __init__(self, rows: pd.DataFrame, pivots: int):
        self.of = []
        for p in range(pivots):
            own = rows[rows["pivot"] == p].sort_values(["low", "high"])
            self.of.append((own["low"].to_numpy(float), np.maximum.accumulate(own["high"].to_numpy(float)), own["span"].to_numpy(np.int64)))

    def within(self, to_pivot: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, span) of all ranges that a query's ball can meet, each once."""
        found = [np.zeros((0, 2), np.int64)]
        for p, (low, high, span) in enumerate(self.of):
            first = np.searchsorted(high, to_pivot[:, p] - radius, side="left")
            last = np.searchsorted(low, to_pivot[:, p] + radius, side="right")
            n = np.maximum(last - first, 0)
            query = np.repeat(np.arange(len(radius)), n)
            at = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            found.append(np.column_stack([query, span[at]]) if len(span) else found[0])
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


def reached_blocks(index: DataFrame, asked: DataFrame, get, width: int) -> DataFrame:
    """(block, id, x): each query with every block of the index that may hold one of its best."""
    blocks = index.agg(F.max("block")).first()[0] + 1
    size = -(-blocks // MAX_SPANS)
    span = F.floor(F.col("block") / F.lit(size)).alias("span")
    spans = index.groupBy(span, "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).toPandas()
    known = share(index.sparkSession, spans)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = Spans(known(), len(get().pivots))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                query, found = ranges.within(*get().reach(part["id"].to_numpy(np.int64), _matrix(part["x"], width)))
                for i in range(0, len(query), 4096):
                    some = part.iloc[query[i : i + 4096]]
                    yield some.assign(span=found[i : i + 4096])

    routed = asked.mapInPandas(route, "id long, x array<long>, span long")
    first = F.col("span") * F.lit(size)
    last = F.least(first + F.lit(size - 1), F.lit(blocks - 1).cast("long"))
    return routed.select(F.explode(F.sequence(first, last).cast("array<int>")).alias("block"), "id", "x")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` largest integer inner products.

    Candidates are all rows but those with the query's own id; ties go to the smaller id.
    Rows whose id or vector is null, or whose vector has a null or infinite component, take
    no part. Shorter vectors count as filled up with zeros, so an empty one scores 0.
    Repeated rows are candidates each; a repeated query is answered once. Fewer than ``k``
    candidates are all returned.

    A query goes only to the blocks of the index that the triangle inequality leaves open for the bound
    that the sample gives. A block is copied once for every 1,024 queries that reach it, and one that none reaches
    not at all: no task sees more, and each returns at most ``k`` rows a query. Only the pivots, a
    sample of fixed size and at most MAX_SPANS ranges of the index are shared.
    """
    rows = vectors.filter(is_query.isNotNull()).select(
        F.col(key).alias("id"), whole_numbers(F.col(vector)).alias("x"), is_query.alias("is_query")
    )
    rows = stored(rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull()), "whole-vectors")
    square = F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, radius2, queries = rows.agg(
        F.count(F.lit(1)), F.max(F.size("x")), F.max(square), F.sum(F.col("is_query").cast("long"))
    ).first()
    schema = "query_id long, vec_id long, score long"
    if not n or not queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    # by a bound of the hash that the number of rows gives, so that tasks send no more than is drawn
    bound = int(min(1.0, 1.5 * SAMPLE / n) * (1 << 52))
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 52)) < bound).groupBy("id").agg(F.min("x").alias("x"))
    drawn = some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    made = Searcher(drawn["id"].to_numpy(np.int64), _matrix(drawn["x"], width), float(radius2), k)
    get = share(vectors.sparkSession, made)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                pivot, dist = get().key(_matrix(part["x"], width))
                yield part.assign(pivot=pivot, dist=dist)[["id", "x", "pivot", "dist"]]

    index = rows.select("id", "x").mapInPandas(keyed, "id long, x array<long>, pivot long, dist double")
    # ranges of pivot and distance; equal vectors are told apart by their ids
    index = index.repartitionByRange(math.ceil(n / BLOCK), "pivot", "dist", "id").withColumn("block", F.spark_partition_id())
    index = stored(index, "pivot-index")
    asked = rows.filter("is_query").dropDuplicates(["id"]).select("id", "x")
    routed = stored(reached_blocks(index, asked, get, width), "routed-queries")
    parts = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("parts"))
    parts = stored(parts, "block-parts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    left = index.join(parts, "block").select("block", copies, "id", "x", "pivot", "dist")
    own = F.pmod(F.xxhash64("id"), F.col("own_parts")).alias("part")
    right = routed.join(parts.withColumnRenamed("parts", "own_parts"), "block").select("block", own, "id", "x")

    def meet(part: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        return get().search(
            part["id"].to_numpy(np.int64), _matrix(part["x"], width), part["pivot"].to_numpy(), part["dist"].to_numpy(),
            queries["id"].to_numpy(np.int64), _matrix(queries["x"], width),
        )

    by = ["block", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
