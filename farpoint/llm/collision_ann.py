"""Approximate nearest neighbours by collision counting on single projections."""

from __future__ import annotations

from math import erf, floor, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.llm.vectors import matrix, usable_rows
from farpoint.session import materialize

SEED = 5
# Random projections, each with a sorted array per block.
PROJECTIONS = 32
# Half a window in units of the radius: a point at the radius collides with chance P(|Z| <= WIDTH).
WIDTH = 1.0
# A point within the radius reaches the collision threshold but for about this many standard deviations (5 %).
DEVIATIONS = 1.645
# Radii of virtual rehashing: the first one and the factor between them; distances are at most 2.
FIRST_RADIUS, GROWTH = 0.3, 1.2
# Windows that gain more than one place in so many are counted by comparison.
DENSE_SHARE = 32
# Rows of the index and queries that a task holds.
INDEX_ROWS, QUERY_ROWS = 16_384, 1024


def collision_threshold(projections: int = PROJECTIONS) -> int:
    chance = erf(WIDTH / sqrt(2))
    return max(1, floor(projections * chance - DEVIATIONS * sqrt(projections * chance * (1 - chance))))


def radii() -> list[float]:
    """Radii by growth up to the largest distance, then one that takes in every point."""
    found = [FIRST_RADIUS]
    while found[-1] < 2:
        found.append(found[-1] * GROWTH)
    return [*found, float("inf")]


class BlockIndex:
    """Sorted projections of a block of vectors.

    Inner products become distances on the unit sphere: vectors are divided by the largest length of
    all, with one more coordinate that makes their length one; queries are divided by their own length.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, longest: float, projections: int, seed: int):
        self.ids, self.rows, self.longest = ids, rows, longest
        scaled = rows / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
        draw = np.random.default_rng([seed, rows.shape[1]])
        self.directions = draw.standard_normal((rows.shape[1] + 1, projections))
        hashed = scaled @ self.directions[:-1] + rest[:, None] * self.directions[-1]
        self.order = np.argsort(hashed, axis=0, kind="stable").astype(np.int32).T.copy()
        self.sorted = np.take_along_axis(hashed.T, self.order, axis=1)
        # Place of each row in each sorted array, in the narrowest type that holds a window of the whole block.
        places = np.arange(len(ids), dtype=np.min_scalar_type(len(ids)))
        self.place = np.empty(self.order.shape, dtype=places.dtype)
        np.put_along_axis(self.place, self.order, places[None, :], axis=1)
        self.threshold = collision_threshold(projections)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query, id, score) of the k nearest found for each query, nearest first.

        The window around a query's projection grows with the radius, in every projection; rows that fall
        into enough windows are verified. It ends when the k-th nearest verified row is within
        the radius; the last radius verifies every row.
        """
        length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        hashed = (queries / length[:, None]) @ self.directions[:-1]
        steps = radii()
        half = np.array(steps) * WIDTH
        low = np.empty((len(self.sorted), len(queries), len(steps)), dtype=np.int64)
        high = np.empty_like(low)
        for p, values in enumerate(self.sorted):
            low[p] = np.searchsorted(values, hashed[:, p, None] - half[None, :], side="left")
            high[p] = np.searchsorted(values, hashed[:, p, None] + half[None, :], side="right")
        for q, query in enumerate(queries):
            yield query_ids[q], *self._one(query_ids[q], query, length[q], low[:, q], high[:, q], steps, k)

    def _count(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray, lower: np.ndarray | None, higher: np.ndarray | None) -> None:
        """Bring each row's number of collisions from the windows ``lower`` to ``higher`` to those from ``low`` to ``high``.

        Narrow windows visit what they gain in the sorted arrays. Where they gain more than a share of the block, each row's place
        is compared with the bounds instead, which reads memory in order and gives the same counts.
        """
        if lower is None:
            lower = higher = low
        if (high - low - (higher - lower)).sum() * DENSE_SHARE < self.place.size:
            for order, a, b, c, d in zip(self.order, low, lower, higher, high):
                counts[order[a:b]] += 1
                counts[order[c:d]] += 1
            return
        counts[:] = 0
        # Below the lower bound the difference wraps around and is larger than any width.
        away, inside = np.empty_like(self.place[0]), np.empty(len(counts), dtype=bool)
        for place, a, b in zip(self.place, low.astype(self.place.dtype), (high - low).astype(self.place.dtype)):
            np.subtract(place, a, out=away)
            np.less(away, b, out=inside)
            np.add(counts, inside.view(np.uint8), out=counts)

    def _one(self, own: int, query: np.ndarray, length: float, low: np.ndarray, high: np.ndarray, steps: list[float], k: int):
        verified = self.ids == own
        counts = np.zeros(len(self.ids), dtype=np.min_scalar_type(len(self.order)))
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        for step, radius in enumerate(steps):
            self._count(counts, low[:, step], high[:, step], *((low[:, step - 1], high[:, step - 1]) if step else (None, None)))
            fresh = np.flatnonzero((counts >= self.threshold) & ~verified)
            if len(fresh):
                verified[fresh] = True
                score = np.take(self.rows, fresh, axis=0) @ query
                best_ids, best = nearest(np.concatenate([best_ids, self.ids[fresh]]), np.concatenate([best, score]), k)
            if len(best) >= k:
                distance = sqrt(max(0.0, 2 - 2 * best[k - 1] / (length * self.longest)))
                if distance <= radius:
                    break
        return best_ids, best


def nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def nearest_by_collisions(
    index: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    projections: int = PROJECTIONS,
    index_rows: int = INDEX_ROWS,
    query_rows: int = QUERY_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """The ``k`` rows of ``index`` with the largest inner product found for each query, but never its own id.

    Columns ``query_id``, ``rank`` from 1, the row's id and ``score``, in double precision. Index and
    queries are dealt into blocks of bounded size, each pair of blocks is searched in a task of
    its own, and the best of the blocks are merged. A row within the distance of the
    k-th nearest is missed in its block with a chance of about 5 %. Ties go to the smaller id. If there are fewer than ``k`` other rows,
    all are returned. NULL, empty, zero and non-finite vectors and rows without an id take no part, nor do vectors of
    another length than the query's. Rows that share an id are
    candidates of their own. An empty table gives an empty table. Other columns are not read.
    """
    held = materialize(usable_rows(index, id_column, vector), "index")
    asked = usable_rows(queries, id_column, vector)
    square = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows, longest = held.agg(F.count("*"), F.max(square)).first()
    if longest is None:
        longest = 1.0
    longest = sqrt(longest) * (1 + 1e-12)
    # Blocks of about equal size, by hash of the id.
    index_blocks = max(1, -(-rows // index_rows))
    query_blocks = max(1, -(-asked.count() // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, salt: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(n)).cast("int")
    size = F.size("_v").alias("_length")
    left = held.select("_id", "_v", size, deal(index_blocks, 1).alias("_i")).select("*", every(query_blocks).alias("_q"))
    right = asked.select("_id", "_v", size, deal(query_blocks, 2).alias("_q")).select("*", every(index_blocks).alias("_i"))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asked):
            rows = rows.sort_values("_id")
            block = BlockIndex(rows["_id"].to_numpy(), matrix(rows["_v"]), longest, projections, seed)
            for query, ids, scores in block.search(asked["_id"].to_numpy(), matrix(asked["_v"]), k):
                found.append(pd.DataFrame({"query_id": query, "_id": ids, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "_id": [], "score": []})

    keys = ["_i", "_q", "_length"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id bigint, _id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_id"))
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("_id").alias(id_column), "score")
