"""Exact top-k by inner product with a pivot-distance index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import save
from quaylight.llm.vectors import best, search, valid

#: Pivots are the rows smallest by a hash of their id.
PIVOTS = 64
ANNULUS_ROWS = 256


class PivotIndex:
    """Rows keyed by (nearest pivot, distance to it), sorted, and cut into annuli.

    With |q - x| >= |d(q, p) - d(x, p)| for every pivot p, an annulus holds no inner product above
    (|q|^2 + largest |x|^2 - gap^2) / 2, where gap is the widest over all pivots. `seen` counts the rows scored.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int):
        self.pivots, self.k, self.seen = pivots, k, 0
        norm = (x * x).sum(1)
        square = np.maximum(norm[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T), 0)
        key = square.argmin(1)
        far = np.sqrt(square[np.arange(len(x)), key])
        order = np.lexsort((ids, far, key))
        self.ids, self.x, key, far, norm = ids[order], x[order], key[order], far[order], norm[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        within = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        self.first = np.flatnonzero(within % ANNULUS_ROWS == 0)
        self.end = np.append(self.first[1:], len(x))
        every = np.sqrt(square[order])
        self.near, self.far = np.minimum.reduceat(every, self.first), np.maximum.reduceat(every, self.first)
        self.norm = np.maximum.reduceat(norm, self.first)

    def __call__(self, query_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.sqrt(((self.pivots - query) ** 2).sum(1))
        gap = np.maximum(np.maximum(self.near - own, own - self.far), 0).max(1)
        size = query @ query
        bound = (size + self.norm - gap * gap) / 2
        bound += 1e-9 * (size + self.norm + gap * gap) + 1e-6 * (1 + gap)  # distances are rounded
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bound, kind="stable")
        for i in range(0, len(order), 4):
            if len(ids) == self.k and bound[order[i]] < scores[-1]:
                break
            rows = np.concatenate([np.arange(self.first[a], self.end[a]) for a in order[i : i + 4]])
            self.seen += len(rows)
            rows = rows[self.ids[rows] != query_id]
            ids, scores = best(np.concatenate((ids, self.ids[rows])), np.concatenate((scores, self.x[rows] @ query)), self.k)
        return ids, scores


def quantised(vectors: DataFrame) -> DataFrame:
    """Valid vectors with each component x as floor(256 * x)."""
    return valid(vectors, zero=True).select("vec_id", F.transform("embedding", lambda x: F.floor(x * 256).cast("double")).alias("embedding"))


def top_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (long): exactly the k largest integer inner products for rows whose vec_id is divisible by `every`.

    With fewer than k candidates all are returned; ties go to smaller ids; zero vectors take part; an empty table gives
    no rows. Sums are exact in doubles while they stay below 2^53.
    """
    rows = save(quantised(vectors).distinct())
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    pivots = rows.sparkSession.sparkContext.broadcast(np.unique(np.stack(sample.to_list()), axis=0))
    return search(rows, rows.where(F.col("vec_id") % every == 0), k, lambda ids, x: PivotIndex(ids, x, pivots.value, k), "long")
