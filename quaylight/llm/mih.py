"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import save
from quaylight.llm.vectors import best, search, valid

BITS, SUBSTRING = 64, 8
#: Vectors that the rotation is learned from (those smallest by a hash of their id), and rounds of it.
TRAIN_VECTORS, ROUNDS = 10_000, 15
#: The radius holds this share of a sample's true neighbours.
CALIBRATE = 0.93


@dataclass
class Codes:
    """Centre, rotation to bits, and the Hamming radius that queries ask for."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int = 0

    def of(self, x: np.ndarray) -> np.ndarray:
        """A row of bits packed to bytes for each vector; each byte is a substring."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def learn(x: np.ndarray, k: int, queries: int = 200) -> Codes:
    """Principal directions, rotated so that signs lose least (iterative quantisation); then the radius is calibrated."""
    norm = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    bits = min(BITS, x.shape[1])
    mean = norm.mean(0)
    _, vectors = np.linalg.eigh(np.cov(norm - mean, rowvar=False).reshape(x.shape[1], -1) if len(x) > 1 else np.eye(x.shape[1]))
    main = vectors[:, ::-1][:, :bits]
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
    low = (norm - mean) @ main
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    codes = Codes(mean, main @ turn)
    packed = codes.of(norm)
    near = []
    for i in range(0, len(x), max(1, len(x) // queries)):
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argsort(-s)[: min(k, len(x) - 1)]
        near.append(np.bitwise_count(packed[top] ^ packed[i]).sum(1))
    every = np.concatenate(near) if near else np.zeros(0)
    codes.radius = int(np.ceil(np.quantile(every, CALIBRATE))) if len(every) else bits
    return codes


def masks(bits: int) -> list[np.ndarray]:
    """Differences of a substring by how many bits they have."""
    every = np.arange(1 << bits)
    count = np.bitwise_count(every)
    return [every[count == d] for d in range(bits + 1)]


class MultiIndex:
    """Rows sorted by each substring. Two codes within radius r agree in some substring up to r // substrings bits."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes, k: int):
        self.ids, self.x, self.codes, self.k = ids, x, codes, k
        norm = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        self.packed = codes.of(norm)
        self.m = self.packed.shape[1]
        self.order = [np.argsort(self.packed[:, s], kind="stable") for s in range(self.m)]
        self.starts = [np.searchsorted(self.packed[o, s], np.arange(257)) for s, o in enumerate(self.order)]
        self.masks = masks(SUBSTRING)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most `radius` bits."""
        flips = np.concatenate(self.masks[: min(radius // self.m, SUBSTRING) + 1])
        seen = np.zeros(len(self.ids), bool)
        for s in range(self.m):
            values = int(code[s]) ^ flips
            a, b = self.starts[s][values], self.starts[s][values + 1]
            size = b - a
            stop = np.cumsum(size)
            seen[self.order[s][np.arange(stop[-1]) + np.repeat(a - (stop - size), size)]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.packed[rows] ^ code).sum(1) <= radius]

    def __call__(self, query_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = self.codes.of((query / max(np.linalg.norm(query), 1e-300))[None])[0]
        others = int((self.ids != query_id).sum())
        radius = self.codes.radius
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != query_id]
            if len(rows) >= min(self.k, others):
                return best(self.ids[rows], (self.x[rows] * query).sum(1), self.k)
            radius += self.m  # a shard with fewer codes so near is searched wider


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: near the k largest inner products for rows whose vec_id is divisible by `every`.

    All rows are indexed. With fewer than k candidates all are returned; ties go to smaller ids; an empty table gives
    no rows. Vectors that take no part: see valid().
    """
    rows = save(valid(vectors, zero=False))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_VECTORS).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    codes = rows.sparkSession.sparkContext.broadcast(learn(np.stack(sample.to_list()), k))
    return search(rows, rows.where(F.col("vec_id") % every == 0), k, lambda ids, x: MultiIndex(ids, x, codes.value, k), "double")
