"""What both vector searches share: valid vectors, shards that meet the query set in blocks, and the merge of their best."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.llm.common import save

#: Rows of a shard and queries of a block: a task holds a shard while a block passes by.
SHARD_ROWS, BLOCK_QUERIES = 16_384, 1_000


def valid(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and embedding (array<double>) of vectors that take part.

    Left out: null vectors, those with null or non-finite components, null ids, zero vectors unless `zero`, and those
    not of the commonest dimension (of equally common ones the largest), with which no inner product is defined. Rows
    that repeat id and vector count once.
    """
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    x = x.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & (F.size("embedding") > 0))
    if not zero:
        x = x.where(F.exists("embedding", lambda v: v != 0))
    common = x.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.where(F.size("embedding") == (common["d"] if common else 0)).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = np.asarray(column.flatten())
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def search(rows: DataFrame, queries: DataFrame, k: int, index: Callable[[np.ndarray, np.ndarray], Callable], score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows but those with the query's own id.

    index(ids, vectors) makes a shard's index: a function of (query id, query vector) that gives ids and scores, best
    first, k at most. Every query visits every shard; a task holds a shard whole, a block of queries comes behind it.
    """
    rows = save(rows)
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    queries = save(queries)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    shard, block = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)), F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(blocks))
    held = rows.select(every(blocks).alias("b"), shard.alias("s"), "vec_id", "embedding").select((F.col("s") * blocks + F.col("b")).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "embedding")
    asked = queries.select(every(shards).alias("s"), block.alias("b"), "vec_id", "embedding").select((F.col("s") * blocks + F.col("b")).cast("int").alias("shard"), F.lit(1).alias("kind"), "vec_id", "embedding")
    # a task for each pair of a shard and a block, up to as many tasks as are at hand a few times over
    tasks = min(shards * blocks, max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards))
    both = held.union(asked).repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, probe = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, kind = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                some, x = np.asarray(batch.column("vec_id").slice(a, b - a)), matrix(batch.column("embedding").slice(a, b - a))
                if shard[a] != now:
                    now, ids, vectors, probe = shard[a], [], [], None
                if kind[a] == 0:
                    ids.append(some)
                    vectors.append(x)
                    continue
                if probe is None and ids:
                    probe = index(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors = [np.zeros(0, np.int64)], []
                if probe is not None:
                    out += [(q, *probe(q, v)) for q, v in zip(some.tolist(), x)]
            if out:
                sizes = [len(i) for _, i, _ in out]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat([q for q, _, _ in out], sizes).astype(np.int64), "vec_id": np.concatenate([i for _, i, _ in out]).astype(np.int64), "score": np.concatenate([s for _, _, s in out]).astype(np.int64 if score_type == "long" else float)})

    found = both.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]
