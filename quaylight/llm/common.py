"""Shared plumbing: cluster-visible storage, Arrow buffers as numpy, word hashing, connected components."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised byte scans; one longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Records in an Arrow batch, so that a batch of ordinary texts stays at a few MB.
ARROW_RECORDS = 1000
#: Bytes in an Arrow batch that goes to a worker, for rows that aren't ordinary; one longer row is a batch alone.
ARROW_BYTES = 4 << 20
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one if all tasks run in this process's machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quaylight-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quaylight-{uuid.uuid4().hex}"
    where, fs = _hadoop(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path if "://" in path else "file://" + path if path.startswith("/") else path


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


#: Removes a write's shuffle files with its end; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where save() notes its tables, inside of made_within().
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("_MADE", default=None)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@contextmanager
def made_within() -> Iterator[list[DataFrame]]:
    """The tables that save() makes inside, for a caller that discards them once it has written its result."""
    made: list[DataFrame] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def save(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write once to shared storage and read again: cuts lineage, and survives lost executors. The write's shuffle files go.

    done: tables saved before that nothing but this write still needed; their files go.
    """
    folder = shared_dir(df.sparkSession)
    with _shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(f"{folder}/table")
    discard(*done)
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")
    out._saved_in = folder
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def save_bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """As save(), but in buckets of a column: what is grouped or joined by it then needs no shuffle of this table."""
    folder, name = shared_dir(df.sparkSession), f"quaylight_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, column).option("path", f"{folder}/table").saveAsTable(name)
    out = df.sparkSession.table(name)
    out._saved_in, out._saved_as = folder, name
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that save() gave and that nothing needs any more."""
    for table in tables:
        if folder := getattr(table, "_saved_in", None):
            where, fs = _hadoop(table.sparkSession, folder)
            fs.delete(where, True)
            table._saved_in = None
            if name := getattr(table, "_saved_as", None):
                table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_RECORDS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: What clears the tables that operators keep in a Python worker from task to task.
WORKER_TABLES: list[Callable[[], object]] = []


def free_tables() -> None:
    """Called by tasks of operators without such tables: Spark reuses workers, which else hold those of the stage before."""
    for clear in WORKER_TABLES:
        clear()
    release_memory()


def release_memory() -> None:
    """Gives back to the system what this worker has freed. Arrow's pool and the C heap keep it otherwise, beside the other worker's and the JVM's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def numbers(column: pa.Array, dtype=np.int64) -> np.ndarray:
    return np.asarray(pc.fill_null(column, 0)).astype(dtype, copy=False)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and each row's first and last offset; null counts as empty."""
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes; every row is in exactly one."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def runs_of(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay inside a row: starts, ends, and each row's first run."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    starts = np.flatnonzero(member & (edge[:-1] | ~np.concatenate(([False], member[:-1]))))
    ends = np.flatnonzero(member & (edge[1:] | ~np.concatenate((member[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 2048


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte span, equal for equal bytes at any place. Eight bytes at a time are mixed in, so neither is a polynomial."""
    padded = np.concatenate((values, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(values) + 1,), "<u8", buffer=padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(seed))
    g = h ^ U64(0xA0761D6478BD642F)
    long = np.flatnonzero(left > LONG_SPAN)
    live = np.flatnonzero(left <= LONG_SPAN) if len(long) else np.arange(len(left))
    at, left = starts[live], left[live]
    while len(live):
        word = eight[at] & _FIRST_BYTES[np.minimum(left, 8)]
        h[live] = mix(h[live] + word * U64(0x9E3779B97F4A7C55))
        g[live] = mix(g[live] ^ word) * U64(0x9FB21C651E98DF25)
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in long.tolist():
        digest = hashlib.blake2b(values[starts[i] : ends[i]].tobytes(), digest_size=16, key=seed.to_bytes(8, "little")).digest()
        h[i], g[i] = np.frombuffer(digest, "<u8")
    return h, g


LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
#: Space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys as tables; the input is sorted by them. Only one group and one batch are held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of bigints to (node, component): the smallest node reachable.

    Labels sink along edges and jump to their label's label, so rounds grow with the logarithm of a chain. All by
    joins and minima with map-side combining; nothing is collected, and each round is written to shared storage.
    """
    edges = edges.where("a is not null and b is not null")
    both = save(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        sunk = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "m").alias("next"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("over"))
        before = labels
        after = save(sunk.join(up, F.col("next") == F.col("at")).select("node", F.least("next", "over").alias("label"), (F.least("next", "over") != F.col("label")).alias("moved")))
        labels, moved = after.select("node", "label"), after.where("moved").limit(1).count()
        discard(before)
        labels._saved_in = after._saved_in
        if not moved:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
