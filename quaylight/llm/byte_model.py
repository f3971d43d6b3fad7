"""Perplexity a byte under an interpolated modified Kneser-Ney model of five bytes, trained on all trusted text.

Five bytes within and across words stand for pieces of words, so the model knows a language's own words and those made
like them. Nothing of it is gathered in one place: counts, contexts and probabilities stay in shards by n-gram and meet
in joins. Documents are packed in blocks; a block asks for each of its different n-grams once and meets the answers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.llm.common import chunks, discard, flat, release_memory, save, save_bucketed

ORDER = 5
#: Text of a block, at least while a partition has more.
BLOCK_BYTES = 64 << 20
#: Text of a part of a block; a longer single text is a part alone.
PART_BYTES = 256 << 10
#: Perplexities of a text are drawn towards the trusted text's by so many bytes of it.
PRIOR_BYTES = 40


def grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last ORDER bytes at each byte of concatenated rows, as a number; zeros stand before each row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    depth = np.arange(len(raw)) - offsets[:-1][row]
    out = raw.astype(np.int64)
    for k in range(1, ORDER):
        out[k:] |= np.where(depth[k:] >= k, raw[:-k].astype(np.int64) << 8 * k, 0)
    return out


def packed(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return out.getvalue().to_pybytes()


def unpacked(part: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(part).read_all().combine_chunks().to_batches()[0]


def blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, rows): rows of docs packed together in parts of about PART_BYTES, with their ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            numbers, ids, rows = [], [], []
            for a, b in chunks(offsets, PART_BYTES):
                if size >= BLOCK_BYTES:
                    block, size = block + 1, 0
                some = batch.slice(a, b - a)
                numbers.append(block)
                ids.append(some["doc_id"].to_pylist())
                rows.append(packed(some))
                size += int(offsets[b] - offsets[a])
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, pa.list_(batch.schema.field("doc_id").type)), pa.array(rows, pa.binary())], ["block", "ids", "rows"])

    return docs.mapInArrow(run, T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("rows", T.BinaryType())]))


def asked(made: DataFrame, trusted: DataFrame) -> DataFrame:
    """(block, g, n): the different n-grams of each block and how often they stand in its trusted documents. Parts of a block that don't come together give an n-gram more than once, which changes no sum."""
    good = made.select("block", F.explode("ids").alias("_id")).join(trusted, "_id", "left_semi").groupBy("block").agg(F.collect_set("_id").alias("good"))

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        g, n = (np.concatenate(x) for x in zip(*held))
        g, at = np.unique(g, return_inverse=True)
        return g, np.bincount(at, n, len(g)).astype(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], set()

        def give() -> pa.RecordBatch:
            g, n = merged(held)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), now)), pa.array(g), pa.array(n)], ["block", "g", "n"])

        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column("block")[k].as_py()
                if held and number != now:
                    yield give()
                    held = []
                if number != now:
                    now, known = number, set(batch.column("good")[k].as_py() or ())
                rows = unpacked(batch.column("rows")[k].as_buffer())
                raw, offsets = flat(rows.column("text"))
                own = np.array([x in known for x in rows.column("doc_id").to_pylist()], bool)
                # a bit for trusted beside the n-gram, so that one sort counts both
                key, n = np.unique(grams(raw, offsets) << 1 | np.repeat(own, np.diff(offsets)), return_counts=True)
                held.append((key >> 1, np.where(key & 1, n, 0)))
                if len(held) > 16:
                    held = [merged(held)]
        if held:
            yield give()
        release_memory()

    return made.select("block", "rows").join(good, "block", "left").select("block", "rows", "good").sortWithinPartitions("block").mapInArrow(run, "block long, g long, n long")


def probabilities(wanted: DataFrame) -> tuple[DataFrame, float]:
    """(g, p) for each different n-gram of wanted (block, g, n), and the mean natural logarithm over the trusted text.

    Lower orders count different left neighbours. Each level is joined to its contexts and to the level below.
    """
    from quaylight.llm.kneser_ney import discounts

    old = []
    counts, grams_of = {ORDER: save(wanted.where("n > 0").groupBy("g").agg(F.sum("n").alias("n")))}, {ORDER: save(wanted.select("g").distinct())}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("g").bitwiseAND(F.lit(256**k - 1)).alias("g")
        counts[k] = save(counts[k + 1].select(shorter).groupBy("g").agg(F.count("*").alias("n")))
        grams_of[k] = save(grams_of[k + 1].select(shorter).distinct())
    below = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[k], "n")
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        h, tail = F.shiftright("g", 8).alias("h"), F.col("g").bitwiseAND(F.lit(256 ** (k - 1) - 1)).alias("t")
        context = counts[k].select(h, "n", cut.alias("cut")).groupBy("h").agg(F.sum("n").alias("whole"), F.sum("cut").alias("lost"))
        rows = grams_of[k].join(counts[k], "g", "left").select("g", "n", h, tail).join(context, "h", "left")
        rows = rows.withColumn("q", F.lit(1 / 256)) if below is None else rows.join(below.select(F.col("g").alias("t"), F.col("p").alias("q")), "t")
        own = F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(F.col("n") - cut)
        old.append(below)
        below = save(rows.select("g", F.when(F.col("whole").isNull(), F.col("q")).otherwise((own + F.col("lost") * F.col("q")) / F.col("whole")).alias("p")))
    mean = counts[ORDER].join(below, "g").agg((F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("m")).first()["m"]
    discard(*counts.values(), *grams_of.values(), *(x for x in old if x is not None))
    return below, mean if mean is not None else float(np.log(1 / 256))


def rated(docs: DataFrame, trusted: DataFrame, other, keep: list[str] | None = None, name: str = "_bytes", other_name: str = "_forms") -> DataFrame:
    """The columns `keep` (all, if not given) of docs with two perplexities: other(raw, offsets) of their texts, and the one a byte (null without bytes).

    Texts are written once, packed and bucketed by block, so that only the answers are shuffled to them; the result is written.
    """
    keep = keep or docs.columns
    made = save_bucketed(blocks(docs), "block", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = save(asked(made, trusted))
    p, mean = probabilities(wanted)
    answers = save(wanted.select("block", "g").join(p, "g").select("block", "g", F.log("p").alias("p")), wanted, p)
    kind = T.StructType([*(docs.schema[c] for c in keep), T.StructField(other_name, T.DoubleType()), T.StructField(name, T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g, logs = right["g"].to_numpy(), right["p"].to_numpy()
        order = np.argsort(g)
        g, logs, out = g[order], logs[order], []
        for chunk in left["rows"].chunks:
            for k in range(len(chunk)):
                rows = unpacked(chunk[k].as_buffer())
                raw, offsets = flat(rows.column("text"))
                value = np.full(len(rows), np.nan)
                if len(raw):
                    total = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(g, grams(raw, offsets))])))
                    n = np.diff(offsets)
                    value = np.where(n > 0, np.exp(-(total[offsets[1:]] - total[offsets[:-1]] + PRIOR_BYTES * mean) / (n + PRIOR_BYTES)), np.nan)
                forms = other(raw, offsets)
                out.append(pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *(pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (forms, value))], [*keep, other_name, name]))
        release_memory()
        return pa.Table.from_batches(out)

    return save(made.select("block", "rows").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, kind), made, answers)
