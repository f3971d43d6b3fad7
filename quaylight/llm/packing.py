"""Best-fit packing of token pieces into sequences, planned over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.llm.bpe import row_ids
from quaylight.llm.common import save

#: Rows of a length that are ranked in one task; a commoner length is ranked in as many parts as it needs.
RANK_ROWS = 500_000


def cut_documents(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of each document's ids and its end id: doc_id, piece, start, length, ids_crc32 (of unsigned 32-bit little-endian ids).

    Null and empty texts have the end id alone. Each row is a document, repeated rows too; a null doc_id stays null.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, every, at in row_ids(batch.column("text"), path, True):
                owner, piece, start, length, crc = [], [], [], [], []
                for k, (i, j) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    raw = np.append(every[i:j], end_id).astype("<u4").tobytes()
                    for p, b in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[b : b + 4 * capacity]
                        owner.append(k)
                        piece.append(p)
                        start.append(b // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                ids = batch.column("doc_id").slice(a, len(at) - 1).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first: (length, first rank, end rank, first sequence, offset) rows.

    Sequences with equal room are a run of numbers; a step places as many pieces as a run has sequences, so the plan's
    rows depend on how many lengths there are, not on how many documents. Ranks of a length are covered once each.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, how many)
    open_rooms: list[int] = []  # sorted
    import bisect

    def put(left: int, run: tuple[int, int]) -> None:
        if left:
            if left not in room:
                room[left] = []
                bisect.insort(open_rooms, left)
            room[left].append(run)

    plan, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect.bisect_left(open_rooms, length)
            if at == len(open_rooms):  # new ones: one piece each, or as many each as fit
                fit = capacity // length
                n = -(-(count - rank) // fit)
                left, first = capacity, sequences
                sequences += n
            else:
                left = open_rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    open_rooms.pop(at)
            used = min(n, count - rank)
            plan.append((length, rank, rank + used, first, capacity - left))
            rank += used
            put(left - length, (first, used))
            if used < n:
                put(left, (first + used, n - used))
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset (its place there, without gaps) to pieces of length 1 to capacity.

    The histogram has at most `capacity` rows, and so is the only thing brought to the driver. The plan has a row for each
    step of best fit over lengths, some tens of thousands at a capacity of 4096 whatever the number of pieces. A piece's rank within
    its length is its rank within a part of that length plus the sizes of the parts before.
    """
    spark = pieces.sparkSession
    pieces = save(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_slots(histogram, capacity)
    parts = spark.createDataFrame([(n, 1 + m // RANK_ROWS) for n, m in histogram.items()], "length long, _parts long")  # at most capacity rows
    parted = pieces.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_parts")))
    sizes = parted.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).drop("n")
    ranked = parted.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    slots = spark.createDataFrame(plan, "_len long, _lo long, _hi long, _first long, offset long")
    return (
        ranked.join(before, ["length", "_part"])  # already dealt by both
        .withColumn("_rank", F.col("_in") + F.col("_before"))
        .join(F.broadcast(slots), (F.col("length") == F.col("_len")) & F.col("_rank").between(F.col("_lo"), F.col("_hi") - 1))
        .select(*pieces.columns, (F.col("_first") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Cut and pack whole documents. An empty table gives no rows."""
    return pack(cut_documents(docs, path, capacity, end_id), capacity)
