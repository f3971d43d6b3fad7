"""Token-id shards compressed by a Re-Pair grammar, with random access to documents.

A shard file: the magic bytes, a header of 64-bit counts (documents, symbols, rules, first nonterminal, width of a
symbol in bytes), rules (two 32-bit symbols each), the expansion length of each rule, the documents' ids, null flags,
token counts and first symbols, and the symbols. All integers are little-endian. A nonterminal stands for two symbols.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.llm.bpe import row_ids
from quaylight.llm.common import save, shared_dir
from quaylight.llm.warc import file_system

MAGIC = b"QLRP0001"
#: Tokens of a shard file, at least while there are more.
SHARD_TOKENS = 2_000_000
#: Occurrences that a pair needs for a rule. A rule takes 16 bytes and a use saves two, and where pairs overlap not all get used; fewer than this make files larger.
LEAST_COUNT = 24
FIRST_NONTERMINAL = 1 << 16
#: Ranges of ids that are told apart, a task each; with more text a range fills more files.
MOST_RANGES = 100_000


def kinds_of(values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values, ascending, and the place of each among them, as np.unique gives; all are below end, so nothing is sorted."""
    there = np.zeros(end, bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values]


def compress(ids: np.ndarray, owner: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their documents and rules. Each round replaces all pairs of `least` occurrences or more by nonterminals, until there are none; pairs never cross documents.

    Where pairs overlap, the one further left among neighbours that are to be replaced goes first. A pair that was too rare
    stays so, as its count only falls: after the first round only pairs with a new symbol are counted, and those that were
    to be replaced and are left.
    """
    symbols, owner = ids.astype(np.int64), owner.astype(np.int32)
    rules: list[np.ndarray] = []
    made, bits = 0, 16
    live = np.flatnonzero(owner[:-1] == owner[1:])  # where the pairs begin that can have enough occurrences
    while len(live):
        pair = symbols[live] << bits | symbols[live + 1]
        if not made:
            pair = pair.astype(np.uint32)  # of ids alone: half the bytes to sort and search
        every = np.sort(pair)
        start = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else every
        chosen = every[start[np.diff(np.append(start, len(every))) >= least]]  # in order
        if not len(chosen):
            break
        at = np.minimum(np.searchsorted(chosen, pair), len(chosen) - 1)
        hit = chosen[at] == pair
        place, at = live[hit], at[hit]
        hot = np.zeros(len(symbols), bool)
        hot[place] = True
        fresh = np.append(True, np.diff(place) != 1)
        first = (place - place[fresh][np.cumsum(fresh) - 1]) % 2 == 0
        place = place[first]
        used, number = kinds_of(at[first], len(chosen))  # a pair that others overlap everywhere gets no rule
        symbols[place] = FIRST_NONTERMINAL + made + number
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, owner, hot = symbols[keep], owner[keep], hot[keep]
        hot |= symbols >= FIRST_NONTERMINAL + made
        hot[:-1] |= symbols[1:] >= FIRST_NONTERMINAL + made
        live = np.flatnonzero(hot[:-1] & (owner[:-1] == owner[1:]))
        rules.append(np.stack((chosen[used] >> bits, chosen[used] & (1 << bits) - 1), 1).astype(np.int64))
        made, bits = made + len(used), 32
    return symbols, owner, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Tokens that each rule stands for; a rule's symbols are older than it."""
    n = np.ones(len(rules), np.int64)
    todo = np.ones(len(rules), bool)
    while todo.any():  # a level of the grammar at a time
        below = rules - FIRST_NONTERMINAL
        ready = todo & ~np.any((below >= 0) & todo[np.maximum(below, 0)], axis=1)
        n[ready] = np.where(below[ready] >= 0, n[np.maximum(below[ready], 0)], 1).sum(1)
        todo &= ~ready
    return n


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for. Each kind of symbol is expanded once, a level of the grammar at a time, and copied to its places."""
    kinds, code = kinds_of(symbols.astype(np.int64), FIRST_NONTERMINAL + len(rules))
    flat, owner = kinds, np.arange(len(kinds))
    while len(flat):
        number = flat - FIRST_NONTERMINAL
        wide = number >= 0
        if not wide.any():
            break
        size = 1 + wide
        first = np.cumsum(size) - size
        out = np.repeat(flat, size)
        out[first[wide]] = rules[number[wide], 0]
        out[first[wide] + 1] = rules[number[wide], 1]
        flat, owner = out, np.repeat(owner, size)
    sizes = np.bincount(owner, minlength=len(kinds))
    begin, n = (np.cumsum(sizes) - sizes)[code], sizes[code]
    return flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A shard file of whole documents. No ids may be FIRST_NONTERMINAL or more."""
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    if len(flat) and flat.max() >= FIRST_NONTERMINAL:
        raise ValueError("an id is too large for this format")
    symbols, owner, rules = compress(flat, np.repeat(np.arange(len(ids)), sizes))
    first = np.searchsorted(owner, np.arange(len(ids)))
    # the commonest kinds of symbol get two bytes: ids and nonterminals are numbered together where they fit
    names, code = kinds_of(symbols, FIRST_NONTERMINAL + len(rules))
    width = 2 if len(names) <= 1 << 16 else 4
    parts = [struct.pack("<6q", len(ids), len(symbols), len(rules), FIRST_NONTERMINAL, width, len(names))]
    parts += [rules.astype("<u4").tobytes(), expansion_lengths(rules).astype("<u4").tobytes()]
    parts += [np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes()]
    parts += [sizes.astype("<i8").tobytes(), first.astype("<i8").tobytes(), names.astype("<u4").tobytes(), code.astype(f"<u{width}").tobytes()]
    return MAGIC + b"".join(parts)


class Shard:
    """An opened shard: document() decodes any one of them from its own symbols."""

    def __init__(self, raw: bytes):
        file = io.BytesIO(raw)
        if file.read(8) != MAGIC:
            raise ValueError("no token shard")
        self.documents, n, rules, first, width, names = struct.unpack("<6q", file.read(48))

        def take(kind: str, count: int) -> np.ndarray:
            kind_ = np.dtype(kind)
            got = file.read(count * kind_.itemsize)
            if len(got) != count * kind_.itemsize:
                raise ValueError("the token shard is cut short")
            return np.frombuffer(got, kind_)

        if first != FIRST_NONTERMINAL:
            raise ValueError("another numbering of nonterminals")
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", rules)
        self.doc_ids, self.nulls = take("<i8", self.documents), take("u1", self.documents)
        self.sizes, self.first = take("<i8", self.documents), take("<i8", self.documents)
        self.symbols = take("<u4", names)[take(f"<u{width}", n)].astype(np.int64)

    def document(self, k: int) -> np.ndarray:
        end = self.first[k + 1] if k + 1 < self.documents else len(self.symbols)
        ids = expand(self.symbols[self.first[k] : end], self.rules)
        if len(ids) != self.sizes[k]:
            raise ValueError("a document has another length than its entry")
        return ids

    def symbol_sizes(self) -> np.ndarray:
        """Tokens of each symbol: with these, any token is found without decoding what is before it."""
        number = self.symbols - FIRST_NONTERMINAL
        return np.where(number >= 0, self.lengths[np.maximum(number, 0)] if len(self.lengths) else 1, 1)

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules)


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes all documents in ascending doc_id order (nulls first, ties by content); a row for each file: range_no, file_no, path, n_tokens.

    Ranges of ids hold about equal text and come from a bounded summary of ids and sizes; only ids and encoded texts
    are then moved, each to its range, where files are filled in order. A null text is empty. An id repeated without
    end fills one range's files, one after another.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = slim.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    wanted = max(1, int((sizes["bytes"] or 0) / 4 / shard_tokens) + 1)
    parts = min(wanted, MOST_RANGES)
    cuts = slim.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("q")).first()["q"] if parts > 1 else []
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, every, at in row_ids(batch.column("text"), path, True):
                doc = batch.column("doc_id").slice(a, len(at) - 1)
                number = np.searchsorted(bounds, np.asarray(doc.fill_null(np.iinfo(np.int64).min)), "left")
                if len(every) and every.max() >= FIRST_NONTERMINAL:
                    raise ValueError("an id is too large for this format")
                small = every.astype("<u2")
                raw = [small[i:j].tobytes() for i, j in zip(at.tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), doc, pa.array(raw, pa.binary())], ["range_no", "doc_id", "ids"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        now, number, doc_ids, held, tokens = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, doc_ids, held, tokens
            name = f"{now}-{number}-{uuid.uuid4().hex}.qlrp"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(shard_bytes(doc_ids, held))
            row = pa.RecordBatch.from_pydict({"range_no": pa.array([now], pa.int32()), "file_no": pa.array([number], pa.int32()), "path": [f"{folder}/{name}"], "n_tokens": pa.array([tokens], pa.int64())})
            number, doc_ids, held, tokens = number + 1, [], [], 0
            return row

        for batch in batches:
            for part, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("range_no", "doc_id", "ids"))):
                if held and (part != now or tokens >= shard_tokens):
                    yield flush()
                if part != now:
                    now, number = part, 0
                doc_ids.append(doc)
                held.append(np.append(np.frombuffer(raw, "<u2"), np.uint16(end_id)))
                tokens += len(held[-1])
        if held:
            yield flush()

    encoded = slim.mapInArrow(encode, "range_no int, doc_id long, ids binary")
    ordered = encoded.repartitionById(len(bounds) + 1, "range_no").sortWithinPartitions("range_no", F.asc_nulls_first("doc_id"), "ids")
    return save(ordered.mapInArrow(write, "range_no int, file_no int, path string, n_tokens long"))


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    total = files.groupBy("range_no").agg(F.sum("n_tokens").alias("_n"))  # a row for each range: at most MOST_RANGES
    before = total.withColumn("_before", F.sum("_n").over(Window.orderBy("range_no")) - F.col("_n")).drop("_n")
    own = F.sum("n_tokens").over(Window.partitionBy("range_no").orderBy("file_no")) - F.col("n_tokens")
    placed = files.withColumn("_own", own).join(before, "range_no").select("path", (F.col("_own") + F.col("_before")).alias("start"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, at = file_system(path)
                with fs.open_input_stream(at) as file:
                    shard = Shard(file.read())
                ids = shard.all_ids().astype("<u4")
                ends = np.cumsum(shard.sizes)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - shard.sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64(), mask=shard.nulls.astype(bool)), pa.array(start + ends - shard.sizes), pa.array(shard.sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    count = max(1, files.count())
    return placed.repartition(min(count, 2000)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return read_shards(write_shards(docs, shared_dir(spark), path))
