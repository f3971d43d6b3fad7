"""Exact Jaccard self-join of documents' word shingles by PartEnum signatures.

Sets of similar size differ in at most k elements if they are similar enough. The feature domain is cut into groups of
three parts; some group then differs in at most one part, so the sets share a signature: the content of two of the
three parts. Each set takes the signatures of its size band and of the next, made in two turns. Sets that share a signature,
and whose sizes and parity sketches don't rule a link out, form candidate clusters, in which whole sets are compared exactly.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import LOWER_ASCII, SPACE, chunks, connected_components, discard, flat, free_tables, grouped, mix, runs_of, save, span_hashes

U = np.uint64
PARTS = 3  # of a group; signatures leave out one
#: Elements and sets compared in one task; a larger candidate cluster is dealt out as pairs of blocks of half that.
TASK_ELEMENTS, TASK_SETS = 6_000_000, 20_000
#: Sets of a signature whose sketches are compared in one task; more are dealt out as pairs of blocks of half that.
BUCKET_ROWS = 1_000
#: Bits of the map that spares texts a shuffle: 16 for each candidate set, and at most so many (2 MB), the bound of its broadcast.
MOST_MARKS = 1 << 24
_LARGEST = 1 << 40


def bands(percent: int) -> np.ndarray:
    """Last sizes of the bands: sets with 100 * intersection >= percent * union lie in the same band or in neighbours."""
    out, first = [], 1
    while first < _LARGEST:
        out.append(first * 100 // percent)
        first = out[-1] + 1
    return np.array(out)


def most_different(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of two linked sets of at most these sizes."""
    return 2 * (100 - percent) * sizes // (100 + percent)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's different shingles, sorted, and each row's limits. With fewer words the whole is one shingle; without words, none."""
    starts, ends, rows = runs_of(~SPACE[raw], offsets)
    h, _ = span_hashes(LOWER_ASCII[raw], starts, ends, seed)
    n = np.diff(rows)
    s = np.zeros(len(h), U)
    for k in range(words):
        s[: len(h) - k] = mix(s[: len(h) - k] * U(0x9FB21C651E98DF25) + h[k:] + U(k + 1))
    sets, at = [], [0]
    for a, m in zip(rows.tolist(), n.tolist()):
        if m >= words:
            one = np.unique(s[a : a + m - words + 1])
        elif m:
            whole = np.zeros(1, U)
            for k in range(m):
                whole = mix(whole * U(0x9FB21C651E98DF25) + h[a + k] + U(k + 1))
            one = mix(whole + np.full(1, m, U) * U(0xD1342543DE82EF95))
        else:
            one = s[:0]
        sets.append(one)
        at.append(at[-1] + len(one))
    return np.concatenate(sets) if sets else s[:0], np.array(at)


def nodes_of(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 63-bit number for each set, equal for equal sets; -1 for the empty set. Different sets share one with odds of 2^-63 a pair."""
    n = np.diff(at)
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(sets ^ U(0x2545F4914F6CDD1D)), dtype=U)))
    h = mix((total[at[1:]] - total[at[:-1]]) * U(3) + n.astype(U)) >> U(1)
    return np.where(n > 0, h.astype(np.int64), -1)


#: Turns in which all signatures can be made: one for even bands, one for odd ones. A set has a band in each.
TURNS = 2


def signatures(sets: np.ndarray, at: np.ndarray, percent: int, size: np.ndarray | None = None, turn: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and the row of each. size: the whole sets' sizes where some elements were left out of all sets.

    turn: only those of every TURNS-th band. Equal signatures are of one band, so each is met in one turn alone.

    A band's groups are one more than needed for one to agree, plus a spare few: so a set may leave out signatures of
    groups with an empty choice of parts when it has no more such groups than spares, and still meets every partner.
    """
    last = bands(percent)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    size = np.diff(at) if size is None else size
    found, owner = [], []
    for ahead in (0, 1):
        band = np.searchsorted(last, size) + ahead
        k = most_different(last[np.minimum(band, len(last) - 1)], percent)
        k[size == 0] = 0
        if turn is not None:
            k[band % TURNS != turn] = 0
        need = -(-(k + 1) // 2)
        spare = 2 + need // 8  # a choice of two parts holds about five elements: some hundredths of all groups have an empty one
        groups = np.where(k > 0, need + spare, 0)  # with k = 0 only equal sets are linked
        parts = groups * PARTS
        base = np.concatenate(([0], np.cumsum(parts)))
        if not base[-1]:
            continue
        use = parts[row_of] > 0
        rows, h = row_of[use], mix(sets[use] + band[row_of[use]].astype(U) * U(0x8CB92BA72F3D8DD7))
        place = base[rows] + ((h >> U(16)) % parts[rows].astype(U)).astype(np.int64)
        g = mix(h)
        low = np.bincount(place, (g & U(0xFFFFFFFF)).astype(float), base[-1])  # sums of 32-bit numbers are exact
        high = np.bincount(place, (g >> U(32)).astype(float), base[-1])
        content = mix(low.astype(U) + (high.astype(U) << U(32))).reshape(-1, PARTS)
        number = np.bincount(place, minlength=base[-1]).reshape(-1, PARTS)
        group_row = np.repeat(np.arange(len(size)), groups)
        group_no = np.arange(len(group_row)) - np.repeat(np.concatenate(([0], np.cumsum(groups)))[:-1], groups)
        empty = np.stack([number[:, (j + 1) % PARTS] + number[:, (j + 2) % PARTS] == 0 for j in range(PARTS)], 1)
        holes = np.bincount(group_row, empty.any(1), len(size))
        drop = holes[group_row] <= spare[group_row]
        for j in range(PARTS):
            x, y = content[:, (j + 1) % PARTS], content[:, (j + 2) % PARTS]
            sig = mix(x * U(0x9E6C63D0876A9A47) + mix(y) + mix((band[group_row].astype(U) << U(40)) + group_no.astype(U) * U(4) + U(j)))
            keep = ~(drop & empty[:, j])
            found.append(sig[keep])
            owner.append(group_row[keep])
    if not found:
        return sets[:0], row_of[:0]
    return np.concatenate(found), np.concatenate(owner)


#: Bits of a set's parity sketch: a power of two, no fewer than the set's elements within these bounds. Beyond the latter a sketch tells less.
SKETCH_BITS, MOST_SKETCH_BITS = 512, 1 << 20
#: Bytes of sketches, beside the rows of whole buckets, that a task takes up at once.
SKETCH_BYTES = 32 << 20


def sketches(sets: np.ndarray, at: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """A row of bytes for each set: the parity of its elements at each bit. Two sets' rows differ in no more bits than the sets in elements."""
    place = np.repeat(np.arange(len(at) - 1), np.diff(at)) * bits + (mix(sets ^ U(0x6A09E667F3BCC909)) % U(bits)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=(len(at) - 1) * bits) & 1).astype(bool).reshape(-1, bits), axis=1)


def sized_sketches(sets: np.ndarray, at: np.ndarray) -> pa.Array:
    """A sketch for each set, with bits by its size: unrelated sets of any size then differ in more bits than linked ones may."""
    size = np.diff(at)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), SKETCH_BITS, MOST_SKETCH_BITS)
    out = np.empty(len(size), object)
    for k in np.unique(bits).tolist():
        own = bits == k
        rows = sketches(sets[np.repeat(own, size)], np.concatenate(([0], np.cumsum(size[own]))), k)
        for i, row in zip(np.flatnonzero(own).tolist(), rows):
            out[i] = row.tobytes()
    return pa.array(out.tolist(), pa.binary())


def folded(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray, bits: int) -> np.ndarray:
    """The sketches of these rows as so many bits: places that are equal modulo `bits`, a power of two, meet in one, which has their parity."""
    out, have = np.empty((len(rows), bits // 64), U), 8 * (offsets[rows + 1] - offsets[rows])
    for k in np.unique(have).tolist():
        own = np.flatnonzero(have == k)
        parts = raw[offsets[rows[own], None] + np.arange(k // 8)].reshape(len(own), k // bits, bits // 8)
        out[own] = np.ascontiguousarray(np.bitwise_xor.reduce(parts, axis=1)).view(U)
    return out


def set_table(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, node and sketch for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tables()
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                sets, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, seed)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(np.diff(at)), pa.array(nodes_of(sets, at)), sized_sketches(sets, at)], ["doc_id", "key", "n_shingles", "node", "sketch"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n_shingles long, node long, sketch binary")


#: Rows sampled for common shingles, in how many of them a shingle is common, and how many are left out at most.
SAMPLE_ROWS, COMMON_ROWS, MOST_COMMON = 5_000, 8, 250_000


def common_shingles(docs: DataFrame, words: int, n: int, seed: int) -> np.ndarray:
    """Hashes of shingles that many documents share, sorted: boilerplate. From a sample, at most MOST_COMMON.

    They are left out of the domain that signatures partition. Whichever are left out, two sets differ in no more of
    the other elements than in all, so linked sets still share a signature; only fewer other sets do.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                sets, _ = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, seed)
                yield pa.RecordBatch.from_pydict({"h": sets.view(np.int64)})

    some = docs.select("text").sample(min(1.0, SAMPLE_ROWS / max(n, 1)), 1) if n > SAMPLE_ROWS else docs.select("text")
    often = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON_ROWS)
    got = often.orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toPandas()["h"]
    return np.sort(got.to_numpy(np.int64).view(U))


def signature_table(docs: DataFrame, words: int, percent: int, common: np.ndarray, seed: int, turn: int | None = None) -> DataFrame:
    """(sig, node) of each set, in this turn if given; a set that a task has just met is not given again."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known = shared.value
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                sets, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, seed)
                nodes, sizes = nodes_of(sets, at), np.diff(at)
                fresh = np.zeros(len(nodes), bool)
                for i, x in enumerate(nodes.tolist()):
                    if x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > 1_000_000:
                    seen.clear()
                use = np.repeat(fresh, sizes)
                if len(known):
                    use &= known[np.minimum(np.searchsorted(known, sets), len(known) - 1)] != sets
                left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[use], minlength=len(sizes))
                sig, row = signatures(sets[use], np.concatenate(([0], np.cumsum(left))), percent, np.where(fresh, sizes, 0), turn)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(nodes[row])], ["sig", "node"])

    return docs.select("text").mapInArrow(run, "sig long, node long")


def whole_runs(batches: Iterable[pa.RecordBatch], key: str, rows: int = 1 << 16, most: int = 1 << 40) -> Iterator[pa.Table]:
    """Tables of about so many rows or `most` bytes, or more if a run is longer, that end where a run of equal keys ends; the input is sorted by it."""
    held: list[pa.RecordBatch] = []
    n = weight = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, weight = n + batch.num_rows, weight + batch.nbytes
        last = np.asarray(batch.column(batch.schema.get_field_index(key)))
        if n < rows and weight < most or (last[0] == last[-1] and len(held) > 1 and held[-2].column(key)[-1].as_py() == last[0]):
            continue
        cut = int(np.searchsorted(last, last[-1]))  # where the last run begins in this batch
        head = [*held[:-1], batch.slice(0, cut)]
        if cut or len(held) > 1 and held[-2].column(key)[-1].as_py() != last[0]:
            yield pa.Table.from_batches(head).combine_chunks()
            held, n, weight = [batch.slice(cut)], batch.num_rows - cut, batch.slice(cut).nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def repeated_buckets(sigs: DataFrame, partitions: int) -> DataFrame:
    """(bucket, node): the sets of each signature that more than one has. Signatures of the same sets are one bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for table in whole_runs(batches, "sig"):
            sig, node = np.asarray(table["sig"]), np.asarray(table["node"])
            own = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
            sig, node = sig[own], node[own]
            begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            size = np.diff(np.append(begin, len(sig)))
            name = np.add.reduceat(mix(node.view(U)), begin).view(np.int64)
            _, first = np.unique(name, return_index=True)
            once = np.zeros(len(name), bool)
            once[first] = True
            take = np.flatnonzero(once & (size > 1))
            if len(sent) > 1_000_000:
                sent.clear()
            fresh = np.array([x not in sent for x in name[take].tolist()], bool)
            take = take[fresh]
            sent.update(name[take].tolist())
            if len(take):
                stop = np.cumsum(size[take])
                at = np.arange(stop[-1]) + np.repeat(begin[take] - (stop - size[take]), size[take])
                yield pa.RecordBatch.from_pydict({"bucket": np.repeat(name[take], size[take]), "node": node[at]})

    return sigs.repartition(partitions, "sig").sortWithinPartitions("sig", "node").mapInArrow(run, "bucket long, node long").distinct()


def candidate_edges(buckets: DataFrame, sketched: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(a, b) edges that join, within each bucket, all sets that sizes and sketches let be linked, directly or through others.

    A pair is left out only if no link is possible: its sizes are too far apart, or its sketches differ in more bits
    than linked sets differ in elements. Members are taken in turn and compared with all at once, each class once more
    only where it isn't the largest. A bucket of more than BUCKET_ROWS sets is dealt out: each pair of its blocks is a task.
    """

    def possible(n: np.ndarray, sketch: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
        few = np.bitwise_count(sketch ^ other).sum(-1, dtype=np.int64) <= (100 - percent) * (n + m) // (100 + percent)
        return few & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))

    def classes(n: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        root, tried, met = np.arange(len(n)), np.zeros(len(n), bool), np.zeros(len(n), bool)
        order = iter(range(len(n)))
        while True:
            i = next((i for i in order if not met[i]), None)
            if i is None:
                names, counts = np.unique(root, return_counts=True)
                left = np.flatnonzero((root != names[np.argmax(counts)]) & ~tried)
                if not len(left):
                    return root
                i = int(left[0])
            near = np.unique(np.append(root[possible(n, sketch, n[i], sketch[i])], root[i]))
            root[np.isin(root, near)] = near[0]
            tried[i] = True
            met |= root == root[i]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "task", 1 << 14, SKETCH_BYTES):
            bucket, node, n = (np.asarray(table[c]) for c in ("task", "node", "n_shingles"))
            raw, offsets = flat(table["sketch"].chunk(0))
            bits = 8 * np.diff(offsets)
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            size = np.diff(np.append(begin, len(bucket)))
            pair = begin[size == 2]
            least = np.minimum(bits[pair], bits[pair + 1])
            a, b = [node[:0]], [node[:0]]
            for k in np.unique(least).tolist():
                some = pair[least == k]
                some = some[possible(n[some], folded(raw, offsets, some, k), n[some + 1], folded(raw, offsets, some + 1, k))]
                a.append(node[some])
                b.append(node[some + 1])
            for s, m in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
                root = classes(n[s : s + m], folded(raw, offsets, np.arange(s, s + m), int(bits[s : s + m].min())))
                apart = root != np.arange(m)
                a.append(node[s : s + m][root[apart]])
                b.append(node[s : s + m][apart])
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    wide = buckets.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > BUCKET_ROWS).select("bucket", F.ceil(F.col("m") / (BUCKET_ROWS // 2)).cast("int").alias("blocks"))
    dealt = buckets.join(wide, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    dealt = dealt.select("bucket", "node", "block", "blocks", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
    task = F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
    joined = dealt.select(task.alias("task"), "node").join(sketched, "node").select("task", "node", "n_shingles", "sketch")
    return joined.repartition(partitions, "task").sortWithinPartitions("task", "node").mapInArrow(run, "a long, b long").distinct()


def link_sets(flat_sets: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The root of each set among sets joined by links, exactly.

    Sets are taken in turn and compared with all others at once, until each belongs somewhere; then those outside the
    largest class so far are compared with all others too. So a pair goes uncompared only inside one class.
    """
    n, size = len(at) - 1, np.diff(at)
    values, code = np.unique(flat_sets, return_inverse=True)
    flag = np.zeros(len(values), bool)
    root, compared = np.arange(n), np.zeros(n, bool)
    tests = 0

    def compare(i: int) -> None:
        nonlocal tests
        own = code[at[i] : at[i + 1]]
        flag[own] = True
        both = np.add.reduceat(flag[code], at[:-1], dtype=np.int64)
        flag[own] = False
        near = np.unique(root[100 * both >= percent * (size + size[i] - both)])
        root[np.isin(root, near)] = near[0]
        compared[i] = True
        tests += 1

    met = np.zeros(n, bool)
    for i in range(n):
        if not met[i]:
            compare(i)
            met |= root == root[i]
    while True:
        names, counts = np.unique(root, return_counts=True)
        left = np.flatnonzero((root != names[np.argmax(counts)]) & ~compared)
        if not len(left):
            return root, tests
        compare(int(left[0]))


def linked_within(rows: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """(a, b) links that join each class, from rows (cluster, i, j, node, text), a comparison for each (cluster, i, j)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in grouped(batches, ["cluster", "i", "j"]):
            group = group.combine_chunks()
            node, (raw, offsets) = np.asarray(group["node"]), flat(group["text"].chunk(0))
            sets, sizes = [], []
            for x, y in chunks(offsets):
                some, at = shingle_sets(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], words, seed)
                sets.append(some)
                sizes.append(np.diff(at))
            every, at = np.concatenate(sets), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            own = nodes_of(every, at) == node  # two texts with one id and one key: the other's set was meant
            every, at, node = every[np.repeat(own, np.diff(at))], np.concatenate(([0], np.cumsum(np.diff(at)[own]))), node[own]
            if not len(node):
                continue
            root, _ = link_sets(every, at, percent)
            apart = root != np.arange(len(node))
            a.append(node[root[apart]])
            b.append(node[apart])
            if sum(map(len, a)) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.mapInArrow(run, "a long, b long")


def marked_only(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """The rows whose key may be among `keys` (count of them): all that are, and few others while the map has bits to spare.

    The map is built in parts of 64 bits by an aggregation. It only spares rows a shuffle: what it lets through by
    chance, or because so many keys fill it, the join that follows drops.
    """
    bits = min(MOST_MARKS, 1 << max(16, (16 * count).bit_length()))
    part = keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("at")).select(F.expr("shiftright(at, 6)").alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("m"))
    got = part.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()  # at most bits / 64 rows
    table = np.zeros(bits // 64, U)
    table[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64).view(U)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("key")).view(U) & U(bits - 1)
            yield batch.filter(pa.array((shared.value[at >> U(6)] >> (at & U(63)) & U(1)).astype(bool)))

    return rows.mapInArrow(run, rows.schema)


def similar_documents(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Words are runs without white space, A-Z lowered. Documents link when 100 * intersection >= percent * union of their
    shingle sets. component_id is the smallest doc_id reachable. Null and empty texts have 0 shingles and are alone;
    rows that share a doc_id each have their own set; a null doc_id never names a component that has others. Texts are
    taken whole. An empty table gives no rows. Words are hashed with a seed drawn anew for each call.
    """
    spark, seed = docs.sparkSession, secrets.randbits(63)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    table = save(set_table(docs, words, seed))
    common = common_shingles(docs, words, table.count(), seed)
    # a turn's signatures are gone from disk before the next one's are made
    turns = [save(repeated_buckets(signature_table(docs, words, percent, common, seed, turn), 2 * partitions)) for turn in range(TURNS)]
    buckets = save(reduce(DataFrame.union, turns).distinct(), *turns)
    sketched = table.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    edges = save(candidate_edges(buckets, sketched, percent, 2 * partitions), buckets)
    clusters = connected_components(edges)
    discard(edges)
    # one row stands for each set
    heads = table.where("node >= 0").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("at"), F.max("n_shingles").alias("n"))
    heads = save(heads.join(clusters.withColumnRenamed("component", "cluster"), "node").select("node", "n", "cluster", F.col("at.doc_id").alias("head_id"), F.col("at.key").alias("key")), clusters)
    dealt = lambda whole, most: F.when(F.col(whole) <= most, 1).otherwise(F.ceil(F.col(whole) / (most // 2))).cast("int")
    weight = heads.groupBy("cluster").agg(F.sum("n").alias("elements"), F.count("*").alias("sets")).select("cluster", F.greatest(dealt("elements", TASK_ELEMENTS), dealt("sets", TASK_SETS)).alias("blocks"))
    placed = heads.join(weight, "cluster").select("node", "head_id", F.col("key").alias("head_key"), "cluster", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    some = marked_only(docs, heads.select("key"), heads.count())
    sets = some.join(placed, (F.col("key") == F.col("head_key")) & F.col("doc_id").eqNullSafe(F.col("head_id"))).select("cluster", "blocks", "block", "node", "text")
    # each pair of blocks of a cluster is a comparison
    tasks = sets.select("cluster", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "node", "text")
    tasks = tasks.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "text")
    tasks = tasks.repartition(2 * partitions, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    links = save(linked_within(tasks, words, percent, seed), heads)
    classes = connected_components(links)
    discard(links)
    named = table.drop("sketch", "key").join(classes, "node", "left").withColumn("_class", F.coalesce("component", "node"))
    least = save(named.where("node >= 0").groupBy("_class").agg(F.min("doc_id").alias("_least")))  # apart, so that a large class can be split in the join
    return named.join(least.withColumnRenamed("_class", "_c"), (F.col("_class") == F.col("_c")) & (F.col("node") >= 0), "left").select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows of docs whose doc_id names their component; rows that share an id share its fate. Rows without a doc_id are kept."""
    named = save(similar_documents(docs.select("doc_id", "text"), words, percent))
    others = named.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_d"))
    kept = left.join(others, F.col("_d") == F.col("_gone"), "left_anti")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
