"""How far the words of a language's sources lie apart, and which words make the difference.

Terms whose counts over the sources are the same contribute the same to everything, so they are one class: a sparse
vector of (source, count) with a multiplicity. A pair of sources is evaluated once for each class that has both, and is weighted by
the multiplicity. Where a class lacks a source its count is 0, so that what a source gives against all others at 0 depends on
its own counts only, and is added once for each of these; the classes that have both sources take that back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.llm.common import LOWER_ASCII, U64, chunks, flat, free_tables, mix, release_memory, runs_of, save, span_hashes
from quaylight.llm.sketch import CHUNK, Sketch, text_numbers

#: Documents of a language that a term needs to be kept.
LEAST_DOCS = 10
#: Ranks of the terms.
FIRST = 10
SCALE = 1_000_000_000
#: Pairs that a task holds before it gives their sums.
PAIRS_HELD = 200_000
#: Pairs worked out at once.
PAIRS_AT_ONCE = 1 << 20
#: Lists of one source's different counts are cut into so many.
PARTS = 8

_IN_TERM = np.zeros(256, bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


class _Terms:
    """The terms of some texts: their rows, and a number for each that is the same for equal terms only."""

    def __init__(self, texts: pa.Array):
        raw, offsets = flat(texts)
        raw = LOWER_ASCII[raw]
        starts, ends, first = runs_of(_IN_TERM[raw], offsets)
        first[-1] = len(starts)
        self.row = np.repeat(np.arange(len(texts)), np.diff(first))
        size = ends - starts
        places = np.concatenate(([0], np.cumsum(size)))
        data = raw[np.repeat(starts - places[:-1], size) + np.arange(places[-1])]
        held = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(places.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
        self.different, self.ids = held.dictionary, np.asarray(held.indices).astype(np.int64)

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and terms, each pair once."""
        many = max(1, len(self.different))
        pairs = np.unique(self.row * many + self.ids)
        return pairs // many, pairs % many

    def cells(self, langs: np.ndarray, row: np.ndarray, term: np.ndarray, bits: int) -> np.ndarray:
        raw, offsets = flat(self.different)
        return mix(span_hashes(raw, offsets[:-1], offsets[1:])[0][term] ^ langs[row]) >> U64(64 - bits)


def _document_cells(rows: pa.RecordBatch, bits: int) -> np.ndarray:
    """The terms of each document, once."""
    terms = _Terms(rows.column("text"))
    return terms.cells(text_numbers(rows.column("lang")), *terms.once(), bits)


def _counted(rows: pa.RecordBatch, sketch: Sketch) -> pa.RecordBatch:
    """(lang, source, term, n, docs): occurrences, and the documents that have one, of terms that the sketch lets pass."""
    terms = _Terms(rows.column("text"))
    langs, sources = (rows.column(k).dictionary_encode() for k in ("lang", "source"))
    group = np.asarray(langs.indices).astype(np.int64) * len(sources.dictionary) + np.asarray(sources.indices)
    many = max(1, len(terms.different))
    row, term = terms.once()
    good = sketch.passes(terms.cells(text_numbers(rows.column("lang")), row, term, sketch.bits))
    keys, docs = np.unique(group[row[good]] * many + term[good], return_counts=True)
    every, n = np.unique(group[terms.row] * many + terms.ids, return_counts=True)
    n = n[np.searchsorted(every, keys)]
    shown = terms.different.take(pa.array(keys % many)).cast(pa.binary()).cast(options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))
    of = [langs.dictionary.take(pa.array(keys // many // len(sources.dictionary))), sources.dictionary.take(pa.array(keys // many % len(sources.dictionary)))]
    return pa.record_batch([*of, shown, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def _term_rows(batches: Iterable[pa.RecordBatch], sketch: Sketch) -> Iterator[pa.RecordBatch]:
    free_tables()
    for batch in batches:
        for a, b in chunks(flat(batch.column("text"))[1], CHUNK):
            yield _counted(batch.slice(a, b - a), sketch)
            release_memory()


def _share(n: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in decimals, as the product may pass 64 bits; 1 without terms."""
    wide = [f"cast({x} as decimal(20, 0))" for x in (n, total, terms)]
    return f"if({terms} = 0, 1, 1 + cast({SCALE} as decimal(10, 0)) * ({wide[0]} + 2) div ({wide[1]} + 2 * {wide[2]}))"


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so nothing leaves 64 bits."""
    return (p - q) ** 2 // (p + q)


class _Sums:
    """Sums of pairs of sources, held until they are many."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str, str], int] = {}

    def add(self, lang: str, names: list[str], a: np.ndarray, b: np.ndarray, values: np.ndarray) -> None:
        keys = a * len(names) + b
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        for k, v in zip(keys.tolist(), np.add.reduceat(values[order], first).tolist() if len(keys) else []):
            pair = lang, names[k // len(names)], names[k % len(names)]
            self.held[pair] = self.held.get(pair, 0) + v

    def rows(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.held) >= least:
            columns = zip(*[(lang, s, t, v) for (lang, s, t), v in self.held.items()])
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])
            self.held = {}


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The offsets of a column of lists, from 0, and all of their elements."""
    at = np.asarray(column.offsets)
    return at - at[0], column.values.slice(at[0], at[-1] - at[0])


def _both(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What classes give to the pairs of sources that both have them, less what these get as if one lacked the class."""
    free_tables()
    sums = _Sums()
    for batch in batches:
        at, entries = _lists(batch.column("entries"))
        sources = entries.field("source").dictionary_encode()
        names, codes = sources.dictionary.to_pylist(), np.asarray(sources.indices).astype(np.int64)
        p, zero = np.asarray(entries.field("p")), np.asarray(entries.field("p0"))
        langs, times, size = batch.column("lang").dictionary_encode(), np.asarray(batch.column("m")), np.diff(at)
        lang = np.asarray(langs.indices)
        for code, k in np.unique(np.stack((lang, size), 1), axis=0).tolist():
            rows = np.flatnonzero((lang == code) & (size == k))
            for cut in np.array_split(rows, 1 + len(rows) * k // PAIRS_AT_ONCE):
                here = at[cut][:, None] + np.arange(k)
                for i in range(k - 1):
                    x, y = here[:, i : i + 1], here[:, i + 1 :]
                    v = _apart(p[x], p[y]) - _apart(p[x], zero[y]) - _apart(zero[x], p[y]) + _apart(zero[x], zero[y])
                    sums.add(langs.dictionary[code].as_py(), names, np.broadcast_to(codes[x], y.shape).ravel(), codes[y].ravel(), (v * times[cut][:, None]).ravel())
        yield from sums.rows(PAIRS_HELD)
    yield from sums.rows(1)


def _alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a source's counts give with each other source as if that had none of the terms, and its part of the terms that neither has."""
    free_tables()
    sums = _Sums()
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            own, others = _lists(one.column("counts"))[1], _lists(one.column("others"))[1]
            p, w = np.asarray(own.field("p")), np.asarray(own.field("w"))
            source, zero, terms = one.column("source")[0].as_py(), one.column("p0")[0].as_py(), one.column("terms")[0].as_py()
            names, q = others.field("source").to_pylist(), np.asarray(others.field("p0"))
            neither = _apart(np.array(zero), q)
            value = terms * neither - w.sum() * neither  # terms: of the language, in one of the source's rows
            back = -w.sum() * neither
            for a in range(0, len(p), max(1, PAIRS_AT_ONCE // max(1, len(q)))):
                cut = slice(a, a + max(1, PAIRS_AT_ONCE // max(1, len(q))))
                seen = (w[cut, None] * _apart(p[cut, None], q[None, :])).sum(0)
                value, back = value + seen, back + seen
            lang = one.column("lang")[0].as_py()
            for name, v, u in zip(names, value.tolist(), back.tolist()):
                if name != source:
                    for pair, x in (((lang, source, name), v), ((lang, name, source), u)):
                        sums.held[pair] = sums.held.get(pair, 0) + x
            yield from sums.rows(PAIRS_HELD)
    yield from sums.rows(1)


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, first: int = FIRST) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair`, all other sources of the language, and `term`, the first terms that a source has above the language's share.

    docs has text, lang and source; null is '' in each. Repeated rows count each, as occurrences and as documents; very
    long texts are counted whole. Equal values are ordered by the item's bytes. A group without kept terms has its rows of part
    `pair`, which are all 0 if the language keeps no term; an empty table gives no rows. Further columns are ignored.
    """
    docs = docs.select(*[F.coalesce(k, F.lit("")).alias(k) for k in ("text", "lang", "source")])
    sketch = Sketch(docs.select("text", "lang"), _document_cells, least_docs)  # of documents with a term: spares the shuffle the rare ones
    counts = docs.mapInArrow(lambda bs: _term_rows(bs, sketch), "lang string, source string, term string, n bigint, docs bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    kept = save(vectors.where(F.col("docs") >= least_docs).drop("docs"))
    classes = save(kept.groupBy("lang", "vector").agg(F.count("*").alias("m")).withColumn("id", F.monotonically_increasing_id()))

    entries = classes.select("lang", "m", F.explode("vector").alias("x")).groupBy("lang", "x.source").agg(F.sum(F.col("m") * F.col("x.n")).alias("total"))
    by_lang = classes.groupBy("lang").agg(F.sum("m").alias("terms"), F.sum(F.col("m") * F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("all"))
    groups = docs.select("lang", "source").distinct().join(entries, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "terms", "all"])
    groups = save(groups.withColumn("p0", F.expr(_share("0", "total", "terms"))))

    told = classes.join(by_lang, "lang").withColumn("n", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"])).withColumn("q", F.expr(_share("n", "all", "terms")))
    told = told.select("lang", "id", "m", "q", F.explode("vector").alias("x")).select("lang", "id", "m", "q", "x.source", "x.n")
    shares = save(told.join(groups.select("lang", "source", "total", "terms", "p0"), ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "terms"))).select("lang", "source", "id", "m", "q", "p", "p0"))

    pair = "lang string, source string, item string, value bigint"
    both = shares.groupBy("id").agg(F.first("lang").alias("lang"), F.first("m").alias("m"), F.collect_list(F.struct("source", "p", "p0")).alias("entries")).where(F.size("entries") > 1).select("lang", "m", "entries").mapInArrow(_both, pair)
    both = both.union(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    weights = shares.groupBy("lang", "source", "p").agg(F.sum("m").alias("w")).groupBy("lang", "source", F.pmod("p", F.lit(PARTS)).cast("int").alias("part")).agg(F.collect_list(F.struct("p", "w")).alias("counts"))
    parts = groups.select("lang", "source", "p0", "terms", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    alone = parts.join(weights, ["lang", "source", "part"], "left").join(groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("others")), "lang")
    alone = alone.select("lang", "source", "p0", F.when(F.col("part") == 0, F.col("terms")).otherwise(0).alias("terms"), F.coalesce("counts", F.expr("cast(array() as array<struct<p: bigint, w: bigint>>)")).alias("counts"), "others").mapInArrow(_alone, pair)
    pairs = both.union(alone).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source")
    above = shares.where("p > q").select("lang", "source", "id", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    best = above.withColumn("r", F.rank().over(order.orderBy(F.desc("value")))).where(F.col("r") <= first).drop("r")
    chosen = best.join(classes.select("id", "vector"), "id").drop("id")
    terms = kept.join(chosen, ["lang", "vector"]).select("lang", "source", F.col("term").alias("item"), "value")
    ranked = [x.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "item"))) for part, x in (("pair", pairs), ("term", terms))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= first)).select("lang", "source", "part", "item", "value", "rank")
