"""Phrases of two to four words that stand together more often than their parts would.

Two passes over the texts. The first fills a count-min sketch over all runs of one to four words (sketch.py). The
second takes, from a block of whole pieces, the different runs whose words, pairs and own cell all pass: its candidates.
They are compiled, between delimiters, into an automaton, which counts their overlapping matches in that same block. So
an automaton is no larger than its block allows, whatever the number of candidates of the corpus. Counts are summed over
blocks; a run of `least` occurrences was a candidate wherever it stands, so its sum is exact, and the rest is dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.llm.common import LOWER_ASCII, U64, chunks, flat, free_tables, mix, release_memory, runs_of, save, span_hashes
from quaylight.llm.sketch import Sketch, text_numbers

#: Words of a phrase, at most.
LONGEST = 4
#: Occurrences that a phrase needs.
LEAST = 30
#: Rows of the result, a language.
FIRST = 2000
#: Bytes of text whose candidates share an automaton; one longer piece is a block alone.
BLOCK_BYTES = 2 << 20

_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?\n\x0b\x0c\r"]] = True
_IN_WORD = ~_ENDS_PIECE
_IN_WORD[[32, 9]] = False
_STEP = U64(0x9E3779B97F4A7C15)


class _Words:
    """The words of a column of texts: their places, the rows they stand in and which ones follow one in the same piece."""

    def __init__(self, texts: pa.Array):
        raw, offsets = flat(texts)
        self.bytes = LOWER_ASCII[raw]
        self.starts, self.ends, first = runs_of(_IN_WORD[self.bytes], offsets)
        self.rows = np.repeat(np.arange(len(texts)), np.diff(np.append(first[:-1], len(self.starts))) if len(texts) else [])
        pieces = np.concatenate(([0], np.cumsum(_ENDS_PIECE[self.bytes])))[self.starts]
        self.follows = np.zeros(len(self.starts), bool)
        self.follows[1:] = (pieces[1:] == pieces[:-1]) & (self.rows[1:] == self.rows[:-1])

    def cells(self, langs: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length, the first words of its runs and their cells in a sketch of 2 ** bits cells. langs: a number for each row's language."""
        own, _ = span_hashes(self.bytes, self.starts, self.ends)
        h, whole = own, np.ones(len(own), bool)
        for k in range(1, LONGEST + 1):
            if k > 1:
                h, whole = mix(h[:-1] * _STEP + own[k - 1 :]), whole[:-1] & self.follows[k - 1 :]
            at = np.flatnonzero(whole)
            yield k, at, mix(h[at] ^ langs[self.rows[at]]) >> U64(64 - bits)


def _run_cells(rows: pa.RecordBatch, bits: int) -> np.ndarray:
    return np.concatenate([c for _, _, c in _Words(rows.column("text")).cells(text_numbers(rows.column("lang")), bits)])


def _blocks(words: _Words, langs: np.ndarray) -> Iterator[np.ndarray]:
    """Words of one language in whole pieces and in order, of some BLOCK_BYTES. langs: a number for each word's language."""
    order = np.argsort(langs, kind="stable")
    new = np.ones(len(order) + 1, bool)
    new[:-1] = ~words.follows[order]
    for_language = np.flatnonzero(np.diff(langs[order], prepend=-1))
    for a, b in zip(for_language, [*for_language[1:], len(order)]):
        done = np.cumsum(words.ends[order[a:b]] - words.starts[order[a:b]] + 1)
        while a < b:
            cut = a + max(1, int(np.searchsorted(done, BLOCK_BYTES)))
            cut = min(b, cut + int(np.argmax(new[cut:])) if cut < b else b)
            yield order[a:cut]
            done = done[cut - a :] - done[cut - a - 1]
            a = cut


def _guarded(words: _Words, at: np.ndarray, follows: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The words between blanks, line feeds where one doesn't follow the one before; each word's first and last place. A character is a byte."""
    size = words.ends[at] - words.starts[at]
    ends = np.cumsum(size + 1) + 2 * np.cumsum(~follows)
    starts = ends - size
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    out[starts[~follows] - 2] = 10
    into = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    source = np.repeat(words.starts[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    out[into] = words.bytes[source]
    return out.tobytes().decode("latin-1"), starts, ends


def _different(words: _Words, at: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words and for no others."""
    size = words.ends[at] - words.starts[at]
    offsets = np.concatenate(([0], np.cumsum(size)))
    data = words.bytes[np.repeat(words.starts[at] - offsets[:-1], size) + np.arange(offsets[-1])]
    held = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())])
    return np.asarray(held.dictionary_encode().indices).astype(np.int64)


def _count_block(words: _Words, at: np.ndarray, passing: dict[int, np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Phrases, their words and their matches in a block. passing: for each length, whether the run from a word on passes."""
    import ahocorasick

    at = at[passing[1][at]]  # a word in between that doesn't pass ends a run
    follows = words.follows[at] & np.concatenate(([False], at[1:] == at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    text, starts, ends = _guarded(words, at, follows)
    ids = base = _different(words, at)
    n = len(at)
    whole = np.ones(n, bool)
    automaton, patterns, lengths = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], []
    for k in range(1, LONGEST + 1):
        if k > 1:
            if n < k:
                break
            whole = whole[:-1] & follows[k - 1 :] & passing[k][at[: n - k + 1]]
            if k > 2:  # both runs that it holds pass too
                whole &= before[1:]
            ids = np.unique(ids[:-1] * n + base[k - 1 :], return_inverse=True)[1]
        before = whole
        run = np.flatnonzero(whole)
        for i in run[np.unique(ids[run], return_index=True)[1]].tolist():
            pattern = text[starts[i] - 1 : ends[i + k - 1] + 1]
            automaton.add_word(pattern, len(patterns))
            patterns.append(pattern[1:-1].encode("latin-1"))
            lengths.append(k)
    if not patterns:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton.make_automaton()
    counts = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(patterns))
    return patterns, np.array(lengths), counts


def _counts(batches: Iterable[pa.RecordBatch], sketch: Sketch) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, f): matches of each block's candidates; words 0 for all words of the block."""
    free_tables()

    def rows(lang, lengths, phrases, counts) -> pa.RecordBatch:
        texts = pa.array(phrases, pa.binary()).cast(options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))
        return pa.record_batch([pa.array([lang] * len(phrases), pa.string()), pa.array(lengths, pa.int32()), texts, pa.array(counts, pa.int64())], ["lang", "words", "phrase", "f"])

    for batch in batches:
        numbers, codes = text_numbers(batch.column("lang")), batch.column("lang").dictionary_encode()
        for a, b in chunks(flat(batch.column("text"))[1], 2 * BLOCK_BYTES):
            words = _Words(batch.column("text").slice(a, b - a))
            passing = {}
            for k, at, cells in words.cells(numbers[a:b], sketch.bits):
                passing[k] = np.zeros(len(words.starts), bool)
                passing[k][at] = sketch.passes(cells)
            langs = np.asarray(codes.indices)[a:b][words.rows]
            for at in _blocks(words, langs):
                phrases, lengths, counts = _count_block(words, at, passing)
                yield rows(codes.dictionary[int(langs[at[0]])].as_py(), [0, *lengths], [b"", *phrases], [len(at), *counts])
        release_memory()


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f): all runs of one to LONGEST words with f >= least occurrences, and all words together as phrase '' with words 0.

    docs has text and lang. A null text is empty, a null lang 'und'; a language without words has no rows. Repeated rows
    count each; very long texts are cut into blocks at the ends of pieces only, and counted whole.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    sketch = Sketch(docs.select("text", "lang"), _run_cells, least)
    counted = docs.mapInArrow(lambda bs: _counts(bs, sketch), "lang string, words int, phrase string, f bigint")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))


def _joined(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by their weakest cut.

    As phrase_counts() for nulls, repeated rows and long texts. Equal scores are ordered by a, then by the phrase's
    bytes. A phrase goes if a longer one that holds it has at least 80 % of its occurrences. Further columns are ignored.
    """
    counts = save(phrase_counts(docs, least))
    long = counts.where("words >= 2").withColumn("w", F.split("phrase", " "))
    cut = long.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("head"), _joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    heads = counts.where("words > 0").select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = counts.where("words > 0").select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # decimals, as the product may pass 64 bits
    score = F.expr("cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))").cast("long")
    cuts = cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("score", score)
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))

    lengths = F.sequence(F.lit(2), F.size("w") - 1)
    parts = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: _joined(F.col("w"), i, n))))
    held = long.where("words >= 3").select("lang", F.col("f").alias("longer"), F.explode(F.array_distinct(parts)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = weakest.join(held, ["lang", "phrase"], "left").where("longer is null or cast(100 as decimal(10, 0)) * longer < cast(80 as decimal(10, 0)) * a")
    ranked = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= first)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "x.l", "x.r", "n", "x.score")
