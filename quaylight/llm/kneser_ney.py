"""Quality by perplexity: an interpolated modified Kneser-Ney trigram model over word classes, trained on trusted text.

A word's symbol is its shape (lower, capital, all capitals, other), its ending (none, comma-like, sentence end, other
sign), whether it is long, and whether it equals one of the two words before it. The model so learns how trusted text
is written, in any vocabulary. All counts are of the whole trusted text: each batch's counts go to shards by n-gram and
are summed there, and the orders meet by joins on contexts. There are 64 symbols, so the finished table has at most
64^3 entries whatever the corpus; that is the bound of its broadcast. It says nothing of the words themselves: those are
judged by byte_model, whose counts grow with the text and stay in shards. A document has to pass both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.llm import byte_model
from quaylight.llm.common import LOWER_ASCII, SPACE, chunks, discard, flat, free_tables, release_memory, runs_of, save, span_hashes

SYMBOLS = 64
#: The symbol before a text: a capital word with a sentence end, which no space precedes.
START = 1 | 2 << 2
#: Perplexities of a text are drawn towards the trusted text's by so many words of it.
PRIOR_WORDS = 8
QUANTILE, SLACK = 0.99, 2.75
#: Distance of the byte model's limit above the median of its trusted perplexities, in that of the QUANTILE.
BYTE_MARGIN = 3

_KIND = np.zeros(256, np.uint8)  # 1 small, 2 capital, 4 digit, 8 comma-like, 16 sentence end, 32 other sign
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[list(b",;:-'\"()")] = 8
_KIND[list(b".!?")] = 16
_KIND[_KIND == 0] = 32


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A symbol for each word (a run without white space) of rows of UTF-8 text, and each row's limits among them."""
    starts, ends, rows = runs_of(~SPACE[raw], offsets)
    if not len(starts):
        return np.zeros(0, np.uint8), rows
    kind = _KIND[raw]
    small, big, sign = (np.concatenate(([0], np.cumsum((kind & m) > 0, dtype=np.int32))) for m in (1, 2, 32))
    n = ends - starts
    lows, caps, signs = small[ends] - small[starts], big[ends] - big[starts], sign[ends] - sign[starts]
    first, last = kind[starts], kind[ends - 1]
    shape = np.select([(caps >= 2) & (lows == 0), (first == 2) & (caps == 1), (lows > 0) & (caps == 0)], [2, 1, 0], 3)
    end = np.select([(signs > 0) | (n > 1) & (last == 16) & (kind[np.maximum(ends - 2, 0)] == 16), last == 16, last == 8], [3, 2, 1], 0)
    h, _ = span_hashes(LOWER_ASCII[raw], starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    again = np.zeros(len(h), bool)
    for gap in (1, 2):
        again[gap:] |= (h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap])
    return (shape | end << 2 | (n > 4) << 4 | again << 5).astype(np.uint8), rows


def trigrams(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The trigram number that ends at each symbol of concatenated rows; two start symbols stand before each row."""
    c = codes.astype(np.int64)
    one, two = np.full(len(c), START), np.full(len(c), START)
    one[1:], two[2:] = c[:-1], c[:-2]
    at = offsets[:-1][np.diff(offsets) > 0]
    one[at] = two[at] = START
    after = at + 1
    two[after[after < len(c)]] = START
    return (two * SYMBOLS + one) * SYMBOLS + c


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, lang, codes (binary: a byte for each word). A null text is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tables()
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                code, at = symbols(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                whole = code.tobytes()
                made = pa.array([whole[i:j] for i, j in zip(at.tolist(), at[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("lang").slice(a, b - a), made], ["doc_id", "lang", "codes"])
        release_memory()

    kind = T.StructType([docs.schema["doc_id"], docs.schema["lang"], T.StructField("codes", T.BinaryType())])
    return docs.select("doc_id", "text", "lang").select("doc_id", "lang", "text").mapInArrow(run, kind)


def count_trigrams(codes: DataFrame) -> DataFrame:
    """(a, b, c, n): every trigram of the texts. Each batch gives its sums, which meet in shards by trigram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, at = flat(batch.column("codes"))
            key, n = np.unique(trigrams(code, at), return_counts=True)
            yield pa.RecordBatch.from_pydict({"a": (key // SYMBOLS**2).astype(np.int32), "b": (key // SYMBOLS % SYMBOLS).astype(np.int32), "c": (key % SYMBOLS).astype(np.int32), "n": n.astype(np.int64)})

    return codes.select("codes").mapInArrow(run, "a int, b int, c int, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame, n: str) -> list[float]:
    """Modified discounts for counts of 1, 2 and more, from the numbers of n-grams that occur 1 to 4 times; 0.5, 1, 1.5 where these can't be told."""
    got = counts.agg(*[F.count_if(F.col(n) == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (got[f"n{k}"] for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.0
    out = [k - (k + 1) * y * up / down if y and down and up else k / 2 for k, down, up in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), out)]


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, F.lit(d[0])).when(n == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def train(counts: DataFrame) -> np.ndarray:
    """Natural logarithms of P(c | a, b) for all 64^3 trigrams, as a flat array. Without any text: uniform.

    Lower orders count the different left neighbours. Each order's discounted mass is joined to its context's total and
    the weight left for the order below; only rows of the bounded tables come to the driver.
    """
    tri = save(counts)
    bi = tri.groupBy("b", "c").agg(F.count("*").alias("n"))  # different words before b c
    uni = bi.groupBy("c").agg(F.count("*").alias("n"))
    d3, d2, d1 = discounts(tri, "n"), discounts(bi, "n"), discounts(uni, "n")

    def level(t: DataFrame, context: list[str], d: list[float]) -> DataFrame:
        whole = t.groupBy(*context).agg(F.sum("n").alias("whole"), F.sum(_discount(F.col("n"), d)).alias("lost"))
        joined = t.join(whole, context) if context else t.crossJoin(F.broadcast(whole))  # one row
        return joined.select(*context, "c", (F.greatest(F.col("n") - _discount(F.col("n"), d), F.lit(0.0)) / F.col("whole")).alias("p"), (F.col("lost") / F.col("whole")).alias("rest"))

    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for t, context, d in ((uni, [], d1), (bi, ["b"], d2), (tri, ["a", "b"], d3)):
        got = level(t, context, d).toPandas()  # at most 64, 64^2, 64^3 rows
        if not len(got):
            break
        at = sum(got[x].to_numpy(np.int64) * SYMBOLS**k for k, x in enumerate(reversed([*context, "c"])))
        size = SYMBOLS ** (len(context) + 1)
        seen, rest = np.zeros(size), np.ones(size // SYMBOLS)
        seen[at] = got["p"].to_numpy(float)
        rest[at // SYMBOLS] = got["rest"].to_numpy(float)
        below = np.tile(p, SYMBOLS) if context else p
        p = seen + np.repeat(rest, SYMBOLS) * below
    return np.log(p if len(p) == SYMBOLS**3 else np.tile(p, SYMBOLS**3 // len(p)))


def perplexities(code: np.ndarray, at: np.ndarray, logs: np.ndarray, mean: float) -> np.ndarray:
    """Of rows of symbols: exp of the mean negative log-probability, with PRIOR_WORDS words at the trusted mean; nan without words."""
    total = np.concatenate(([0.0], np.cumsum(logs[trigrams(code, at)]))) if len(code) else np.zeros(1)
    n = np.diff(at)
    out = np.exp(-((total[at[1:]] - total[at[:-1]]) + PRIOR_WORDS * mean) / (n + PRIOR_WORDS))
    return np.where(n > 0, out, np.nan)


class Model:
    """Log-probabilities of all trigrams, the mean over the trusted text."""

    def __init__(self, logs: np.ndarray, mean: float):
        self.logs, self.mean = logs, mean


def scored(codes: DataFrame, model: Model) -> DataFrame:
    """codes' rows with perplexity (null without words) in place of the codes."""
    shared = codes.sparkSession.sparkContext.broadcast(model)
    names = [c for c in codes.columns if c != "codes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, at = flat(batch.column("codes"))
            value = perplexities(code, at, shared.value.logs, shared.value.mean)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(value, pa.float64(), mask=np.isnan(value))], [*names, "perplexity"])

    return codes.mapInArrow(run, T.StructType([*(codes.schema[n] for n in names), T.StructField("perplexity", T.DoubleType())]))


def fit(codes: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame, float | None]:
    """The model, thresholds (_lang, _own) of languages with trusted text, and the threshold of all trusted text."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    good = save(codes.join(trusted, codes["doc_id"] == trusted["_id"], "left_semi"))
    counts = save(count_trigrams(good))
    logs = train(counts)
    got = counts.toPandas()  # at most 64^3 rows
    n, at = got["n"].to_numpy(float), (got["a"].to_numpy(np.int64) * SYMBOLS + got["b"]) * SYMBOLS + got["c"]
    model = Model(logs, float((n * logs[at]).sum() / n.sum() if len(n) else logs[0]))
    known = scored(good, model).where("perplexity is not null")
    limit = (F.percentile_approx("perplexity", QUANTILE, 10_000) * SLACK).alias("threshold")
    by_lang = save(known.where("lang is not null").groupBy(F.col("lang").alias("_lang")).agg(limit.alias("_own")))
    return model, by_lang, known.agg(limit).first()["threshold"]


def judged(rated: DataFrame, by_lang: DataFrame, every: float | None) -> DataFrame:
    """Adds threshold and keep to rows with lang and perplexity."""
    threshold = F.coalesce("_own", F.lit(every).cast("double"))
    joined = rated.join(by_lang, rated["lang"] == by_lang["_lang"], "left").drop("_lang").withColumn("threshold", threshold).drop("_own")
    return joined.withColumn("keep", F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))))


def both_rated(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs (doc_id and lang among them) with _forms, _bytes (perplexities), _form_limit, _byte_limit and _keep."""
    codes = save(encode(docs))
    model, by_lang, every = fit(codes, labels)
    discard(codes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = byte_model.rated(docs, trusted, lambda raw, at: perplexities(*symbols(raw, at), shared.value.logs, shared.value.mean), keep)
    known = save(rows.where("_bytes is not null").select("doc_id", "lang", F.log("_bytes").alias("x")).join(trusted, F.col("doc_id") == F.col("_id"), "left_semi"))
    middle, high = (F.percentile_approx("x", q, 10_000) for q in (0.5, QUANTILE))
    limit = F.exp(middle + BYTE_MARGIN * (high - middle))
    own = save(known.where("lang is not null").groupBy(F.col("lang").alias("_lang")).agg(limit.alias("_own_bytes")))
    whole = known.agg(limit.alias("t")).first()["t"]
    own = by_lang.withColumnRenamed("_lang", "_l").join(own, F.col("_l") == F.col("_lang"), "full").select(F.coalesce("_l", "_lang").alias("_lang"), "_own", "_own_bytes")
    joined = rows.join(F.broadcast(own), rows["lang"] == own["_lang"], "left")
    joined = joined.withColumn("_form_limit", F.coalesce("_own", F.lit(every).cast("double"))).withColumn("_byte_limit", F.coalesce("_own_bytes", F.lit(whole).cast("double")))
    within = lambda v, t: F.col(t).isNull() | (F.col(v) <= F.col(t))
    return joined.drop("_lang", "_own", "_own_bytes").withColumn("_keep", F.col("_forms").isNotNull() & within("_forms", "_form_limit") & within("_bytes", "_byte_limit"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, threshold, byte_perplexity, byte_threshold, keep for each row of docs.

    Trusted text: all documents with a label of quality 1. A document is kept up to its language's thresholds: of word
    classes, the QUANTILE of its trusted perplexities times SLACK; of bytes, BYTE_MARGIN times as far above the median
    as the QUANTILE is, in logarithms. A language without trusted text takes the thresholds of all. A text without
    words has no perplexity and goes. Without any trusted text every document with words is kept.
    """
    out = both_rated(docs.select("doc_id", "text", "lang"), labels, ["doc_id", "lang"])
    return out.select("doc_id", "lang", F.col("_forms").alias("perplexity"), F.col("_form_limit").alias("threshold"), F.when(F.col("_forms").isNotNull(), F.col("_bytes")).alias("byte_perplexity"), F.col("_byte_limit").alias("byte_threshold"), F.col("_keep").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify() keeps, with their columns."""
    return both_rated(docs, labels, docs.columns).where("_keep").select(*docs.columns)
