"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.llm.common import LOWER_ASCII, chunks, flat, free_tables, mix, release_memory, runs_of, save, span_hashes

#: Features fall into 2^BITS places, which bounds the weights that are broadcast (at most 12 bytes each).
BITS = 20
#: Labelled rows that are learned from: those smallest by a hash of their id.
TRAIN_ROWS = 12_000
EPOCHS, ALPHA, BETA, L2 = 5, 1.0, 1.0, 0.0
#: L1 is the one of these with the least loss on a fifth of the training rows, or of the first TRIAL_ROWS of them; more rows bear a larger one.
L1_CHOICES, TRIAL_ROWS, TRIAL_EPOCHS = (1.0, 3.0, 10.0), 6_000, 3

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of rows of UTF-8 text and the row of each: words, pairs of neighbours, and pairs with one word between.

    Words are runs of ASCII letters, digits and bytes above 127, with A-Z lowered.
    """
    starts, ends, rows = runs_of(_WORD[raw], offsets)
    h, _ = span_hashes(LOWER_ASCII[raw], starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    found, owner = [h], [row]
    for gap, seed in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        same = row[gap:] == row[:-gap]
        found.append(mix(h[:-gap][same] * np.uint64(seed) + h[gap:][same]))
        owner.append(row[gap:][same])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owner)


@dataclass
class Weights:
    """Places with a weight that isn't 0, their weights, and the bias."""

    places: np.ndarray
    values: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each row: the logistic of the bias and the weights of its different features."""
        table = np.zeros(1 << BITS, np.float64)
        table[self.places] = self.values
        total = np.full(len(offsets) - 1, self.bias)
        for a, b in chunks(offsets):
            place, row = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            weighty = np.flatnonzero(table[place])
            once = np.unique(row[weighty].astype(np.int64) << BITS | place[weighty])
            total[a:b] += np.bincount(once >> BITS, table[once & ((1 << BITS) - 1)], b - a)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, l1: float, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal with a learning rate for each coordinate; L1 leaves most weights exactly 0. The bias isn't penalised."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weight(at: np.ndarray) -> np.ndarray:
        zs, sparse = z[at], np.where(at == bias, 0.0, l1)
        return np.where(np.abs(zs) <= sparse, 0.0, -(zs - np.sign(zs) * sparse) / ((BETA + np.sqrt(n[at])) / ALPHA + np.where(at == bias, 0.0, L2)))

    for _ in range(epochs):
        for places, y in zip(rows, labels):
            at = np.append(places, bias)
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            if abs(g) < 1e-4:
                continue
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    every = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Weights(every, weight(every), float(weight(np.array([bias]))[0]))


def loss(w: Weights, rows: list[np.ndarray], labels: np.ndarray) -> float:
    """Mean logistic loss over rows of different places."""
    table = np.zeros(1 << BITS)
    table[w.places] = w.values
    total = np.array([w.bias + table[r].sum() for r in rows])
    return float(np.logaddexp(0, np.where(labels > 0, -total, total)).mean())


def fitted(rows: list[np.ndarray], labels: np.ndarray) -> Weights:
    """ftrl() over all rows, with the L1 that does best on every fifth of the first TRIAL_ROWS; the smallest if these hold one label only."""
    some = np.arange(min(len(rows), TRIAL_ROWS))
    tried, learned = some[::5], np.delete(some, some[::5])
    pick = lambda at: ([rows[i] for i in at], labels[at])
    l1 = L1_CHOICES[0]
    if len(set(labels[tried])) == len(set(labels[learned])) == 2:
        l1 = min(L1_CHOICES, key=lambda x: loss(ftrl(*pick(learned), x, TRIAL_EPOCHS), *pick(tried)))
    return ftrl(rows, labels, l1)


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Weights:
    """Weights from at most `most` labelled rows that aren't held out. Each row's label is the largest of its labels.

    Training rows pass through one task in a fixed order, bounded by `most`; only the weights come to the driver. With
    no labelled row all weights are 0.
    """
    picked = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    picked = save(picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # the proven bound of the broadcast
    some = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                place, row = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                once = np.unique(row << BITS | place)
                cut = np.searchsorted(once, np.arange(b - a + 1) << BITS)
                low = (once & ((1 << BITS) - 1)).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("_toxic").slice(a, b - a).cast(pa.int64()), pa.array([low[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], ["doc_id", "y", "places"])

    rows = save(some.mapInArrow(places, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("y", T.LongType()), T.StructField("places", T.BinaryType())])))

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, y = [], []
        for batch in batches:
            held += [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column("places").to_pylist()]
            y += batch.column("y").to_pylist()
        if held:
            w = fitted(held, np.array(y, float))
            yield pa.RecordBatch.from_pydict({"place": pa.array([*w.places, -1], pa.int64()), "value": pa.array([*w.values, w.bias], pa.float64())})
        del held
        release_memory()

    ordered = rows.dropDuplicates(["doc_id", "places"]).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "places")
    got = ordered.mapInArrow(learn, "place long, value double").toPandas()  # at most 2^BITS rows
    own = got["place"] >= 0
    return Weights(got["place"][own].to_numpy(np.int64), got["value"][own].to_numpy(float), float(got["value"][~own].sum()))


def score(docs: DataFrame, weights: Weights, name: str = "score") -> DataFrame:
    """docs and a column of scores, which takes the place of one of that name; whole texts, null as empty (which gets the bias alone). No other column has a say."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop(name)
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tables()
        for batch in batches:
            raw, offsets = flat(batch.column(names.index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(raw, offsets))], [*names, name])
        release_memory()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
