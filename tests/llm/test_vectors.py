import math

import numpy as np
import pytest

from quaylight.llm import mih, pivot, vectors

INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s") for i, v in rows], "vec_id long, embedding array<float>, label int, shard string")


def some(n, d=16, seed=0, ids=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, x[i].astype(np.float32).tolist()) for i in range(n)]


ODD = [(100_000, None), (100_001, [0.0] * 16), (100_002, [NAN] + [0.1] * 15), (100_003, [INF] + [0.1] * 15), (100_004, [None] + [0.1] * 15), (100_005, [1.0, 2.0]), (None, [0.1] * 16), (100_006, [])]


def brute(rows, every, k, quantise, zero):
    x = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))}
    x = sorted(x)
    value = lambda v: np.floor(256 * np.array(v, np.float64)) if quantise else np.array(v, np.float64)
    m = np.array([value(v) for _, v in x])
    out = []
    for q, v in x:
        if q % every:
            continue
        best = {}
        s = (m * value(v)).sum(1)
        ranked = sorted({(-s[j], i) for j, (i, _) in enumerate(x) if i != q})
        for n, (score, i) in enumerate(ranked[:k]):
            best[n + 1] = (q, n + 1, i, -score)
        out += best.values()
    return out


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_exact_top_products(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 300)
    data = some(900) + [(5000 + i, some(1)[0][1]) for i in range(60)] + ODD
    got = rows_of(pivot.top_products(frame(spark, data + data[:70])))  # repeated rows count once
    want = sorted((q, n, i, int(s)) for q, n, i, s in brute(data, 50, 5, True, True))
    assert got == want


def test_annuli_are_cut_short():
    x = np.concatenate([np.random.default_rng(1).normal(size=(2000, 4)) * 3 + c for c in ([0, 0, 0, 0], [300, 0, 0, 0], [0, 900, 0, 0])]).round()
    index = pivot.PivotIndex(np.arange(len(x)), x, x[::100], 5)
    seen = []
    whole = pivot.best
    pivot.best = lambda i, s, k: (seen.append(len(i)), whole(i, s, k))[1]
    try:
        ids, scores = index(-1, x[5500])
    finally:
        pivot.best = whole
    every = x @ x[5500]
    assert sorted(scores.tolist()) == sorted(np.sort(every)[-5:].tolist()) and sum(seen) < len(x) / 2


def test_radius_search_is_complete():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    index = mih.MultiIndex(np.arange(3000), x, mih.learn(x, 20), 20)
    for radius in (0, 7, 8, 13, 20, 27):
        for q in range(5):
            near = np.flatnonzero(np.bitwise_count(index.packed ^ index.packed[q]).sum(1) <= radius)
            assert index.within(index.packed[q], radius).tolist() == near.tolist()


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 700)
    data = some(2000) + [(7000 + i, some(1)[0][1]) for i in range(50)] + ODD
    got = rows_of(mih.nearest(frame(spark, data)))
    want = brute(data, 20, 20, False, False)
    assert len(got) == len(want)
    found = {(q, i) for q, _, i, _ in got}
    assert sum((q, i) in found for q, _, i, _ in want) >= 0.9 * len(want)
    value = {i: np.array(v, np.float64) for i, v in data if v and len(v) == 16 and None not in v}
    for q, n, i, s in got:
        assert s == pytest.approx(float((value[q] * value[i]).sum()), abs=1e-12) and q != i
    for a, b in zip(got, got[1:]):
        assert a[0] != b[0] or (a[1] + 1 == b[1] and (-a[3], a[2]) < (-b[3], b[2]))


@pytest.mark.parametrize("search, kind", [(mih.nearest, "double"), (pivot.top_products, "bigint")])
def test_few_and_none(spark, search, kind):
    empty = search(frame(spark, []))
    assert empty.count() == 0 and dict(empty.dtypes)["score"] == kind
    assert search(frame(spark, ODD[:2])).count() in (0, 0)
    got = rows_of(search(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, -1.0])])))
    assert [(q, n, i) for q, n, i, _ in got] == [(0, 1, 1), (0, 2, 2)]
