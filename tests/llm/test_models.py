import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import cases

from quaylight.llm import kneser_ney as K
from quaylight.llm import toxicity as X
from quaylight.llm.common import flat

BAD = ["moron", "idiot", "scum"]


def labelled(spark, n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        t = cases.text(rng, rng.randint(5, 120))
        toxic = rng.random() < 0.2
        if toxic:
            w = t.split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    docs = cases.documents(spark, rows + [(None, "x"), (5000, None), (5001, "")])
    w = X.train(docs, label_frame(spark, [*labels, (None, 1, 1), (3, 1, None), (3, 1, 0), (3, 1, 1)]))
    assert 0 < len(w.places) < 400  # compact
    got = {r["doc_id"]: r["score"] for r in X.score(docs, w).select("doc_id", "score", X.held_out().alias("h")).collect()}
    wrong = [i for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0 and (got[i] >= 0.5) != bool(y)]
    assert len(wrong) <= 3
    assert 0 <= got[5000] == got[5001] <= 1
    assert X.score(docs.withColumnRenamed("source", "score"), w).columns == ["doc_id", "text", "lang", "n_chars", "_key", "score"]
    assert X.score(docs.limit(0), w).count() == 0


def test_labels_of_held_out_rows_have_no_say(spark):
    rows, labels = labelled(spark, 200)
    docs = cases.documents(spark, rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = X.train(docs, label_frame(spark, labels)), X.train(docs, label_frame(spark, flipped))
    assert a.places.tolist() == b.places.tolist() and a.values.tolist() == b.values.tolist()


def test_no_labels(spark):
    docs = cases.documents(spark, cases.odd_rows())
    assert {r["score"] for r in X.score(docs, X.train(docs, label_frame(spark, []))).collect()} == {0.5}


def test_features_stay_in_their_row():
    raw, at = flat(pa.array(["One two THREE", "", None, "three four", "solo"]))
    place, row = X.features(raw, at)
    assert Counter(row.tolist()) == {0: 3 + 2 + 1, 3: 2 + 1, 4: 1}
    own, _ = X.features(*flat(pa.array(["three"])))
    assert own[0] in place[row == 0] and own[0] in place[row == 3]


def brute_logs(texts):
    """Interpolated modified Kneser-Ney from its formulas, by dictionaries."""
    tri = Counter()
    for codes in texts:
        s = [K.START, K.START, *codes]
        tri.update(zip(s, s[1:], s[2:]))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)

    def discounts(n):
        k = Counter(n.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else 0
        d = [i - (i + 1) * y * k[i + 1] / k[i] if y and k[i] and k[i + 1] else i / 2 for i in (1, 2, 3)]
        return [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d)]

    d3, d2, d1 = discounts(tri), discounts(bi), discounts(uni)

    def p(table, d, context, c, below):
        known = {w: n for (*h, w), n in table.items() if tuple(h) == context} if context is not None else {w: n for w, n in table.items()}
        if not known:
            return below
        whole = sum(known.values())
        cut = lambda n: d[min(n, 3) - 1]
        n = known.get(c, 0)
        return max(n - cut(n), 0) / whole * bool(n) + sum(map(cut, known.values())) / whole * below if n else sum(map(cut, known.values())) / whole * below

    def full(a, b, c):
        one = p(uni, d1, None, c, 1 / K.SYMBOLS)
        return p(tri, d3, (a, b), c, p(bi, d2, (b,), c, one))

    return full


def test_model_equals_formulas(spark):
    rng = random.Random(4)
    texts = ["The quick, brown fox. " * rng.randint(0, 3) + cases.text(rng, rng.randint(1, 40)) + " A B!! cc cc" for _ in range(60)]
    docs = cases.documents(spark, list(enumerate(texts)))
    codes = K.encode(docs)
    logs = K.train(K.count_trigrams(codes))
    assert np.allclose(np.exp(logs).reshape(-1, K.SYMBOLS).sum(1), 1)
    full = brute_logs([list(r["codes"]) for r in codes.collect()])
    for _ in range(300):
        a, b, c = (rng.choice([0, 1, 4, 8, 9, 16, 25, 32, 57, 63]) for _ in range(3))
        assert logs[(a * 64 + b) * 64 + c] == pytest.approx(math.log(full(a, b, c)), rel=1e-9)


def test_trigrams_begin_anew_in_each_row():
    at = np.array([0, 0, 1, 3, 3, 7])
    codes = np.arange(7, dtype=np.uint8)
    got = K.trigrams(codes, at)
    want = []
    for a, b in zip(at, at[1:]):
        s = [K.START, K.START, *codes[a:b].tolist()]
        want += [(x * 64 + y) * 64 + z for x, y, z in zip(s, s[1:], s[2:])]
    assert got.tolist() == want


def test_classifier(spark):
    rng = random.Random(6)
    sentence = lambda: cases.text(rng, rng.randint(4, 15)).capitalize() + "."
    good = [(i, " ".join(sentence() for _ in range(rng.randint(2, 12)))) for i in range(400)]
    bad = [(1000, " ".join(f"W{i}$$$" for i in range(60))), (1001, "SHOUT!! AT!! ME!! " * 20), (1002, "same " * 80), (1003, "again. again. " * 40)]
    odd = [(2000, None), (2001, ""), (2002, " \n "), (None, good[0][1])]
    docs = cases.documents(spark, good + bad + odd)
    labels = label_frame(spark, [(i, 1, 0) for i, _ in good[:200]] + [(1000, 0, 0), (None, 1, 0), (5, None, None)])
    got = {r["doc_id"]: r for r in K.classify(docs, labels).collect()}
    assert len(got) == len(good + bad + odd)
    assert sum(not got[i]["keep"] for i, _ in good) <= 2
    assert not any(got[i]["keep"] for i in (1000, 1001, 1002, 1003, 2000, 2001, 2002)) and got[None]["keep"]
    assert got[2000]["perplexity"] is None
    kept = K.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(i) for i, r in got.items() if r["keep"])
    assert K.classify(docs.limit(0), labels).count() == 0
    assert all(r["keep"] for r in K.classify(docs.where("doc_id < 2000"), label_frame(spark, [])).collect())


def byte_formula(texts):
    """P(byte | four before) from the formulas of interpolated modified Kneser-Ney, by dictionaries."""
    counts = {5: Counter()}
    for t in texts:
        s = b"\0" * 4 + t.encode()
        counts[5].update(s[i : i + 5] for i in range(len(s) - 4))
    for k in range(4, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def cuts(n):
        k = Counter(n.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else 0
        d = [i - (i + 1) * y * k[i + 1] / k[i] if y and k[i] and k[i + 1] else i / 2 for i in (1, 2, 3)]
        return [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d)]

    d = {k: cuts(n) for k, n in counts.items()}

    def p(g):
        if not g:
            return 1 / 256
        same = [n for x, n in counts[len(g)].items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        cut, n = (lambda n: d[len(g)][min(n, 3) - 1]), counts[len(g)].get(g, 0)
        return ((n - cut(n) if n else 0) + sum(map(cut, same)) * p(g[1:])) / sum(same)

    return p


def test_byte_model_equals_formulas(spark):
    from quaylight.llm import byte_model as B

    rng = random.Random(8)
    texts = [cases.text(rng, rng.randint(1, 30), 60) for _ in range(25)] + ["é ß"]
    docs = cases.documents(spark, [*enumerate(texts), (99, "w1 zzz Q"), (100, ""), (101, None)]).select("doc_id", "text", "lang")
    trusted = spark.createDataFrame([(i,) for i in range(len(texts))], "_id long")
    got, mean = B.probabilities(B.asked(B.blocks(docs), trusted))
    p, rows = byte_formula(texts), got.collect()
    for r in rng.sample(rows, 200) + rows[:20]:
        assert r["p"] == pytest.approx(p(r["g"].to_bytes(5, "big")), rel=1e-9)
    one = {r["doc_id"]: r["_bytes"] for r in B.rated(docs, trusted, lambda raw, at: np.zeros(len(at) - 1)).collect()}
    s = b"\0" * 4 + b"w1 zzz Q"
    want = math.exp(-(sum(math.log(p(s[i : i + 5])) for i in range(8)) + B.PRIOR_BYTES * mean) / (8 + B.PRIOR_BYTES))
    assert one[99] == pytest.approx(want, rel=1e-9) and one[100] is None and one[101] is None


def test_words_of_other_letters_go(spark):
    """Junk in the shape of good text, which classes of words can't tell from it."""
    rng = random.Random(16)
    parts = ["ther", "ing", "an", "ou", "ble", "st", "re", "ion", "ed", "wh"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(4, 15))).capitalize() + "."
    good = [(i, " ".join(sentence() for _ in range(rng.randint(4, 12)))) for i in range(300)]
    mixed = [(1000 + i, " ".join("".join(rng.sample(w, len(w))) for w in t.lower().replace(".", "").split()).capitalize() + ".") for i, t in good[:20]]
    other = [(2000 + i, "".join(rng.choice("bcdfgjkmqvxz") if c.islower() else c for c in t)) for i, t in good[20:40]]
    got = {r["doc_id"]: r["keep"] for r in K.classify(cases.documents(spark, good + mixed + other), label_frame(spark, [(i, 1, 0) for i, _ in good[:200]])).collect()}
    assert sum(not got[i] for i, _ in good) <= 2
    assert not any(got[i] for i, _ in mixed + other)


def plain_ftrl(rows, labels, l1, epochs):
    """One coordinate at a time, as the paper states it."""
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= (0 if i == "bias" else l1) else -(z[i] - math.copysign(0 if i == "bias" else l1, z[i])) / ((X.BETA + math.sqrt(n[i])) / X.ALPHA)
    for _ in range(epochs):
        for row, y in zip(rows, labels):
            at = [*row.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            if abs(g) < 1e-4:
                continue
            for i in at:
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / X.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(21)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 12))) for _ in range(150)]
    labels = np.array([float(3 in r or rng.random() < 0.1) for r in rows])
    for l1 in (0.5, 2.0):
        got, want = X.ftrl(rows, labels, l1, 3), plain_ftrl(rows, labels, l1, 3)
        assert dict(zip(got.places.tolist(), got.values)) == pytest.approx({i: w for i, w in want.items() if i != "bias"}, rel=1e-9)
        assert got.bias == pytest.approx(want["bias"], rel=1e-9)
    scores = [1 / (1 + math.exp(-(got.bias + sum(dict(zip(got.places.tolist(), got.values)).get(i, 0.0) for i in r.tolist())))) for r in rows]
    assert X.loss(got, rows, labels) == pytest.approx(-sum(math.log(s if y else 1 - s) for s, y in zip(scores, labels)) / len(rows), rel=1e-9)
