import random
import re

import numpy as np
from tests.llm import cases

from quaylight.llm import partenum as P
from quaylight.llm.common import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)]


def near(rng, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1):
    rng = random.Random(seed)
    rows = cases.odd_rows()
    common = cases.text(rng, 25)
    for g in range(40):
        base = cases.text(rng, rng.choice([3, 4, 8, 20, 60, 200, 500])) + (" " + common if g % 3 == 0 else "")
        for k in range(rng.choice([1, 2, 3, 8])):
            rows.append((1000 + 50 * g + k, near(rng, base, rng.randint(0, 1 + len(base.split()) // 60))))
    rows += [(9000 + i, rows[-1][1]) for i in range(5)]
    return rows


def test_against_all_pairs(spark):
    for words, percent in ((4, 85), (5, 80)):
        rows = corpus(words)
        got = sorted(map(tuple, P.similar_documents(cases.documents(spark, rows), words, percent).collect()), key=repr)
        assert got == sorted(brute(rows, words, percent), key=repr)


def test_large_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ELEMENTS", 900)
    monkeypatch.setattr(P, "BUCKET_ROWS", 12)
    monkeypatch.setattr(P, "MOST_MARKS", 64)  # a full map
    rng = random.Random(3)
    base = cases.text(rng, 60)
    rows = [(i, near(rng, base, rng.randint(0, 4))) for i in range(90)]
    got = sorted(map(tuple, P.similar_documents(cases.documents(spark, rows)).collect()))
    assert got == sorted(brute(rows, 4, 85))
    monkeypatch.setattr(P, "TASK_ELEMENTS", 10**9)
    monkeypatch.setattr(P, "TASK_SETS", 20)
    assert sorted(map(tuple, P.similar_documents(cases.documents(spark, rows)).collect())) == got


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        for n in (7, 9, 12, 30, 100, 400, 1500):
            for _ in range(20):
                a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
                most = int((100 - percent) * 2 * n // (100 + percent))
                gone = int(rng.integers(0, most // 2 + 1))
                b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, most - gone + 1)), np.uint64)])
                a, b = np.unique(a), np.unique(b)
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both) or (len(a) == len(b) == both):
                    continue
                sig, row = P.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())
                left = [np.setdiff1d(x, a[::3]) for x in (a, b)]  # whichever elements are left out of both
                sig, row = P.signatures(np.concatenate(left), np.array([0, len(left[0]), len(left[0]) + len(left[1])]), percent, np.array([len(a), len(b)]))
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())
                x, y = P.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both


def test_empty_and_first_of_groups(spark):
    assert P.similar_documents(cases.documents(spark, [])).count() == 0
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "other words are in here"), (None, "a b c d e f"), (4, ""), (6, None)]
    docs = cases.documents(spark, rows)
    kept = P.first_of_groups(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(repr(r) for r in rows if r[0] != 5)


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_sets_that_share_little_are_no_candidates(spark):
    """A sketch of 512 bits told nothing of sets of some 1,200 elements and more: those with one signature in common became one cluster, which grew with the corpus."""
    rng = random.Random(7)
    passage = " ".join(f"s{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))) for i, n in enumerate((1500, 1550, 2000, 2060, 2500, 1500))]
    rows.append((6, near(rng, rows[2][1], 8)))  # a set on either side of 2,048, where sketches double
    rows.append((7, near(rng, rows[2][1] + " " + " ".join(f"v{i}" for i in range(60)), 8)))
    table = P.set_table(cases.documents(spark, rows).selectExpr("doc_id", "doc_id as key", "text"), 5, 1).cache()
    node = {r["doc_id"]: r["node"] for r in table.collect()}
    buckets = spark.createDataFrame([(1, node[i]) for i in range(8)] + [(2, node[0]), (2, node[5]), (3, node[2]), (3, node[7])], "bucket long, node long")
    got = {frozenset((r["a"], r["b"])) for r in P.candidate_edges(buckets, table.select("node", "n_shingles", "sketch"), 80, 4).collect()}
    assert {len(r) for r in got} == {2} and set().union(*got) == {node[2], node[6], node[7]}


def test_sketches_of_two_lengths_meet():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 1100, np.uint64))
    b = np.unique(np.concatenate([a[200:], rng.integers(0, 1 << 63, 30, np.uint64)]))
    sets, at = np.concatenate([a, b, a[:0]]), np.array([0, len(a), len(a) + len(b), len(a) + len(b)])
    column = P.sized_sketches(sets, at)
    assert [8 * len(x) for x in column.to_pylist()] == [2048, 1024, 512]
    raw, offsets = P.flat(column)
    for bits in (1024, 512):
        assert (P.folded(raw, offsets, np.array([0, 1]), bits) == P.sketches(sets, at, bits)[:2].view(np.uint64)).all()


def test_turns_make_all_signatures():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 5, 9, 40, 300, 1000]
    sets, at = np.concatenate([np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in sizes]), np.cumsum([0, *sizes])
    pairs = lambda turn: sorted(zip(*(x.tolist() for x in P.signatures(sets, at, 80, turn=turn))))
    made = [pairs(turn) for turn in range(P.TURNS)]
    assert sorted(sum(made, [])) == pairs(None) and all(made)
    assert not {s for s, _ in made[0]} & {s for s, _ in made[1]}
