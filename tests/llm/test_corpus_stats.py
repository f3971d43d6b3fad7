"""Phrases, divergences and rules against plain Python over odd rows, and the parts that SQL can't see."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quaylight.llm import divergence, phrases, rules, sketch
from tests.llm.cases import documents, odd_rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rank string, phrase string, kept string")


def rows_of():
    """Odd texts with null languages and sources, a hot source, repeated rows and columns whose names clash."""
    out = []
    for n, (i, t) in enumerate(odd_rows()):
        out.append((i, t, ["en", "de", None, "und"][n % 4], [None, "a", "a", "b", ""][n % 5], "r", "p", "k"))
    out += [(900 + n, "Alpha beta gamma. ALPHA beta\tgamma; delta: alpha beta gamma delta" + "é中 Ä." * (n % 3), "en", "hot", None, None, None) for n in range(40)]
    out += [(2000 + n, "tie one tie one, tie two tie two! one tie", "de", f"s{n % 3}", None, None, None) for n in range(35)]
    out += [out[-1]] * 3 + [(None, None, None, None, None, None, None), (7, "", "zz", "empty", None, None, None)]
    return out


def collocations(rows, least, first):
    n, f = Counter(), Counter()
    for row in rows:
        lang = "und" if row[2] is None else row[2]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (row[1] or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    kept = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    longer = Counter()
    for (lang, w), v in kept.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], v)
    found = {}
    for (lang, w), a in kept.items():
        if 100 * longer[lang, w] < 80 * a:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:first], 1))


@pytest.mark.parametrize("least, first", [(30, 2000), (3, 25)])
def test_collocations_are_those_of_all_runs(spark, least, first):
    rows = rows_of()
    got = phrases.collocations(table(spark, rows).repartition(5), least, first).collect()
    assert sorted(map(tuple, got)) == collocations(rows, least, first)


def test_sketch_with_few_cells_and_bits_lets_more_through_and_changes_nothing(spark, monkeypatch):
    rows = rows_of()
    monkeypatch.setattr(sketch, "MOST_BITS", 1 << 11)
    monkeypatch.setattr(sketch, "BYTES_A_CELL", 1 << 40)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, phrases.collocations(table(spark, rows), 5, 100).collect())) == collocations(rows, 5, 100)


def test_an_automaton_has_only_runs_that_pass():
    words = phrases._Words(pa.array(["a b c. b c a b"]))
    passing = {k: np.ones(len(words.starts), bool) for k in range(1, 5)}
    passing[2][:] = [True, False, False, True, False, True, False]
    got, lengths, counts = phrases._count_block(words, np.arange(7), passing)
    assert dict(zip(got, counts.tolist())) == {b"a": 2, b"b": 3, b"c": 2, b"a b": 2, b"b c": 2}
    assert dict(zip(got, lengths.tolist()))[b"a b"] == 2


def divergences(rows):
    counts, docs, groups = Counter(), Counter(), set()
    for row in rows:
        text, lang, source = (x or "" for x in row[1:4])
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(UPPER))
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= 10]
        own = [s for x, s in groups if x == lang]
        total = {s: sum(counts[lang, s, t] for t in kept) for s in own}

        def share(n, of):
            return 1 + 10**9 * (n + 2) // (of + 2 * len(kept))

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: {t: share(counts[lang, s, t], total[s]) for t in kept} for s in own}
        q = {t: share(sum(counts[lang, s, t] for s in own), sum(total.values())) for t in kept}
        for s in own:
            pairs = [(-sum(apart(p[s][t], p[x][t]) for t in kept), x.encode()) for x in own if x != s]
            terms = [(-apart(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", x.decode(), -v, r) for r, (v, x) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x.decode(), -v, r) for r, (v, x) in enumerate(sorted(terms)[:10], 1)]
    return sorted(out)


def test_divergences_are_those_of_every_term_and_pair(spark, monkeypatch):
    rows = rows_of()
    assert sorted(map(tuple, divergence.divergences(table(spark, rows).repartition(3)).collect())) == divergences(rows)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 2)
    monkeypatch.setattr(divergence, "PAIRS_HELD", 1)
    assert sorted(map(tuple, divergence.divergences(table(spark, rows)).collect())) == divergences(rows)


def test_shares_of_large_counts_are_exact(spark):
    n, total, terms = 9_000_000_000_000_000_001, 9_100_000_000_000_000_003, 12345
    got = spark.sql(f"select {divergence._share('n', 't', 'v')} as p from values ({n}L, {total}L, {terms}L) as x(n, t, v)").first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_operators_stand_empty_tables(spark):
    empty = table(spark, [])
    assert phrases.collocations(empty).count() == divergence.divergences(empty).count() == rules.judge(empty).count() == 0


def judged(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    chars = sum(map(len, w))
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    dup = len(lines) - len(set(lines))
    bad = (
        100 * symbols > 15 * len(w) or not 2 * len(w) <= chars <= 15 * len(w) or 100 * dup > 50 * len(lines)
        or 100 * sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w) < 70 * len(w) or len(re.findall("[A-Z]", text)) > len(re.findall("[a-z]", text))
        or 100 * text.count("!") > 30 * len(w) or 100 * sum(x.endswith("...") for x in lines) > 40 * len(lines) or 100 * max(Counter(w).values(), default=0) > 30 * len(w)
    )
    return len(w), chars, symbols, dup, len(repeated), failed, not failed and not bad


def junk():
    words = [f"wort{i % 97}ä{i % 13}" for i in range(120)]
    return [
        " ".join(words), " ".join(x + "###" for x in words), " | ".join(words), "\n".join(" ".join(words[i : i + 6]).upper() for i in range(0, 120, 6)), "!! ".join(words),
        "...\n".join(" ".join(words[i : i + 5]) for i in range(0, 120, 5)) + "...", " ".join("same" if i % 3 == 0 else x for i, x in enumerate(words)), "x " * 60, " ".join("a" + "bcd"[i % 3] + str(i) + " ." for i in range(60)),
        "\n".join(f"line{i} end{i}" for i in random.Random(5).choices(range(31), k=93)), "\n \n\t\n", "a\x00b " * 30, " ".join("z" * (20 + i) for i in range(60)), " ".join(words) + "\n" + " ".join(words), "\n\n" + " ".join(words[:50]) + "\r\n", " ".join(words[:49]),
    ]


def test_rules_are_those_of_plain_python(spark):
    rows = rows_of() + [(5000 + n, t, "en", "s", None, None, None) for n, t in enumerate(junk())]
    got = rules.judge(table(spark, rows).repartition(3))
    assert "rank" in got.columns and got.columns.count("kept") == 1
    seen = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got.collect())
    assert seen == sorted((str(r[0]), *judged(r[1])) for r in rows)
    assert {r["failed_rule"] for r in got.where("not kept").collect()} >= {"base", "many_symbols", "capitals", "broken_lines"}


def test_each_rule_rejects_something_by_itself(spark):
    one = {k: {r["doc_id"] for r in rules.judge(documents(spark, list(enumerate(junk()))), {k: v}).where(f"failed_rule = '{k}'").collect()} for k, v in rules.RULES.items()}
    assert all(one.values()), one


def test_order_weighs_what_earlier_rules_left():
    # a and b reject the same texts, c others; c costs more than a for as many
    masks = {0b011: 50, 0b100: 30, 0: 20}
    assert rules.best_order({"a": 1.0, "b": 1.1, "c": 2.0}, masks) == ["a", "c", "b"]
    assert rules.best_order({"a": 10.0, "b": 1.1, "c": 2.0}, masks) == ["b", "c", "a"]
    assert rules.best_order({"a": 3.0, "b": 1.0}, {0: 9}) == ["b", "a"]


def test_order_changes_no_verdict_and_spares_rules(spark, monkeypatch):
    docs = documents(spark, list(enumerate(junk() * 3)))
    want = None
    for names in (list(rules.RULES), list(rules.RULES)[::-1]):
        monkeypatch.setattr(rules, "plan", lambda *a, order=names: order)
        got = sorted((r["doc_id"], r["kept"]) for r in rules.judge(docs).collect())
        want = want or got
        assert got == want
    calls = Counter()

    def first(t, f):
        calls["first"] += len(t.n_words)
        return np.ones(len(t.n_words), bool)

    def never(t, f):
        calls["never"] += len(t.n_words)
        return np.zeros(len(t.n_words), bool)

    batch = pa.record_batch([pa.array([{"_": 0}] * 3), pa.array([" ".join(f"w{i}" for i in range(60))] * 3)], ["_row", "text"])
    out = list(rules._verdicts([batch], [("first", first), ("never", never)]))
    assert calls == {"first": 3} and not any(out[0].column("kept").to_pylist())
