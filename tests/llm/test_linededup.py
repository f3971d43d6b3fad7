import hashlib
import random
import re

from tests.llm import cases

from quaylight.llm import linededup as L


def chunks(text):
    lines, out, prior = text.split("\n"), [[]], 0
    for i, line in enumerate(lines):
        h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        out[-1].append(line)
        if (h + prior * L.BASE) % L.DIVISOR == 0 and i < len(lines) - 1:
            out.append([])
        prior = h
    return out


def brute(rows):
    seen, order = {}, sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    kept = {}
    for row in order:
        left, lost = [], 0
        for c in chunks(row[1]):
            text = "\n".join(c)
            if (len(c) >= L.LEAST_LINES or len(re.findall("[^ \t\n\r]+", text)) >= L.LEAST_WORDS) and text in seen:
                lost += len(c)
            else:
                seen[text] = row
                left.append(text)
        kept[row] = ("\n".join(left), lost)
    return kept


def test_against_brute_force(spark):
    rng = random.Random(4)
    passage = "\n".join(cases.text(rng, 12) for _ in range(9))
    rows = cases.odd_rows() + [(20 + i, "\n".join([cases.text(rng, 5) for _ in range(rng.randint(0, 6))] + [passage] + [cases.text(rng, 5) for _ in range(rng.randint(0, 6))])) for i in range(60)]
    rows += [(200, passage + "\n" + passage), (201, "x\n" * 50), (202, "x\n" * 50), (203, "one line"), (204, "one line"), (205, cases.text(random.Random(1), 60)), (206, cases.text(random.Random(1), 60))]
    docs = cases.documents(spark, rows)
    got = L.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "removed_lines", "removed_chunks"]
    want = brute(rows)
    out = sorted(((r["doc_id"], r["text"], r["removed_lines"], r["_key"]) for r in got.collect()), key=repr)
    assert out == sorted(((i, want[i, t][0], want[i, t][1], "x") if t is not None else (i, None, 0, "x") for i, t in rows), key=repr)
    assert sum(r[2] for r in out) > 250
    assert L.dedup_lines(cases.documents(spark, [])).count() == 0


def test_boundaries_resist_shifts(spark):
    rng = random.Random(7)
    lines = [cases.text(rng, 6) for _ in range(400)]
    df = spark.createDataFrame([(0, "\n".join(lines)), (1, "\n".join(["new", "lines", *lines]))], "i int, text string")
    a, b = ({c["text"] for c in r["c"]} for r in df.orderBy("i").select(L.line_chunks(df["text"]).alias("c")).collect())
    assert len(a & b) >= len(a) - 2


def words(text):
    return len(re.findall("[^ \t\n\r]+", text))


def brute_runs(rows):
    """Every run of lines of 50 words or more, and short chunks, against the first place of their text: all runs, not only shortest ones."""
    first, found = {}, []
    for at, (_, text) in enumerate(rows):
        lines, begin, runs = text.split("\n"), 0, set()
        for c in chunks(text):
            if len(c) >= L.LEAST_LINES and words("\n".join(c)) < L.LEAST_WORDS:
                runs.add((begin, len(c)))
            begin += len(c)
        worded = [i for i, x in enumerate(lines) if words(x)]
        runs |= {(a, b - a + 1) for a in worded for b in worded if a <= b and words("\n".join(lines[a : b + 1])) >= L.LEAST_WORDS}
        for a, n in sorted(runs):
            run = "\n".join(lines[a : a + n])
            lead = first.setdefault(run, (at, a))
            if lead[0] != at or a >= lead[1] + n:
                found.append((at, a, n))
    gone = [set() for _ in rows]
    for at, a, n in found:
        gone[at] |= set(range(a, a + n))
    return [("\n".join(x for i, x in enumerate(t.split("\n")) if i not in g), len(g)) for (_, t), g in zip(rows, gone)]


def planted(rng, shapes, copies):
    """Passages of lines x words in own surroundings; (rows, lines of the passage by doc_id)."""
    rows, inside = [], {}
    for k, (n, w) in enumerate(shapes):
        passage = [" ".join(f"p{k}x{j}y{i}" for i in range(w)) for j in range(n)]
        for c in range(copies):
            around = [[f"d{k}_{c}_{rng.random()} " + cases.text(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 5))] for _ in range(2)]
            inside[len(rows)] = (passage, c)
            rows.append((len(rows), "\n".join([*around[0], *passage, *around[1]])))
    return rows, inside


def test_planted_passages_go_whole(spark):
    shapes = [(1, 60), (2, 30), (3, 20), (4, 15), (8, 10), (20, 10), (3, 25)]
    rows, inside = planted(random.Random(11), shapes, 12)
    got = {r["doc_id"]: r["text"] for r in L.dedup_passages(cases.documents(spark, rows)).collect()}
    for i, text in rows:
        passage, copy = inside[i]
        assert got[i] == (text if copy == 0 else "\n".join(x for x in text.split("\n") if x not in passage))


def test_passages_against_brute_force(spark):
    rng = random.Random(12)
    rows, _ = planted(rng, [(2, 40), (5, 13), (1, 55), (3, 30), (6, 2)], 5)
    line = cases.text(rng, 20)
    short = [cases.text(rng, 9) for _ in range(12)]
    rows += [(100, "x\n" * 130), (101, "x\n" * 40), (102, "\n".join([line, "", line, "", line, "", line, line, line])), (103, "\n\n" + rows[0][1]), (104, rows[0][1]), (105, ""), (106, "\n"), (107, "a b\nc")]
    rows += [(110 + i, "\n".join(short[i : i + 7] + ["", f"own {i}"] + short[: i + 1])) for i in range(6)]
    docs = cases.documents(spark, [*rows, (999, None)])
    got = {r["doc_id"]: r for r in L.dedup_passages(docs).collect()}
    assert L.dedup_passages(docs).columns == [*docs.columns, "n_lines", "removed_lines", "removed_passages"]
    assert got[999]["text"] is None and got[999]["n_lines"] == got[999]["removed_lines"] == 0
    for (i, t), (text, lost) in zip(rows, brute_runs(rows)):
        assert (got[i]["text"], got[i]["removed_lines"], got[i]["n_lines"]) == (text, lost, t.count("\n") + 1), i
    assert L.dedup_passages(cases.documents(spark, [])).count() == 0
