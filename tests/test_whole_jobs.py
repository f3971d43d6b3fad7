"""Queries that run over all rows of their tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_upsert_covers_every_event(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert events.where("event_id >= 500").count() > 0
    got = sorted(r["task_id"] for r in entry.queries()["q_upsert"](spark, FOLDER).collect())
    assert got == sorted(r["event_id"] for r in events.select("event_id").collect())


def test_prompt_lines_go_on_to_the_character_limit(spark):
    from quaylight.operators import publish

    groups = [("r", f"RG{i:03d}", f"ACTION_{i}" + "x" * (i * 7 % 400), i % 5, ["a", "b"]) for i in range(1, 700)] + [("s", "RG001", "ONE", 0, [])]
    got = publish.prompt_lines(spark.createDataFrame(groups, "repo_id string, group_id string, action_code string, finding_count long, related_rule_ids array<string>")).collect()
    room, want = publish.MAX_PROMPT_CHARS, []
    for _, number, action, n, _ in groups[:-1]:
        line = f"- [{action}]" + (f" ({n} findings)" if n else "") + " rules: a, b"
        room -= len(line) + 1
        if room < 0:
            break
        want.append((number, line))
    assert 3 < len(want) < 699
    assert sorted((r["group_id"], r["line"]) for r in got if r["repo_id"] == "r") == want
    assert any(r["group_id"] > "RG003" for r in entry.queries()["q_prompt_lines"](spark, FOLDER).collect())


def test_masked_lines_cover_every_kind(spark):
    got = [r["masked"] for r in entry.queries()["q_mask_lines"](spark, FOLDER).collect()]
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(any(x.startswith(p) for x in got) for p in ("auth", "id ", "g ", "db:", "password", "token ="))


def test_incomplete_rules_read_the_tables(spark, tmp_path):
    rows = [(0, "# TODO: later\nx = 1\nbreakpoint()\n", "en", "a", 40), (9, "// not implemented\nreturn nil\n", "en", "b", 30), (10, "x = 1\n", "en", "a", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["q_corpus_incomplete"](spark, str(tmp_path)).collect()
    assert {(r["repo_id"], r["file_path"], r["rule_id"], r["line_start"]) for r in got} == {("a", "d0/src/f0.py", "I001_TODO_COMMENT", 1), ("a", "d0/src/f0.py", "I004_DEBUG_BREAKPOINT", 3), ("b", "d0/src/f9.go", "I003_PLACEHOLDER_RETURN", 2)}
