"""Searches for words before costly patterns: each text is lowered once, sources are searched for all words at once, and nothing that a rule finds is lost."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quaylight.operators import incomplete, lexer, security, whole
from tests.test_whole import EXAMPLES, SOURCES

FILES = "repo_id string, file_path string, content string, length long"


def _files(spark, *rows):
    return spark.createDataFrame([("r", path, text, len(text.encode())) for path, text in rows], FILES)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_and_lines_are_lowered_once(spark):
    files = _files(spark, ("src/a.py", "x = 1\n"))
    assert _plan(files.select(whole.secrets.worth_a_look(F.col("content")).alias("x"))).count("lower(") == 1
    lines = lexer.lex(files)
    assert _plan(lines.where(security.relevant())).count("lower(code") == 1
    assert _plan(lines.where(whole.deploy.relevant())).count("lower(bare") == 1
    assert "lower(content" not in _plan(whole.relevant_lines(files)) and "lower(cast(content" not in _plan(whole.relevant_lines(files))


@pytest.mark.parametrize("rules", list(EXAMPLES), ids=lambda m: m.__name__.rsplit(".", 1)[-1])
def test_one_pattern_lets_every_alternative_pass(spark, rules):
    matched = F.lit(False)
    for p in SOURCES[rules]:
        matched = matched | F.col("line").rlike(p)
    found = [r["line"] for r in spark.createDataFrame([(x,) for x in EXAMPLES[rules]], "line string").where(matched).collect()]
    assert found and pc.all(pc.match_substring_regex(pa.array(found), rules.MAY_HAVE, ignore_case=True)).as_py()


def test_lines_of_unfinished_code_are_kept(spark):
    """Words before the patterns of a line: all lines that a pattern matches are relevant, in any case that it takes."""
    texts = [
        "raise NotImplementedError", "throw new NotImplementedException(", "raise Boom('Not  Implemented yet')", "todo!()", "unimplemented!()", "THROW Oops(\"not implemented\")", "return panic('NOT IMPLEMENTED')",
        "return []", "RETURN Null;", "debugger;", "breakpoint()", "ipdb.set_trace()", "console.log(1)", "System.err.println(1)", "print(1)", "println!(1)", "x = 1", "returned = 1",
    ]
    none = F.array().cast("array<struct<start:int,text:string>>")
    lines = spark.createDataFrame([(t,) for t in texts], "code string").select("code", F.col("code").alias("bare"), none.alias("comments"))
    assert [r["code"] for r in lines.where(incomplete.relevant()).collect()] == texts[:-2]


def test_bare_routes_are_found_wherever_a_line_begins(spark):
    """Behind a byte order mark and a vertical tab, which end or begin no line for Java's ^."""
    files = _files(spark, ("src/a.rb", "﻿get '/x'\n"), ("src/b.rb", "x\x0bget '/y'\n"), ("src/c.rb", "x = 1\n"))
    got = whole.relevant_lines(files, ["B"]).collect()
    assert sorted((r["file_path"], r["line_no"]) for r in got) == [("src/a.rb", 1), ("src/b.rb", 2)]


def test_a_whole_file_goes_along_only_if_it_imports_a_limiter(spark):
    files = _files(spark, ("src/a.js", "import lim from 'Express-Rate-Limit'\nfoo(lim)\nbar()\n"), ("src/b.js", "app.get('/x', f)\nbar()\n"))
    got = whole.relevant_lines(files, ["B"]).collect()
    assert sorted((r["file_path"], r["line_no"]) for r in got) == [("src/a.js", 1), ("src/a.js", 2), ("src/a.js", 3), ("src/b.js", 1)]
    assert whole.relevant_lines(files, ["R"]).count() == 0


def test_binary_files_are_told_by_bytes(spark):
    """A NUL is searched by bytes: a position in characters would be counted through the whole text."""
    texts = {"a.py": b"x\x00y", "b.py": b"\xe4\x00\xb8", "c.py": b"\x00", "d.py": "ä\n".encode(), "e.py": b"\xff", "f.py": b"", "g.py": None}
    files = spark.createDataFrame([("r", p, t, len(t or b"")) for p, t in texts.items()], "repo_id string, file_path string, content binary, length long")
    reason = files.select("file_path", whole.S.reason_skipped().alias("reason"))
    assert {r["file_path"]: r["reason"] for r in reason.collect()} == dict.fromkeys(["a.py", "b.py", "c.py", "e.py"], "binary") | {"d.py": None, "f.py": None, "g.py": "read_error"}
    assert "locate" not in _plan(reason)
