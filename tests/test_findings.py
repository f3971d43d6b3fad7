import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quaylight import vocabulary as V
from quaylight.operators import lexer, repair, resolve, scoring, secrets, tasks
from quaylight.plans import hosts
from quaylight.sources import files as S

BASE = {"repo_id": "r", "rule_id": "R006_PASSWORD_ASSIGNMENT", "rule_name": "n", "severity": "high", "confidence": "medium", "file_path": "a.py", "line_start": 1, "line_end": 1, "column_start": 0, "column_end": 5, "snippet_masked": "", "is_blocking": False, "finding_type": "content", "description": "", "category": "", "secret_type": "password", "message": "", "repair_template_key": "use_env_var_password", "dimension": V.SENSITIVE}
DDL = ", ".join(f"{c} {'long' if c.startswith(('line_', 'column_')) else 'boolean' if c == 'is_blocking' else 'string'}" for c in V.FINDING_COLUMNS)


def findings(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c)[k] for k in V.FINDING_COLUMNS) for c in changes], DDL)


def test_overlaps_are_greedy(spark):
    a, b, c = ({"rule_id": r, "column_start": s, "column_end": e} for r, s, e in (("R001_GITHUB_TOKEN", 0, 10), ("R006_PASSWORD_ASSIGNMENT", 5, 20), ("R008_CONNECTION_STRING", 15, 30)))
    rows = [a, b, c, {"finding_type": "file", "line_start": None}, {"rule_id": "B004_PERMISSIVE_CORS", "column_start": None, "column_end": None}, {"line_start": 2}]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        out = resolve.drop_overlaps(findings(spark, *rows)).collect()
        assert sorted((r["rule_id"], r["line_start"] or 0) for r in out) == [("B004_PERMISSIVE_CORS", 1), ("R001_GITHUB_TOKEN", 1), ("R006_PASSWORD_ASSIGNMENT", 0), ("R006_PASSWORD_ASSIGNMENT", 2), ("R008_CONNECTION_STRING", 1)]


def test_riskier_late_finding_is_kept(spark):
    rows = [{"severity": "low", "confidence": "low", "line_start": i} for i in range(1, 101)] + [{"is_blocking": True, "severity": "critical", "line_start": 101}]
    out = resolve.top_per_rule_and_file(findings(spark, *rows)).collect()
    assert len(out) == 100 and {r["line_start"] for r in out} == {*range(1, 100), 101}


@pytest.mark.parametrize("severity, confidence, n, points", [("critical", "high", 1, 25), ("critical", "medium", 1, 19), ("high", "low", 1, 8), ("high", "high", 2, 11), ("medium", "high", 3, 4), ("low", "high", 4, 1), ("info", "high", 1, 0), ("high", "high", 9, 4)])
def test_points(spark, severity, confidence, n, points):
    got = spark.range(1).select(scoring.deduction(F.lit(severity), F.lit(confidence), F.lit(False), F.lit(n)).alias("x")).first()["x"]
    assert got == points == (V.BASE_POINTS[severity] * V.CONFIDENCE_PERCENT[confidence] * V.REPEAT_PERCENT[min(n, 4) - 1] + 5000) // 10000


@pytest.mark.parametrize("score, blocking, verdict", [(100, 0, "pass"), (75, 0, "pass"), (74, 0, "warning"), (50, 0, "warning"), (49, 0, "blocked"), (100, 1, "blocked")])
def test_verdicts(spark, score, blocking, verdict):
    assert spark.range(1).select(scoring.verdict_of(F.lit(score), F.lit(blocking))).first()[0] == verdict


def summary(spark, **other):
    row = {"repo_id": "r", "total_findings": 1, "blocking_findings": 0, "returned_findings": 1, "findings_truncated": False, "total_scan_errors": 0, "total_files_scanned": 3} | other
    return spark.createDataFrame([tuple(row.values())], "repo_id string, total_findings long, blocking_findings long, returned_findings long, findings_truncated boolean, total_scan_errors long, total_files_scanned long")


def test_assessment_whatever_the_order(spark):
    rows = [{"line_start": i, "severity": ["high", "critical", "low"][i % 3], "confidence": ["high", "low"][i % 2], "rule_id": V.RULES[i % 4][0]} for i in range(1, 12)]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        seen.add(tuple(scoring.assess(findings(spark, *rows), summary(spark)).first()[:4]))
    assert len(seen) == 1
    assert scoring.assess(findings(spark, {"severity": "info"}), summary(spark, total_files_scanned=0, total_scan_errors=2)).first()[1:5] == (100, 74, "warning", "partial")
    assert scoring.assess(findings(spark, {"dimension": "basic_security"}), summary(spark)).first()[1:4] == (100, 100, "pass")


def test_caps_in_order(spark):
    s = summary(spark, blocking_findings=1, findings_truncated=True)
    got = scoring.score_caps(spark.createDataFrame([("r", 80)], "repo_id string, score_before_caps long"), s).collect()
    assert [tuple(r)[1:] for r in got] == [("BLOCKING_FINDING", 49, 80, 49, True), ("FINDINGS_TRUNCATED", 74, 49, 49, False)]


def test_repair_groups(spark):
    f = findings(spark, {"is_blocking": True, "rule_id": "R001_GITHUB_TOKEN", "repair_template_key": "rotate_github_token"}, {"file_path": "b.py"}, {"repair_template_key": "odd"})
    got = repair.ordered_groups(repair.groups(f)).collect()
    assert len(got) == 9 + 4 and sorted(r["group_id"] for r in got)[-1] == "RG013"
    assert [r["blocking"] for r in sorted(got, key=lambda r: r["group_id"])] == [True] * 9 + [False] * 4
    assert [r["mismatch"] for r in repair.needs_review(f).orderBy("repair_template_key").collect()] == [True, False, False]


def test_scan_shows_no_secret(spark):
    value = "a1B2" * 9
    text = "\n".join(["x = 1", f"t = 'ghp_{value}'", 'password = "Secr3t-Value"', "db = postgres://u:Secr3t-Value@h/d", "-----BEGIN RSA PRIVATE KEY-----", "abc"])
    f = hosts.inline(spark, [("r", "src/a.py", text), ("r", ".env", "API_KEY=Secr3t-Value"), ("r", ".env.example", 'password = "Secr3t-Value"')])
    out = resolve.number_findings(resolve.drop_overlaps(secrets.scan(f, S.explode_lines(f)))).orderBy("position").collect()
    assert [(r["file_path"], r["rule_id"][:4], r["line_start"]) for r in out] == [(".env", "R009", None), (".env", "R007", 1), ("src/a.py", "R001", 2), ("src/a.py", "R006", 3), ("src/a.py", "R008", 4), ("src/a.py", "R005", 5)]
    assert not any("Secr3t" in str(r) or value in str(r) for r in out)


def test_lexer():
    found = list(lexer.spans(".py", ['a = "# no" # yes', "'''open", "# in string", "end''' # c", 's = "un\\"closed # no', "x # z"]))
    assert [[("c", *s) for s in c] + [("s", *s) for s in t] for c, t in found] == [[("c", 11, 16), ("s", 4, 10)], [("s", 0, 7)], [("s", 0, 11)], [("c", 7, 10), ("s", 0, 6)], [("s", 4, 20)], [("c", 2, 5)]]
    found = list(lexer.spans(".js", ["a /* b */ c // d", "/* open", "still */ `t ${x}", "# ` + '//'"]))
    assert [c for c, _ in found] == [[(2, 9), (12, 16)], [(0, 7)], [(0, 8)], []]
    assert [s for _, s in found] == [[], [], [(9, 16)], [(0, 3), (6, 10)]]


def tar(entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data, kind in entries:
            info = tarfile.TarInfo(name)
            info.type, info.size = kind, len(data)
            info.linkname = "x"
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.txt", "hello")
        f.writestr("c\\d", "x")
    rows = [("ok", tar([("p/", b"", tarfile.DIRTYPE), ("p/a.py", b"x=1", tarfile.REGTYPE)])), ("link", tar([("l", b"", tarfile.SYMTYPE)])), ("up", tar([("../a", b"x", tarfile.REGTYPE)])), ("abs", tar([("/a", b"x", tarfile.REGTYPE)])), ("zip", z.getvalue()), ("bad", b"junk"), ("cut", rows_cut())]
    df = spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "repo_id string, content binary")
    got = S.admitted(S.archive_members(df)).collect()
    assert {r["repo_id"]: r["breach"] for r in got if r["breach"]} == {"link": "type", "up": "name_parent", "abs": "name_absolute", "zip": "name_backslash", "bad": "broken", "cut": "broken"}
    assert [bytes(r["content"]) for r in got if r["name"] in ("p/a.py", "a/b.txt")] == [b"x=1", b"hello"]
    assert {r["repo_id"]: r["k"] for r in df.select("repo_id", S.archive_kind(F.col("content")).alias("k")).collect()} == {"ok": "gzip", "link": "gzip", "up": "gzip", "abs": "gzip", "cut": "gzip", "zip": "zip", "bad": None}


def rows_cut():
    return tar([("a", bytes(random.Random(1).randbytes(5000)), tarfile.REGTYPE)])[:2000]


def test_eligibility(spark, tmp_path):
    for name, data in {"a.py": b"x", "big.txt": b"y" * (V.MAX_SCANNED_BYTES + 1), "edge.txt": b"y" * V.MAX_SCANNED_BYTES, "n.txt": b"a\x00b", "u.txt": b"\xff\xfe", "P.PNG": b"z", ".git/x": b"1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    f = S.folder_files(spark, str(tmp_path), "r")
    assert {r["file_path"]: r["w"] for r in f.select("file_path", S.reason_skipped().alias("w")).collect()} == {"a.py": None, "big.txt": "too_large", "edge.txt": None, "n.txt": "binary", "u.txt": "binary", "P.PNG": "binary"}


def test_tasks(spark):
    old = spark.createDataFrame([("a", "1", "c0", "u0"), ("b", "2", "c0", "u0")], "task_id string, body string, created_at string, updated_at string")
    new = spark.createDataFrame([("b", "3", None, None), ("c", "4", None, None)], old.schema)
    assert sorted(map(tuple, tasks.upsert(old, new, F.lit("now")).collect())) == [("a", "1", "c0", "u0"), ("b", "3", "c0", "now"), ("c", "4", "now", "now")]
    t = spark.createDataFrame([("a", "2024-01-01T00:00:00"), ("b", "odd"), ("c", None), ("d", "2024-01-09T00:00:00+00:00")], "task_id string, completed_at string")
    assert [r[0] for r in tasks.without_expired(t, t, F.lit("2024-01-10 00:00:00").cast("timestamp")).orderBy("task_id").collect()] == ["b", "c", "d"]
    e = tasks.fail_unfinished(spark.createDataFrame([("a", "running", None), ("b", "completed", None)], "task_id string, status string, error_message string"), "restart")
    assert sorted(map(tuple, e.collect())) == [("a", "failed", "restart"), ("b", "completed", None)]
    answer = spark.createDataFrame([('```json\n{"explanation": "a", "instruction": "b"}\n```',), ('{"explanation": " "}',), ("no",)], "t string")
    assert [r[0] and tuple(r[0]) for r in answer.select(repair.parsed_answer(F.col("t"))).collect()] == [("a", "b"), None, None]


def test_one_pass_equals_rule_by_rule(spark):
    h = "a1B2" * 9
    texts = [f"ghp" + f"_{h} AKIA" + "Q1" * 8, "AIza" + "x" * 35, 'password = "hunter2x" token=abcdef.ghi', f'aws_secret_access_key="{h}abcd"', "aws_secret: x", '"aws_secret": "short"', "db://u:changeme@h pg://u:realpw@h", "API_KEY=true", "# SECRET=value9", "SECRET=value9", "token = os.getenv('X')", "PWD=***", "client_secret = your-thing", "pw: x", "é🙂 token=zzz999"]
    rows = [(f"r{i % 2}", p, "\n".join(texts)) for i, p in enumerate(["src/a.py", ".env.production", "tests/x.py", ".env.example", "conf.yaml", ".env"])]
    f = hosts.inline(spark, rows)
    lines = S.explode_lines(f)
    a, b = (sorted(map(repr, g(f, lines).collect())) for g in (secrets.one_pass, secrets.rule_by_rule))
    assert a == b and len(a) > 60
