"""Findings are read once where overlaps are dropped."""

from quaylight import vocabulary as V
from quaylight.operators import resolve


def _findings(spark, rows):
    """(rule, line, start, end) of one file as findings."""
    kinds = {c: "boolean" if c == "is_blocking" else "long" if c in ("line_start", "line_end", "column_start", "column_end") else "string" for c in V.FINDING_COLUMNS}
    made = [tuple({"repo_id": "r", "file_path": "f", "rule_id": rule, "line_start": line, "column_start": a, "column_end": b, "finding_type": kind}.get(c) for c in V.FINDING_COLUMNS) for rule, kind, line, a, b in rows]
    return spark.createDataFrame(made, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def test_overlaps_read_their_findings_once(spark, tmp_path):
    rows = [
        ("R006_PASSWORD_ASSIGNMENT", "content", 1, 5, 20), ("R001_GITHUB_TOKEN", "content", 1, 10, 15), ("I001_TODO_COMMENT", "content", 1, 30, 34), ("I001_TODO_COMMENT", "content", 2, 10, 15),
        ("R009_ENV_FILE_PRESENT", "file", None, None, None), ("D001_PRODUCTION_START", "content", None, 1, 2), ("R001_GITHUB_TOKEN", "file", 1, 10, 15),
    ]
    _findings(spark, rows).write.parquet(f"{tmp_path}/f")
    got = resolve.drop_overlaps(spark.read.parquet(f"{tmp_path}/f"))
    assert sorted((r["rule_id"], r["finding_type"], r["line_start"] or 0) for r in got.collect()) == sorted((r, k, n or 0) for r, k, n, *_ in rows[1:])
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("FileScan") == 1
