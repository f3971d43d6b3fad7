"""Relations that carry the operators over general tables: texts as files, events as findings, small repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight import vocabulary as V

#: Suffixes that documents get in turn, by their id.
SUFFIXES = ["src/f{}.py", "src/f{}.ts", "docs/f{}.md", ".env.production", "conf/f{}.yaml", "tests/f{}.py", ".env", ".env.example", "img/f{}.png", "src/f{}.go"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of their source's repository; the suffix goes by doc_id."""
    d = read(spark, folder, "documents")
    kinds = F.array(*map(F.lit, SUFFIXES))
    name = F.replace(F.get(kinds, F.pmod("doc_id", F.lit(len(SUFFIXES))).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    path = F.concat(F.lit("d"), (F.floor(F.col("doc_id") / 10)).cast("string"), F.lit("/"), name)
    return d.select(F.col("source").alias("repo_id"), path.alias("file_path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("length"), "doc_id")


CORPUS_SQL = """
  SELECT source AS repo_id, doc_id, text AS content,
         'd' || CAST(doc_id // 10 AS VARCHAR) || '/' || replace((['src/f{}.py','src/f{}.ts','docs/f{}.md','.env.production','conf/f{}.yaml','tests/f{}.py','.env','.env.example','img/f{}.png','src/f{}.go'])[(doc_id % 10) + 1], '{}', CAST(doc_id AS VARCHAR)) AS file_path
  FROM documents"""


def planted_line(doc_id, kind):
    """A line whose secret is made of the id's SHA-256: no secret stands in this repository."""
    h = F.sha2(doc_id.cast("string"), 256)
    up = F.upper(h)
    choices = [
        F.concat(F.lit("auth ghp"), F.lit("_"), F.substring(h, 1, 36)),
        F.concat(F.lit("id AKIA"), F.substring(up, 1, 16), F.lit(" end")),
        F.concat(F.lit("g AIza"), F.substring(h, 1, 35)),
        F.concat(F.lit('password = "'), F.substring(h, 1, 12), F.lit('"')),
        F.concat(F.lit("api_key = "), F.substring(h, 1, 20), F.lit("-x")),
        F.concat(F.lit("db://user:"), F.substring(h, 1, 10), F.lit("@host/x, z")),
        F.concat(F.lit('aws_secret_access_key="'), F.substring(h, 1, 40), F.lit('"')),
        F.lit("token = changeme"),
        F.concat(F.lit("TOKEN_LIMIT="), F.substring(h, 1, 9)),
        F.lit("nothing here"),
    ]
    return F.get(F.array(*choices), kind.cast("int"))


PLANTED_SQL = """
  SELECT repo_id, file_path, doc_id, ([
    'auth ghp' || '_' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 36),
    'id AKIA' || substr(upper(sha256(CAST(doc_id AS VARCHAR))), 1, 16) || ' end',
    'g AIza' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 35),
    'password = "' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) || '"',
    'api_key = ' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 20) || '-x',
    'db://user:' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 10) || '@host/x, z',
    'aws_secret_access_key="' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 40) || '"',
    'token = changeme',
    'TOKEN_LIMIT=' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 9),
    'nothing here'])[((doc_id // 10) % 10) + 1] AS line
  FROM corpus"""


def planted_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One planted line for each file, as line 1."""
    f = corpus_files(spark, folder)
    return f.select("repo_id", "file_path", "doc_id", F.lit(1).cast("long").alias("line_no"), planted_line(F.col("doc_id"), F.pmod(F.floor(F.col("doc_id") / 10), F.lit(10))).alias("line"))



def event_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as findings: six to a repository, rule by type, severity and confidence by value and id."""
    e = read(spark, folder, "events")
    t = ((F.length("event_type") + F.floor(F.col("event_id") / 3)) % 9).cast("int")
    rule = F.get(F.array(*[F.lit(r[0]) for r in V.RULES[:9]]), t)
    severity = F.get(F.array(*map(F.lit, V.SEVERITIES)), (F.col("event_id") % 5).cast("int"))
    confidence = F.get(F.array(*map(F.lit, V.CONFIDENCES)), (F.col("event_id") % 3).cast("int"))
    template = F.get(F.array(*[F.lit(r[7]) for r in V.RULES[:9]]), t)
    none = F.lit("")
    made = {
        "repo_id": F.floor(F.col("event_id") / 6).cast("string"), "rule_id": rule, "rule_name": rule, "severity": severity, "confidence": confidence,
        "file_path": F.concat(F.lit("src/f"), (F.col("event_id") % 50).cast("string"), F.lit(".py")), "line_start": F.col("event_id"), "line_end": F.col("event_id"),
        "column_start": F.lit(0).cast("long"), "column_end": F.lit(9).cast("long"), "snippet_masked": none, "is_blocking": F.col("event_id") % 11 == 0,
        "finding_type": F.lit("content"), "description": F.concat(F.lit("d"), F.col("event_type")), "category": F.col("event_type"), "secret_type": F.col("event_type"), "message": none,
        "repair_template_key": F.when(F.col("event_id") % 13 == 0, "unknown").otherwise(template), "dimension": F.get(F.array(*map(F.lit, V.DIMENSIONS)), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)),
    }
    return e.select(*[made[c].alias(c) for c in V.FINDING_COLUMNS])


_RULES9 = ", ".join(f"'{r[0]}'" for r in V.RULES[:9])
_TEMPLATES9 = ", ".join(f"'{r[7]}'" for r in V.RULES[:9])
EVENTS_SQL = f"""
  SELECT CAST(event_id // 6 AS VARCHAR) AS repo_id, event_id,
         ([{_RULES9}])[(length(event_type) + event_id // 3) % 9 + 1] AS rule_id,
         (['critical','high','medium','low','info'])[(event_id % 5) + 1] AS severity, event_id % 5 AS s,
         (['high','medium','low'])[(event_id % 3) + 1] AS confidence, event_id % 3 AS c,
         'src/f' || CAST(event_id % 50 AS VARCHAR) || '.py' AS file_path, event_id AS line_start, event_id % 11 = 0 AS is_blocking,
         'd' || event_type AS description, event_type AS secret_type,
         CASE WHEN event_id % 13 = 0 THEN 'unknown' ELSE ([{_TEMPLATES9}])[(length(event_type) + event_id // 3) % 9 + 1] END AS repair_template_key,
         CASE WHEN event_id % 7 = 0 THEN 'incomplete_content' ELSE 'sensitive_data_security' END AS dimension
  FROM events"""


def event_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Counts beside the findings of event_findings: a tenth of repositories has scan errors, a seventeenth no files."""
    f = event_findings(spark, folder).select("repo_id").distinct()
    n = F.col("repo_id").cast("long")
    return f.select("repo_id", *[F.lit(0).cast("long").alias(c) for c in ("total_notices", "total_skipped_files")], F.when(n % 10 == 0, 1).otherwise(0).cast("long").alias("total_scan_errors"), F.when(n % 17 == 0, 0).otherwise(9).cast("long").alias("total_files_scanned"), F.lit(100).cast("long").alias("total_lines_scanned"))


#: Bodies of assessments, by an event's id modulo 16: three of several versions that can be read, the others not.
_ENTRY = '{"rule_id": "%s", "rule_name": "%s", "finding_count": %s, "occurrence_deductions": [#C], %s}'
_GOOD = '{"schema_version": 1, "score": #S, "score_before_caps": #S, "verdict": "pass", "score_breakdown": [%s], "coverage": {"status": "complete", "reasons": []}}'
BODIES = [
    _GOOD % (_ENTRY % ("R001_GITHUB_TOKEN", "", "#C", '"rule_cap": 50, "applied_deduction": #C')),
    _GOOD % (_ENTRY % ("R001_GITHUB_TOKEN", "Given", "#C", '"max_deduction": 50, "deduction": #C')),
    _GOOD % (_ENTRY % ("X9", "", "#C", '"rule_cap": 50, "applied_deduction": 99, "deduction": #C')),
    '{"score": ',
    "[1]",
    '{"score": "7", "verdict": "pass"}',
    '{"score": true, "verdict": "pass"}',
    '{"score": 101, "verdict": "pass"}',
    '{"score_before_caps": 7.5, "verdict": "pass"}',
    '{"score": 7}',
    '{"score": 7, "verdict": "maybe"}',
    _GOOD % (_ENTRY % ("R001_GITHUB_TOKEN", "", '"2"', '"deduction": #C')),
    '{"verdict": "pass", "coverage": []}',
    '{"verdict": "pass", "score_caps": [{"reason_code": "X", "applied": 1}]}',
    '{"verdict": "pass", "blocking_reasons": {}}',
    '{"verdict": "pass", "schema_version": 2}',
]


def stored_assessments(spark: SparkSession, folder: str) -> DataFrame:
    """(task_id, body): a stored assessment for each event."""
    e = read(spark, folder, "events")
    body = F.get(F.array(*map(F.lit, BODIES)), (F.col("event_id") % 16).cast("int"))
    body = F.replace(F.replace(body, F.lit("#C"), (F.col("event_id") % 7).cast("string")), F.lit("#S"), (F.col("event_id") % 101).cast("string"))
    return e.select(F.col("event_id").alias("task_id"), body.alias("body"))


def stored_plans(groups: DataFrame, summary: DataFrame) -> DataFrame:
    """Plans as stored, with deviations by the repository's number: groups lost, doubled and miscounted, states and columns that disagree, texts that no plan may have."""
    from quaylight.operators import stored

    r = F.col("repo_id").cast("long")
    lost = (r % 10 == 1) & (F.col("action_code") == "REVOKE_OR_ROTATE_SECRET")
    twice = (r % 10 == 2) & (F.col("action_code") == "REVIEW_SECRET_USAGE")
    more = F.when((r % 10 == 3) & (F.col("action_code") == "RERUN_SECURITY_SCAN"), 1).otherwise(0)
    g = groups.where(~lost)
    g = g.unionByName(g.where(twice)).withColumn("finding_count", F.col("finding_count") + more)
    other = F.when(F.col("plan_status") == "partial", "complete").otherwise("partial")
    odd = F.when(r % 17 == 7, "a\u200bb").when(r % 19 == 8, "see /home/x/y").otherwise("- [ROTATE]")
    prompt = F.concat(F.lit("Read https://example.org first.\n" + stored.PROMPT_HEAD + "\n"), odd)
    s = summary.withColumn("_status", F.col("plan_status")).withColumns({"plan_status": F.when(r % 5 == 1, other).otherwise(F.col("plan_status")), "cut": r % 9 == 4, "agent_prompt": prompt, "source_scan_updated_at": F.lit("2025-01-01T00:00:00+00:00")})
    body = F.when(r % 13 == 6, F.replace("body", F.lit('"schema_version":1'), F.lit('"schema_version":2'))).otherwise(F.col("body"))
    body = F.when(r % 23 == 9, F.replace(body, F.lit('"groups_truncated":false'), F.lit('"groups_truncated":"no"'))).otherwise(body)
    body = F.when(r % 31 == 11, F.replace(body, F.lit('"coverage_warning":true'), F.lit('"coverage_warning":false'))).otherwise(body)
    columns = summary.select("repo_id", "plan_status", (F.col("total_groups") + F.when(r % 29 == 3, 1).otherwise(0)).alias("total_repair_groups"), F.col("blocking_groups").alias("blocking_repair_groups"), F.lit("2025-01-01T00:00:00+00:00").alias("source_scan_updated_at"))
    return stored.bodies(g, s).withColumn("body", body).join(columns, "repo_id").withColumnRenamed("repo_id", "task_id")


def inline(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A few small repositories as files."""
    return spark.createDataFrame(rows, "repo_id string, file_path string, content string").withColumn("length", F.octet_length("content").cast("long"))
