"""Registered queries over the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight import vocabulary as V
from quaylight.functions import text as T
from quaylight.operators import incomplete, lexer, repair, resolve, scoring, secrets, tasks, views, whole
from quaylight.plans import hosts, planted
from quaylight.sources import files as S
from quaylight.storage import save, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CORPUS = f"WITH corpus AS ({hosts.CORPUS_SQL})"
PLANTED = f"{CORPUS}, planted AS ({hosts.PLANTED_SQL})"
EVENTS = f"WITH ev AS ({hosts.EVENTS_SQL})"


# sources, eligibility, lines


@query("SELECT doc_id, i + 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents) WHERE NOT (i = n - 1 AND line = '')")
def q_lines_explode(spark, d):
    docs = hosts.read(spark, d, "documents").select("doc_id", F.lit("").alias("repo_id"), F.lit("").alias("file_path"), F.col("text").alias("content"))
    return docs.select("doc_id", F.posexplode(S.lines_of(F.col("content"))).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


@query(CORPUS + " SELECT doc_id, CASE WHEN octet_length(encode(content)) > 1048576 THEN 'too_large' WHEN file_path LIKE '%.png' THEN 'binary' END AS reason FROM corpus")
def q_eligibility_reasons(spark, d):
    return hosts.corpus_files(spark, d).withColumn("content", F.col("content").cast("binary")).select("doc_id", S.reason_skipped().alias("reason"))


@query(CORPUS + " SELECT doc_id, regexp_matches(file_path, '\\.(py|ts|go)$') AND NOT regexp_matches(file_path, '/(tests|docs)/') AS is_source FROM corpus")
def q_ext_filter(spark, d):
    return hosts.corpus_files(spark, d).select("doc_id", lexer.is_source().alias("is_source"))


@query(CORPUS + " SELECT repo_id, count(*) AS file_count, CAST(sum(octet_length(encode(content))) AS BIGINT) AS total_size, min(split_part(file_path, '/', 1)) AS top_level_dir FROM corpus GROUP BY repo_id")
def q_folder_stats(spark, d):
    return S.folder_stats(hosts.corpus_files(spark, d))


@query(
    CORPUS + """, p AS (SELECT repo_id, file_path, string_split(file_path, '/') AS s FROM corpus)
    SELECT DISTINCT repo_id, path, is_folder FROM (
      SELECT repo_id, file_path AS path, false AS is_folder FROM p UNION ALL
      SELECT repo_id, array_to_string(s[1:i], '/'), true FROM (SELECT repo_id, s, unnest(range(1, len(s))) AS i FROM p))"""
)
def q_path_parents(spark, d):
    return S.paths_and_parents(hosts.corpus_files(spark, d))


@query(
    """WITH u AS (SELECT page_id, url, split_part(split_part(url, '://', 2), '/', 1) AS h FROM pages)
    SELECT page_id, split_part(url, '://', 1) = 'https' AND split_part(split_part(h, '?', 1), '#', 1) IN ('github.com','codeload.github.com','api.github.com','objects.githubusercontent.com') AS allowed FROM u"""
)
def q_allowed_redirect(spark, d):
    return hosts.read(spark, d, "pages").select("page_id", S.allowed_redirect("url").alias("allowed"))


@query(
    """WITH u AS (SELECT doc_id, 'https://github.com/' || source || '/r' || CAST(doc_id AS VARCHAR) || (CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.git' WHEN 2 THEN '/' ELSE '?a=1' END) AS url FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN split_part(url, '/', 4) END AS owner, CASE WHEN doc_id % 4 < 3 THEN 'r' || CAST(doc_id AS VARCHAR) END AS repo FROM u"""
)
def q_repository_address(spark, d):
    docs = hosts.read(spark, d, "documents")
    tail = F.get(F.array(*map(F.lit, ["", ".git", "/", "?a=1"])), (F.col("doc_id") % 4).cast("int"))
    url = F.concat(F.lit("https://github.com/"), F.col("source"), F.lit("/r"), F.col("doc_id").cast("string"), tail)
    return docs.select("doc_id", S.repository_address(url).alias("x")).select("doc_id", "x.owner", "x.repo")


# sensitive data


def _token_sql(start: int, size: int, pattern: str) -> str:
    return f"{PLANTED} SELECT doc_id, CAST({start} AS BIGINT) AS column_start, CAST({start + size} AS BIGINT) AS column_end, 'critical' AS severity, true AS is_blocking FROM planted WHERE regexp_matches(line, '{pattern}')"


def _token(spark, d, rule, pattern):
    lines = hosts.planted_lines(spark, d)
    at = lines.select("repo_id", "file_path", "doc_id")
    return secrets.token_rule(lines, rule, pattern).join(at, ["repo_id", "file_path"]).select("doc_id", "column_start", "column_end", "severity", "is_blocking")


@query(_token_sql(5, 40, "ghp_[A-Za-z0-9]{36}"))
def q_r001_planted(spark, d):
    return _token(spark, d, "R001", T.GITHUB)


@query(_token_sql(3, 20, "AKIA[A-Z0-9]{16}"))
def q_r002_planted(spark, d):
    return _token(spark, d, "R002", T.AWS_KEY)


@query(_token_sql(2, 39, "AIza[A-Za-z0-9_-]{35}"))
def q_r004_planted(spark, d):
    return _token(spark, d, "R004", T.GOOGLE)


@query(PLANTED + " SELECT doc_id, CAST(23 AS BIGINT) AS column_start, CAST(63 AS BIGINT) AS column_end FROM planted WHERE line LIKE 'aws_secret_access_key=%'")
def q_r003_planted(spark, d):
    lines = hosts.planted_lines(spark, d)
    found = secrets.aws_secret_rule(secrets.sensitive_assignments(lines))
    return found.join(lines, ["repo_id", "file_path"]).select("doc_id", "column_start", "column_end")


@query(PLANTED + " SELECT doc_id, CAST(12 AS BIGINT) AS column_start, CAST(24 AS BIGINT) AS column_end, CASE WHEN file_path LIKE '%/tests/%' THEN 'low' ELSE 'high' END AS severity FROM planted WHERE line LIKE 'password%'")
def q_r006_planted(spark, d):
    lines = hosts.planted_lines(spark, d)
    found = secrets.password_rule(secrets.sensitive_assignments(lines))
    return found.join(lines, ["repo_id", "file_path"]).select("doc_id", "column_start", "column_end", "severity")


@query(
    PLANTED + """ SELECT doc_id, CASE WHEN line LIKE 'api%' THEN 10 ELSE 8 END AS column_start, CASE WHEN line LIKE 'token%' OR file_path LIKE '%/tests/%' THEN 'low' ELSE 'high' END AS severity
    FROM planted WHERE line LIKE 'api_key%' OR line LIKE 'token =%'"""
)
def q_r007_planted(spark, d):
    lines = hosts.planted_lines(spark, d)
    found = secrets.token_assignment_rule(secrets.sensitive_assignments(lines))
    return found.join(lines, ["repo_id", "file_path"]).select("doc_id", F.col("column_start").cast("int").alias("column_start"), "severity")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
    SELECT doc_id, i + 1 AS line_no, unnest(regexp_extract_all(line, 'token = "([0-9a-f]{40})"', 1)) AS value FROM l WHERE regexp_matches(line, 'token = "[0-9a-f]{40}"')"""
)
def q_r007_tokens(spark, d):
    docs = hosts.read(spark, d, "documents").select(F.lit("").alias("repo_id"), F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    hits = secrets.token_assignment_rule(secrets.sensitive_assignments(S.explode_lines(docs)))
    line = F.col("snippet_masked")  # not masked yet: the rule alone
    return hits.where(line.rlike('token = "[0-9a-f]{40}"')).select(F.col("file_path").cast("long").alias("doc_id"), F.col("line_start").alias("line_no"), F.substring(line, (F.col("column_start") + 1).cast("int"), (F.col("column_end") - F.col("column_start")).cast("int")).alias("value"))


@query(PLANTED + " SELECT doc_id, CAST(10 AS BIGINT) AS column_start, CAST(20 AS BIGINT) AS column_end FROM planted WHERE line LIKE 'db:%'")
def q_r008_planted(spark, d):
    lines = hosts.planted_lines(spark, d)
    return secrets.connection_rule(lines).join(lines, ["repo_id", "file_path"]).select("doc_id", "column_start", "column_end")


@query(CORPUS + " SELECT repo_id, file_path, 'medium' AS severity FROM corpus WHERE file_path LIKE '%/.env'")
def q_r009_env_files(spark, d):
    return secrets.env_file_rule(hosts.corpus_files(spark, d)).select("repo_id", "file_path", "severity")


@query(CORPUS + " SELECT repo_id, 'R010_ENV_EXAMPLE_FILE' AS rule_id, 'Environment example file found: .env.example' AS message, file_path FROM corpus WHERE file_path LIKE '%/.env.example'")
def q_r010_notices(spark, d):
    return secrets.env_example_notices(hosts.corpus_files(spark, d))


@query(CORPUS + " SELECT doc_id, CAST(12 AS BIGINT) AS column_start FROM corpus WHERE file_path LIKE '%/.env.production' AND doc_id % 3 = 0")
def q_r011_production(spark, d):
    h = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 20)
    line = F.get(F.array(F.concat(F.lit("DB_PASSWORD=x"), h), F.lit("DB_PASSWORD=true"), F.lit("# DB_PASSWORD=realvalue1")), (F.col("doc_id") % 3).cast("int"))
    lines = hosts.corpus_files(spark, d).select("repo_id", "file_path", "doc_id", F.lit(1).cast("long").alias("line_no"), line.alias("line"))
    return secrets.production_rule(secrets.sensitive_assignments(lines)).join(lines, ["repo_id", "file_path"]).select("doc_id", "column_start")


@query(
    PLANTED + """ SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '(ghp_)[A-Za-z0-9]{32}([A-Za-z0-9]{4})', '\\1...\\2'), '(AKIA)[A-Z0-9]{12}([A-Z0-9]{4})', '\\1...\\2'),
    '(AIza)[A-Za-z0-9_-]{31}([A-Za-z0-9_-]{4})', '\\1...\\2'), '(db://user:)[^@]+@', '\\1***@') AS masked FROM planted"""
)
def q_mask_tokens(spark, d):
    return hosts.planted_lines(spark, d).select("doc_id", T.mask_text("line").alias("masked"))


@query(
    PLANTED + """ SELECT doc_id, CASE WHEN line LIKE 'password%' THEN 'password = "<REDACTED>"' WHEN line LIKE 'aws_s%' THEN 'aws_secret_access_key="<REDACTED>"' WHEN line LIKE 'api_key%' THEN 'api_key = <REDACTED>'
    WHEN line LIKE 'token =%' THEN 'token = <REDACTED>' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '(ghp_)[A-Za-z0-9]{32}([A-Za-z0-9]{4})', '\\1...\\2'), '(AKIA)[A-Z0-9]{12}([A-Z0-9]{4})', '\\1...\\2'),
    '(AIza)[A-Za-z0-9_-]{31}([A-Za-z0-9_-]{4})', '\\1...\\2'), '(db://user:)[^@]+@', '\\1***@') END AS masked FROM planted"""
)
def q_mask_lines(spark, d):
    return hosts.planted_lines(spark, d).select("doc_id", T.mask_line("line").alias("masked"))




_VALUES = ["changeme", "Foobar", "hunter2", "<token>", "s3cr3t", "XXX"]


@query("SELECT doc_id, (['changeme','Foobar','hunter2','<token>','s3cr3t','XXX'])[(doc_id % 6) + 1] AS v, doc_id % 6 IN (0, 1, 3, 5) AS placeholder FROM documents")
def q_placeholder_class(spark, d):
    v = F.get(F.array(*map(F.lit, _VALUES)), (F.col("doc_id") % 6).cast("int"))
    return hosts.read(spark, d, "documents").select("doc_id", v.alias("v"), T.is_placeholder(v).alias("placeholder"))


@query(CORPUS + f" SELECT doc_id, (['true','null;','None)','trueish','FALSE,'])[(doc_id % 5) + 1] AS v, doc_id % 5 <> 3 AS nullish FROM corpus")
def q_nullish_class(spark, d):
    v = F.get(F.array(*map(F.lit, ["true", "null;", "None)", "trueish", "FALSE,"])), (F.col("doc_id") % 5).cast("int"))
    return hosts.corpus_files(spark, d).select("doc_id", v.alias("v"), T.is_nullish(v).alias("nullish"))


_KEYS = ["DB_PASSWORD", "apiKey", "TOKEN_LIMIT", "aws_secret_access_key", "mypassword", "API2KEY", "has-auth-token", "jwt.secret", "PASSWORD_LENGTH", "tokenizer"]
_CLASSES = ["password", "secret", None, "aws_secret", None, "secret", None, "secret", "password", None]


@query("SELECT doc_id, ([" + ", ".join(f"'{c}'" if c else "NULL" for c in _CLASSES) + "])[(doc_id % 10) + 1] AS class FROM documents")
def q_key_class(spark, d):
    key = F.get(F.array(*map(F.lit, _KEYS)), (F.col("doc_id") % 10).cast("int"))
    return hosts.read(spark, d, "documents").select("doc_id", T.key_class(key).alias("class"))


@query(
    """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN repeat(substr(sha256(CAST(doc_id AS VARCHAR)), 1, 4), 9) ELSE substr(sha256(CAST(doc_id AS VARCHAR)), 1, 36) END AS body FROM documents)
    SELECT doc_id, len(list_filter([1, 2, 3, 4], lambda k: repeat(substr(body, 1, k), 36 // k) = body)) > 0 AS low FROM b"""
)
def q_low_entropy(spark, d):
    h = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 4)
    body = F.when(F.col("doc_id") % 2 == 0, F.repeat(h, 9)).otherwise(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 36))
    return hosts.read(spark, d, "documents").select("doc_id", T.is_low_entropy(F.concat(F.lit("ghp_"), body), 4).alias("low"))


@query(
    f"""WITH corpus AS ({hosts.CORPUS_SQL}), p AS (SELECT doc_id, (doc_id // 10) % 10 AS kind, sha256(CAST(doc_id AS VARCHAR)) AS h FROM corpus),
    a AS (SELECT doc_id, 'password' AS key, substr(h, 1, 12) AS value, true AS quoted, 12 AS start FROM p WHERE kind = 3
    UNION ALL SELECT doc_id, 'api_key', substr(h, 1, 20) || '-x', false, 10 FROM p WHERE kind = 4
    UNION ALL SELECT doc_id, 'aws_secret_access_key', substr(h, 1, 40), true, 23 FROM p WHERE kind = 6
    UNION ALL SELECT doc_id, 'token', 'changeme', false, 8 FROM p WHERE kind = 7
    UNION ALL SELECT doc_id, 'TOKEN_LIMIT', substr(h, 1, 9), false, 12 FROM p WHERE kind = 8)
    SELECT doc_id, key, value, quoted, CAST(start AS BIGINT) AS start, CAST(start + length(value) AS BIGINT) AS "end", '=' AS op FROM a"""
)
def q_assignments(spark, d):
    return hosts.planted_lines(spark, d).select("doc_id", F.explode(T.assignments("line")).alias("a")).select("doc_id", "a.*")


@query()
def q_secret_scan(spark, d):
    f = hosts.corpus_files(spark, d).where(S.reason_skipped().isNull())
    return resolve.number_findings(resolve.drop_overlaps(secrets.scan(f, secrets.suspects(f))))


@query()
def q_planted_scan(spark, d):
    f, lines = hosts.corpus_files(spark, d), hosts.planted_lines(spark, d).drop("doc_id")
    return resolve.number_findings(resolve.drop_overlaps(secrets.scan(f, lines)))


_KEY_LINES = ["a -----BEGIN RSA PRIVATE KEY-----", "x", "-----BEGIN EC PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY----- y -----END PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "z"]


@query(
    """SELECT DISTINCT source AS repo_id, a AS line_start, b AS line_end, s AS column_start, e AS column_end
    FROM documents, (VALUES (CAST(1 AS BIGINT), CAST(4 AS BIGINT), CAST(2 AS BIGINT), CAST(33 AS BIGINT)), (5, 5, 0, 27), (6, 6, 0, 30)) t(a, b, s, e)"""
)
def q_r005_blocks(spark, d):
    repos = hosts.read(spark, d, "documents").select(F.col("source").alias("repo_id")).distinct()
    lines = repos.select("repo_id", F.lit("k.pem").alias("file_path"), F.posexplode(F.array(*map(F.lit, _KEY_LINES))).alias("i", "line")).select("repo_id", "file_path", (F.col("i") + 1).cast("long").alias("line_no"), "line")
    return secrets.private_key_rule(lines).select("repo_id", "line_start", "line_end", "column_start", "column_end")


# resolution, summary


_RISK = "is_blocking DESC, s, c, line_start"


@query(EVENTS + f", r AS (SELECT *, row_number() OVER (PARTITION BY file_path, rule_id ORDER BY {_RISK}) AS n FROM ev) SELECT line_start, rule_id FROM r WHERE n <= 5")
def q_topk_per_rule_file(spark, d):
    f = hosts.event_findings(spark, d).withColumn("repo_id", F.lit("one"))
    return resolve.top_per_rule_and_file(f, 5).select("line_start", "rule_id")


_PRIORITY = " ".join(f"WHEN '{r[0]}' THEN {r[6]}" for r in V.RULES if r[6] is not None)


@query(EVENTS + f" SELECT repo_id, line_start, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, line_start, CASE rule_id {_PRIORITY} ELSE 999 END, rule_id) - 1 AS position FROM ev")
def q_findings_order(spark, d):
    return resolve.number_findings(hosts.event_findings(spark, d)).select("repo_id", "line_start", "position")


@query(
    EVENTS + f""", p AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, line_start) - 1 AS position, count(*) OVER (PARTITION BY repo_id) AS n FROM ev),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY is_blocking DESC, dimension <> 'sensitive_data_security', s, c, position) - 1 AS r FROM p)
    SELECT repo_id, line_start, CASE WHEN n > 4 THEN r ELSE position END AS out_position FROM r WHERE CASE WHEN n > 4 THEN r ELSE position END < 4"""
)
def q_task_truncation(spark, d):
    return resolve.truncate_findings(resolve.number_findings(hosts.event_findings(spark, d)), 4).select("repo_id", "line_start", "out_position")


_SUMMARY = """, su AS (SELECT repo_id, count(*) AS total_findings, CAST(sum(CASE WHEN is_blocking THEN 1 ELSE 0 END) AS BIGINT) AS blocking_findings,
   CAST(sum(CASE WHEN dimension = 'sensitive_data_security' THEN 1 ELSE 0 END) AS BIGINT) AS sensitive, least(count(*), 5) AS returned_findings, count(*) > 5 AS findings_truncated,
   CASE WHEN CAST(repo_id AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END AS total_scan_errors, CASE WHEN CAST(repo_id AS BIGINT) % 17 = 0 THEN 0 ELSE 9 END AS total_files_scanned FROM ev GROUP BY repo_id)"""


def _summary(spark, d):
    return resolve.summarize(hosts.event_findings(spark, d), hosts.event_summaries(spark, d), 5)


@query(EVENTS + _SUMMARY + " SELECT repo_id, total_findings, blocking_findings, returned_findings, findings_truncated FROM su")
def q_summary_counts(spark, d):
    return _summary(spark, d).select("repo_id", "total_findings", "blocking_findings", "returned_findings", "findings_truncated")


@query(EVENTS + _SUMMARY + " SELECT repo_id, sensitive, total_findings - sensitive AS incomplete, CAST(0 AS BIGINT) AS basic FROM su")
def q_dimension_counts(spark, d):
    at = lambda k: F.element_at("dimension_counts", F.lit(V.DIMENSIONS[k]))
    return _summary(spark, d).select("repo_id", at(0).alias("sensitive"), at(1).alias("incomplete"), at(3).alias("basic"))


@query(EVENTS + _SUMMARY + " SELECT repo_id, sensitive AS total_findings, blocking_findings, sensitive > returned_findings AS findings_truncated FROM su")
def q_sensitive_summary(spark, d):
    return resolve.sensitive_summary(_summary(spark, d)).select("repo_id", "total_findings", "blocking_findings", "findings_truncated")


# scores


_DEDUCT = """, own AS (SELECT *, row_number() OVER (PARTITION BY repo_id, rule_id ORDER BY NOT is_blocking, s, c, file_path, line_start) AS n FROM ev WHERE dimension = 'sensitive_data_security'),
  one AS (SELECT *, ((CASE s WHEN 0 THEN 25 WHEN 1 THEN 15 WHEN 2 THEN 8 WHEN 3 THEN 3 ELSE 0 END) * (CASE WHEN is_blocking THEN 100 ELSE 100 - 25 * c END) * (CASE n WHEN 1 THEN 100 WHEN 2 THEN 75 WHEN 3 THEN 50 ELSE 25 END) + 5000) // 10000 AS lost FROM own),
  ru AS (SELECT repo_id, rule_id, count(*) AS finding_count, min(s) AS s, CAST(sum(lost) AS BIGINT) AS before FROM one GROUP BY repo_id, rule_id),
  de AS (SELECT *, CAST((CASE s WHEN 0 THEN 50 WHEN 1 THEN 40 WHEN 2 THEN 24 WHEN 3 THEN 10 ELSE 0 END) AS BIGINT) AS rule_cap FROM ru)"""
_SCORE = _DEDUCT + """, ba AS (SELECT su.repo_id, greatest(0, 100 - coalesce((SELECT CAST(sum(least(before, rule_cap)) AS BIGINT) FROM de WHERE de.repo_id = su.repo_id), 0)) AS score_before_caps FROM su),
  sc AS (SELECT su.*, score_before_caps, least(score_before_caps, CASE WHEN blocking_findings > 0 THEN 49 ELSE 100 END, CASE WHEN findings_truncated OR total_scan_errors > 0 OR total_files_scanned = 0 THEN 74 ELSE 100 END) AS score FROM su JOIN ba USING (repo_id))"""


def _own(spark, d):
    return hosts.event_findings(spark, d).where(F.col("dimension") == V.SENSITIVE)


@query(EVENTS + _DEDUCT + " SELECT repo_id, rule_id, finding_count, before AS deduction_before_rule_cap, rule_cap, least(before, rule_cap) AS applied_deduction FROM de")
def q_rule_deductions(spark, d):
    return scoring.rule_deductions(_own(spark, d)).drop("severity")


@query(EVENTS + _DEDUCT + " SELECT repo_id, rule_id, array_to_string(list(CAST(lost AS VARCHAR) ORDER BY n), ',') AS occurrence_deductions FROM one GROUP BY repo_id, rule_id")
def q_score_breakdown(spark, d):
    return scoring.occurrence_deductions(_own(spark, d)).withColumn("occurrence_deductions", F.concat_ws(",", F.col("occurrence_deductions").cast("array<string>")))


@query(
    EVENTS + _SUMMARY + _SCORE + """, caps AS (
      SELECT repo_id, score_before_caps, 'BLOCKING_FINDING' AS reason_code, 49 AS cap_value FROM sc WHERE blocking_findings > 0 UNION ALL
      SELECT repo_id, score_before_caps, 'FINDINGS_TRUNCATED', 74 FROM sc WHERE findings_truncated UNION ALL
      SELECT repo_id, score_before_caps, 'NO_FILES_SCANNED', 74 FROM sc WHERE total_files_scanned = 0 UNION ALL
      SELECT repo_id, score_before_caps, 'SCAN_ERRORS', 74 FROM sc WHERE total_scan_errors > 0),
    w AS (SELECT *, least(score_before_caps, coalesce(min(cap_value) OVER (PARTITION BY repo_id ORDER BY cap_value, reason_code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), score_before_caps)) AS b FROM caps)
    SELECT repo_id, reason_code, CAST(cap_value AS BIGINT) AS cap_value, b AS score_before_cap, least(b, cap_value) AS score_after_cap, cap_value < b AS applied FROM w"""
)
def q_score_caps(spark, d):
    s = _summary(spark, d)
    return scoring.score_caps(scoring.base_scores(scoring.rule_deductions(_own(spark, d)), s), s)


@query(EVENTS + _SUMMARY + _SCORE + " SELECT repo_id, score_before_caps, score, CASE WHEN blocking_findings > 0 OR score <= 49 THEN 'blocked' WHEN score <= 74 THEN 'warning' ELSE 'pass' END AS verdict FROM sc")
def q_verdict(spark, d):
    return scoring.assess(hosts.event_findings(spark, d), _summary(spark, d)).select("repo_id", "score_before_caps", "score", "verdict")


@query(EVENTS + _SUMMARY + " SELECT repo_id, CASE WHEN findings_truncated OR total_scan_errors > 0 OR total_files_scanned = 0 THEN 'partial' ELSE 'complete' END AS coverage_status FROM su")
def q_coverage(spark, d):
    return scoring.assess(hosts.event_findings(spark, d), _summary(spark, d)).select("repo_id", "coverage_status")


@query(EVENTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY s, c, file_path, line_start) AS position FROM ev WHERE is_blocking) SELECT repo_id, position, rule_id, severity, file_path, line_start, description FROM r WHERE position <= 100")
def q_blocking_reasons(spark, d):
    return scoring.blocking_reasons(hosts.event_findings(spark, d)).drop("rule_name")


# repairs


_ACTION_VALUES = "(VALUES " + ", ".join(f"('{a}', {p}, {str(b).lower()}, {str(s).lower()})" for a, p, b, s in V.ACTIONS) + ") ac(action_code, priority, action_blocking, singleton)"
_TEMPLATE_VALUES = "(VALUES " + ", ".join(f"('{t}', {p})" for t, ps in V.TEMPLATES.items() for p in ps) + ") te(template, p)"
_PAIRS = f""", pairs AS (SELECT ev.*, ac.* FROM ev JOIN {_ACTION_VALUES} ON is_blocking AND action_blocking UNION ALL
   SELECT ev.*, ac.* FROM ev JOIN {_TEMPLATE_VALUES} ON NOT is_blocking AND repair_template_key = template JOIN {_ACTION_VALUES} ON priority = p)"""


@query(EVENTS + _PAIRS + " SELECT line_start, action_code, priority FROM pairs")
def q_action_expand(spark, d):
    return repair.action_pairs(hosts.event_findings(spark, d)).select("line_start", "action_code", "priority")


_GROUPS = _PAIRS + """, gr AS (SELECT repo_id, action_code, priority, singleton, CASE WHEN singleton THEN NULL ELSE repair_template_key END AS kt, CASE WHEN singleton THEN NULL ELSE rule_id END AS kr, CASE WHEN singleton THEN NULL ELSE secret_type END AS ks,
   CASE WHEN singleton THEN NULL ELSE is_blocking END AS kb, count(*) AS finding_count, bool_or(is_blocking) AS blocking, min(s) AS s, min(c) AS c, count(DISTINCT file_path) AS total_related_files, min(file_path) AS first_file FROM pairs
   GROUP BY ALL)"""


@query(EVENTS + _GROUPS + " SELECT repo_id, action_code, finding_count, blocking, (['critical','high','medium','low','info'])[s + 1] AS highest_severity, total_related_files FROM gr WHERE NOT singleton")
def q_repair_groups(spark, d):
    return repair.groups(hosts.event_findings(spark, d)).where("not singleton").select("repo_id", "action_code", "finding_count", "blocking", "highest_severity", "total_related_files")


@query(EVENTS + _GROUPS + " SELECT repo_id, action_code, finding_count, blocking, (['high','medium','low'])[c + 1] AS highest_confidence FROM gr WHERE singleton")
def q_repair_singletons(spark, d):
    return repair.groups(hosts.event_findings(spark, d)).where("singleton").select("repo_id", "action_code", "finding_count", "blocking", "highest_confidence")


@query(
    EVENTS + _GROUPS + """ SELECT repo_id, action_code, coalesce(kr, '') AS rule_id, 'RG' || lpad(CAST(row_number() OVER (PARTITION BY repo_id ORDER BY blocking DESC, priority, s, c, action_code, coalesce(kt, ''), coalesce(kr, ''), coalesce(ks, ''), coalesce(first_file, '')) AS VARCHAR), 3, '0') AS group_id FROM gr"""
)
def q_group_ids(spark, d):
    return repair.ordered_groups(repair.groups(hosts.event_findings(spark, d))).select("repo_id", "action_code", F.coalesce("k_rule_id", F.lit("")).alias("rule_id"), "group_id")


@query(
    EVENTS + _PAIRS + """, fi AS (SELECT 'one' AS repo_id, action_code, rule_id, file_path, min(s * 10 + c) AS g FROM pairs WHERE NOT singleton GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY action_code, rule_id ORDER BY g, file_path) AS place FROM fi) SELECT action_code, rule_id, file_path, place FROM r WHERE place <= 20"""
)
def q_related_files(spark, d):
    return repair.related_files(hosts.event_findings(spark, d).withColumn("repo_id", F.lit("one")), 20).drop("repo_id")


_ALLOWED = "(VALUES " + ", ".join(f"('{r[0]}', '{r[7]}')" for r in V.RULES if r[0][0] == "R" and r[7]) + ", ('R007_GENERIC_TOKEN_ASSIGNMENT', 'rotate_aws_credentials')) al(rule, template)"
_BAD = f", bad AS (SELECT repo_id, bool_or(rule IS NULL) AS bad FROM ev LEFT JOIN {_ALLOWED} ON rule = rule_id AND template = repair_template_key GROUP BY repo_id)"


_CONDITIONS = _BAD + """, co AS (
   SELECT repo_id, 'BLOCKING_FINDINGS' AS condition, unnest(['VERIFY_NO_SECRET_REMAINS', 'RERUN_SECURITY_SCAN']) AS action_code FROM su WHERE blocking_findings > 0
   UNION ALL SELECT repo_id, 'FINDINGS_TRUNCATED', unnest(['REVIEW_SCAN_COVERAGE', 'RERUN_SECURITY_SCAN']) FROM su WHERE findings_truncated
   UNION ALL SELECT repo_id, 'NO_FILES_SCANNED', unnest(['REVIEW_SCAN_COVERAGE', 'RERUN_SECURITY_SCAN']) FROM su WHERE total_files_scanned = 0
   UNION ALL SELECT repo_id, 'SCAN_ERRORS', unnest(['RESOLVE_SCAN_ERROR', 'REVIEW_SCAN_COVERAGE', 'RERUN_SECURITY_SCAN']) FROM su WHERE total_scan_errors > 0
   UNION ALL SELECT repo_id, 'RULE_TEMPLATE_MISMATCH', unnest(['MANUAL_REVIEW_REQUIRED', 'RERUN_SECURITY_SCAN']) FROM bad WHERE bad)"""


@query(EVENTS + _SUMMARY + _CONDITIONS + " SELECT * FROM co")
def q_partial_conditions(spark, d):
    return repair.partial_conditions(hosts.event_findings(spark, d), _summary(spark, d))


_CANDIDATES = ", nu AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, line_start) - 1 AS position FROM ev), ca AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY s, position) AS item FROM nu WHERE NOT regexp_matches(rule_id, '^R00[1-5]_'))"


@query(EVENTS + _CANDIDATES + " SELECT repo_id, item, rule_id, line_start FROM ca WHERE item <= 3")
def q_llm_candidates(spark, d):
    return repair.explanation_candidates(resolve.number_findings(hosts.event_findings(spark, d)), 3).select("repo_id", "item", "rule_id", "line_start")


def _items(spark, d):
    c = repair.explanation_candidates(resolve.number_findings(hosts.event_findings(spark, d)))
    texts = spark.createDataFrame([(r[0], f"About {r[1]}", f"Fix {r[1]}") for r in V.RULES if r[0] != "R007_GENERIC_TOKEN_ASSIGNMENT"], "rule string, explanation string, instruction string")
    return repair.with_fallback(c, texts, ("About this", "Fix this"))


_NAMES = "(VALUES " + ", ".join(f"('{r[0]}', '{r[1]}')" for r in V.RULES if r[0] != "R007_GENERIC_TOKEN_ASSIGNMENT") + ") te(rule, name)"


@query(EVENTS + _CANDIDATES + f" SELECT repo_id, item, 'About ' || coalesce(name, 'this') AS explanation FROM ca LEFT JOIN {_NAMES} ON rule = rule_id WHERE item <= 50")
def q_template_enrich(spark, d):
    return _items(spark, d).select("repo_id", "item", "explanation")


@query(
    EVENTS + _CANDIDATES + """ SELECT repo_id, count(*) AS total_analyzed, CAST(sum(CASE WHEN item % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS total_llm, CAST(sum(CASE WHEN item % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_fallback,
    CASE WHEN count(*) = 1 THEN 'fallback' ELSE 'mixed' END AS source FROM ca WHERE item <= 50 GROUP BY repo_id"""
)
def q_llm_totals(spark, d):
    return repair.analysis_totals(_items(spark, d).withColumn("source", F.when(F.col("item") % 2 == 0, "llm").otherwise("fallback")))


# read side, tasks


@query(EVENTS + " SELECT line_start FROM ev WHERE dimension = 'sensitive_data_security' AND severity = 'high' AND contains(lower(file_path), 'f1')")
def q_ui_filter_search(spark, d):
    return views.filtered(hosts.event_findings(spark, d).withColumn("rule_name", F.lit("")), V.SENSITIVE, "high", "F1").select("line_start")


@query(EVENTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY line_start) AS n, ceil(count(*) OVER (PARTITION BY rule_id) / 25) AS pages FROM ev) SELECT rule_id, line_start, CAST(least(2, pages) AS BIGINT) AS page FROM r WHERE n > (least(2, pages) - 1) * 25 AND n <= least(2, pages) * 25")
def q_ui_page(spark, d):
    return views.page(hosts.event_findings(spark, d).withColumn("repo_id", F.col("rule_id")), ["line_start"], 2, 25).select("rule_id", "line_start", "page")


@query(
    EVENTS + _CANDIDATES + """, it AS (SELECT * FROM ca WHERE item <= 50), m AS (SELECT nu.repo_id, nu.position, it.item, row_number() OVER (PARTITION BY nu.repo_id, nu.position ORDER BY CASE WHEN it.line_start = nu.line_start THEN 0 ELSE 1 END, it.item) AS n
    FROM nu LEFT JOIN it ON it.repo_id = nu.repo_id AND it.rule_id = nu.rule_id AND it.file_path = nu.file_path) SELECT repo_id, position, item IS NOT NULL AS explained FROM m WHERE n = 1"""
)
def q_find_analysis(spark, d):
    return views.with_analysis(resolve.number_findings(hosts.event_findings(spark, d)), _items(spark, d)).select("repo_id", "position", F.col("explanation").isNotNull().alias("explained"))


_TASKS = "WITH ta AS (SELECT user_id AS task_id, event_id, ts, (['pending','running','completed','failed'])[(event_id % 4) + 1] AS status, event_id % 100 AS progress FROM events)"


def _task_events(spark, d):
    status = F.get(F.array(*map(F.lit, ["pending", "running", "completed", "failed"])), (F.col("event_id") % 4).cast("int"))
    return hosts.read(spark, d, "events").select(F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"), (F.col("event_id") % 100).alias("progress"))


@query(_TASKS + " SELECT task_id, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress, min(ts) AS created_at FROM ta GROUP BY task_id")
def q_latest_task_state(spark, d):
    return tasks.latest_state(_task_events(spark, d)).select("task_id", "status", "progress", "created_at")


@query(_TASKS + ", la AS (SELECT task_id, arg_max(status, (ts, event_id)) AS status, min(ts) AS created_at FROM ta GROUP BY task_id) SELECT task_id, created_at FROM la WHERE status = 'pending' ORDER BY created_at, task_id LIMIT 1")
def q_queue_oldest(spark, d):
    return tasks.oldest_pending(tasks.latest_state(_task_events(spark, d))).select("task_id", "created_at")


@query(_TASKS + ", la AS (SELECT task_id, arg_max(status, (ts, event_id)) AS status FROM ta GROUP BY task_id) SELECT CAST(sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN status = 'running' THEN 1 ELSE 0 END) AS BIGINT) AS running, sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) >= 5 AS is_full FROM la")
def q_queue_state(spark, d):
    return tasks.queue_state(tasks.latest_state(_task_events(spark, d)))


@query(_TASKS + ", ne AS (SELECT task_id, event_id, status, lead(status) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS next_status FROM ta) SELECT event_id AS seq, (status = 'pending' AND next_status IN ('running', 'completed', 'failed')) OR (status = 'running' AND next_status IN ('completed', 'failed')) AS allowed FROM ne WHERE next_status IS NOT NULL")
def q_allowed_changes(spark, d):
    w = Window.partitionBy("task_id").orderBy("ts", "seq")
    return tasks.allowed_changes(_task_events(spark, d).withColumn("next_status", F.lead("status").over(w)).where("next_status is not null")).select("seq", "allowed")


@query("SELECT event_id AS task_id FROM events WHERE event_id % 9 <> 0 AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOURS")
def q_ttl_expired(spark, d):
    text = F.when(F.col("event_id") % 9 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    t = hosts.read(spark, d, "events").select(F.col("event_id").alias("task_id"), text.alias("completed_at"))
    return tasks.expired(t, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("task_id")


@query("WITH la AS (SELECT user_id AS task_id, max(ts) AS created_at FROM events GROUP BY user_id) SELECT task_id, created_at FROM la ORDER BY created_at DESC, task_id LIMIT 10")
def q_history_top10(spark, d):
    e = hosts.read(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    return tasks.history(e).select("task_id", "created_at")


# lexed sources


@query(planted.COMMENTS_SQL)
def q_lexer_comments(spark, d):
    return lexer.lex(planted.repositories(spark, d)).where(F.size("comments") > 0).select("repo_id", "file_path", "line_no", "code", F.col("comments")[0]["text"].alias("comment"))


@query(planted.INCOMPLETE_SQL)
def q_incomplete_rules(spark, d):
    code = save(whole.relevant_lines(planted.repositories(spark, d), ["I"]))
    return incomplete.scan(code).select("repo_id", "rule_id", "file_path", "line_start", "snippet_masked")


@query()
def q_corpus_lexed(spark, d):
    return lexer.lex(hosts.corpus_files(spark, d)).groupBy("file_path").agg(F.count("*").alias("lines"), F.sum(F.size("strings")).alias("strings"))


_SOURCE_SUFFIXES = [".py", ".ts", ".go"]


@query(
    f"""WITH corpus AS ({hosts.CORPUS_SQL}) SELECT repo_id, file_path, 'I001_TODO_COMMENT' AS rule_id,
    CAST(len(regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) + 1 AS BIGINT) AS line_start,
    CASE doc_id % 10 WHEN 0 THEN '# ' ELSE '// ' END || 'TODO ' || CAST(doc_id AS VARCHAR) || ' token = "<REDACTED>"' AS snippet_masked FROM corpus WHERE doc_id % 10 IN (0, 1, 9)"""
)
def q_corpus_incomplete(spark, d):
    """Every document that is a source file, with a line at its end that has a marker and a secret."""
    f = hosts.corpus_files(spark, d).where(S.suffix().isin(_SOURCE_SUFFIXES))
    mark = F.concat(F.when(S.suffix() == ".py", "# ").otherwise("// "), F.lit("TODO "), F.col("doc_id").cast("string"), F.lit(' token = "'), F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 20), F.lit('"'))
    planted_file = f.withColumn("content", F.concat("content", F.lit("\n"), mark))
    code = save(lexer.lex(planted_file).where(incomplete.relevant()))
    return incomplete.scan(code).where("rule_id = 'I001_TODO_COMMENT'").select("repo_id", "file_path", "rule_id", "line_start", "snippet_masked")


def card_of(files: DataFrame) -> DataFrame:
    """Scanned in all dimensions, summed up and scored by the sensitive one, as the score is defined; a row for each repository."""
    found, walked = whole.scan(files)
    return scoring.assess(found, resolve.sensitive_summary(resolve.summarize(found, whole.totals(walked))))


def scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: every document as a file of its source."""
    return card_of(hosts.corpus_files(spark, folder))


@query()
def q_scorecard(spark, d):
    return scorecard(spark, d)


# whole repositories


@query(planted.CARD_SQL)
def q_planted_scorecard(spark, d):
    return card_of(planted.repositories(spark, d)).drop("coverage_reasons")


@query(planted.ALL_SQL + "SELECT * FROM every")
def q_planted_findings(spark, d):
    return whole.scan(planted.repositories(spark, d))[0].select("repo_id", "rule_id", "file_path", "line_start")


@query(
    planted.ALL_SQL
    + """SELECT repo_id, CAST(CASE WHEN n % 16 = 5 THEN 1 ELSE 0 END AS BIGINT) AS total_notices, CAST(CASE WHEN n % 61 < 9 THEN 1 ELSE 0 END AS BIGINT) AS total_skipped_files,
    (SELECT count(*) FROM every e WHERE e.repo_id = f.repo_id AND e.rule_id LIKE 'D%') AS deploy_findings, (SELECT count(*) FROM every e WHERE e.repo_id = f.repo_id) AS total_findings FROM f"""
)
def q_planted_summary(spark, d):
    found, walked = whole.scan(planted.repositories(spark, d))
    out = resolve.summarize(found, whole.totals(walked))
    return out.select("repo_id", "total_notices", "total_skipped_files", F.element_at("dimension_counts", F.lit(V.DIMENSIONS[2])).alias("deploy_findings"), "total_findings")


@query(planted.DEPLOY_SQL)
def q_d00x_repo_flags(spark, d):
    from quaylight.operators import deploy

    files = planted.repositories(spark, d)
    walked, code = save(whole.walk(files, ["D"])), save(whole.relevant_lines(files, ["D"]))
    return deploy.scan(walked.where("reason is null"), code).select("repo_id", "rule_id", "file_path")


@query(planted.SECURITY_SQL)
def q_b00x_security(spark, d):
    from quaylight.operators import security

    f = planted.repositories(spark, d)
    return security.scan(save(whole.relevant_lines(f, ["B"])), save(security.config_lines(f))).select("repo_id", "rule_id", "file_path", "line_start")


@query(planted.LOCKS_SQL)
def q_node_lock_antijoin(spark, d):
    from quaylight.operators import deploy

    f = planted.repositories(spark, d)
    nothing = f.select("repo_id").distinct().select("repo_id", *[F.lit(False).alias(c) for c in ("rust_main", "mvn_script", "mvn_config", "gradle_script", "gradle_config")])
    return deploy.unlocked(deploy.manifests(f), nothing)


@query(planted.STAGES_SQL)
def q_docker_last_stage(spark, d):
    from quaylight.operators import deploy

    return deploy.dockerfiles(planted.repositories(spark, d)).select("repo_id", "file_path", F.nullif("base", F.lit("")).alias("base"), "has_start")


@query(planted.DOCS_SQL)
def q_c00x_documentation(spark, d):
    from quaylight.operators import docs

    walked = save(whole.walk(planted.repositories(spark, d), ["C"]))
    return docs.scan(walked.where("reason is null"), walked).select("repo_id", "rule_id", "file_path", "line_start")


@query(planted.README_SQL)
def q_primary_readme(spark, d):
    from quaylight.operators import docs

    return docs.primary_readmes(planted.repositories(spark, d)).select("repo_id", "file_path")


@query(planted.REQUIREMENTS_SQL)
def q_requirements_closure(spark, d):
    from quaylight.operators import docs

    return docs.facts(planted.repositories(spark, d)).where("fact like 'package:python:%'")


@query("WITH f AS (SELECT DISTINCT source AS repo_id, 'pkgs/' || source || (CASE WHEN doc_id % 2 = 0 THEN '' ELSE '/in' END) AS folder FROM documents) SELECT * FROM f WHERE regexp_matches(folder, '^pkgs/[^/]*$') AND folder <> 'pkgs/src3'")
def q_workspace_glob_join(spark, d):
    from quaylight.operators import docs

    tail = F.when(F.col("doc_id") % 2 == 0, "").otherwise("/in")
    folders = hosts.read(spark, d, "documents").select(F.col("source").alias("repo_id"), F.concat(F.lit("pkgs/"), F.col("source"), tail).alias("folder")).distinct()
    globs = folders.select("repo_id").distinct().select("repo_id", F.explode(F.array(F.lit("./pkgs/*"), F.lit("!pkgs/src3"))).alias("glob"))
    return docs.workspace_members(globs, folders)


def _archive(names: list[str]) -> bytes:
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = len(n)
            t.addfile(info, io.BytesIO(n.encode()))
    return out.getvalue()


@query(
    """WITH s AS (SELECT s_suppkey AS n FROM supplier),
    m AS (SELECT n, 0 AS member_no, 'x/y' || CAST(n AS VARCHAR) || '.py' AS name, NULL AS breach FROM s WHERE n % 4 <> 3
    UNION ALL SELECT n, 1, CASE n % 4 WHEN 0 THEN 'z' WHEN 1 THEN '../up' ELSE '/etc/x' END, CASE n % 4 WHEN 1 THEN 'name_parent' WHEN 2 THEN 'name_absolute' END FROM s WHERE n % 4 <> 3
    UNION ALL SELECT n, 0, NULL, 'broken' FROM s WHERE n % 4 = 3)
    SELECT CAST(n AS VARCHAR) AS repo_id, member_no, name, breach FROM m"""
)
def q_archive_members(spark, d):
    """An archive for each supplier; one of four has a name that leaves the folder, one an absolute one, one is no archive."""
    @F.pandas_udf("binary")
    def archive(keys: pd.Series) -> pd.Series:
        second = ["z", "../up", "/etc/x"]
        return keys.map(lambda n: b"neither" if n % 4 == 3 else _archive([f"x/y{n}.py", second[n % 4]]))

    made = hosts.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("repo_id"), archive(F.col("s_suppkey").cast("long")).alias("content"))
    return S.admitted(S.archive_members(made)).select("repo_id", F.col("member_no").cast("int").alias("member_no"), "name", "breach")


@query(EVENTS + " SELECT repo_id, count(*) AS findings FROM ev GROUP BY repo_id")
def q_report(spark, d):
    f = hosts.event_findings(spark, d).select("repo_id", "rule_id", "line_start")
    doc = views.report({"findings": f, "rules": f.select("repo_id", "rule_id").distinct()})
    return doc.select("repo_id", F.size(F.from_json("document", "findings array<struct<rule_id:string>>")["findings"]).cast("long").alias("findings"))


@query("SELECT event_id AS task_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2025-01-01 00:00:00' END AS created_at FROM events")
def q_upsert(spark, d):
    from quaylight.operators import tasks as t

    e = hosts.read(spark, d, "events").select(F.col("event_id").alias("task_id"))
    stamp = lambda y: F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz")
    old = e.where("task_id % 2 = 0").select("task_id", stamp(2024).alias("created_at"), stamp(2024).alias("updated_at"))
    new = e.select("task_id", F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return t.upsert(old, new, stamp(2025)).select("task_id", "created_at")




@query(
    EVENTS + _SUMMARY + _GROUPS + _CONDITIONS + """, lk AS (SELECT DISTINCT repo_id, action_code FROM co EXCEPT SELECT repo_id, action_code FROM gr),
    al2 AS (SELECT repo_id, action_code, finding_count, blocking FROM gr UNION ALL SELECT repo_id, action_code, 0, false FROM lk)
    SELECT repo_id, count(*) AS total_groups, CAST(sum(CASE WHEN blocking THEN 1 ELSE 0 END) AS BIGINT) AS blocking_groups,
    CASE WHEN bool_or(action_code IN ('MANUAL_REVIEW_REQUIRED', 'REVIEW_SCAN_COVERAGE', 'RESOLVE_SCAN_ERROR')) THEN 'partial' ELSE 'complete' END AS plan_status FROM al2 GROUP BY repo_id"""
)
def q_plan_summary(spark, d):
    from quaylight.operators import publish

    return publish.plan_summary(publish.plan(hosts.event_findings(spark, d), _summary(spark, d))).drop("verification")


@query(
    EVENTS + _GROUPS + """, nu2 AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY blocking DESC, priority, s, c, action_code, coalesce(kt, ''), coalesce(kr, ''), coalesce(ks, ''), coalesce(first_file, '')) AS n FROM gr),
    li AS (SELECT repo_id, 'RG' || lpad(CAST(n AS VARCHAR), 3, '0') AS group_id, '- [' || action_code || '] (' || CAST(finding_count AS VARCHAR) || ' findings)' AS line, n FROM nu2),
    room AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY repo_id ORDER BY n) AS used FROM li) SELECT repo_id, group_id, line FROM room WHERE used <= 65536"""
)
def q_prompt_lines(spark, d):
    from quaylight.operators import publish

    g = repair.ordered_groups(repair.groups(hosts.event_findings(spark, d))).withColumn("related_rule_ids", F.array().cast("array<string>"))
    return publish.prompt_lines(g)


_PLANNED = EVENTS + _SUMMARY + _GROUPS + _CONDITIONS + """, lk AS (SELECT DISTINCT repo_id, action_code FROM co EXCEPT SELECT repo_id, action_code FROM gr),
    al AS (SELECT repo_id, CAST(repo_id AS BIGINT) AS r, action_code, finding_count, blocking FROM gr UNION ALL SELECT repo_id, CAST(repo_id AS BIGINT), action_code, 0, false FROM lk),
    lost AS (SELECT *, r % 10 = 1 AND action_code = 'REVOKE_OR_ROTATE_SECRET' AS lost, r % 10 = 2 AND action_code = 'REVIEW_SECRET_USAGE' AS twice, r % 10 = 3 AND action_code = 'RERUN_SECURITY_SCAN' AS miscounted,
             r % 23 = 9 AND r % 9 <> 4 AS untyped FROM al)"""
_VIOLATIONS = {
    "schema_version": "r % 13 = 6",
    "status_column": "r % 5 = 1",
    "coverage_warning": "r % 31 = 11 AND partial",
    "trigger_in_complete": "trigger AND NOT partial",
    "cut_in_complete": "cut AND NOT partial",
    "cut_without_review": "cut AND NOT manual",
    "cut_without_scan": "cut AND NOT rerun",
    "partial_without_reason": "partial AND NOT trigger AND NOT cut",
    "total": "losses <> doubles",
    "blocking": "blocking_losses <> blocking_doubles",
    "total_column": "r % 29 = 3",
    "group_ids": "losses + doubles > 0",
    "prompt_characters": "r % 17 = 7",
    "prompt_content": "r % 19 = 8 AND r % 17 <> 7",
}


def _planned(spark, d):
    from quaylight.operators import publish

    g = save(publish.plan(hosts.event_findings(spark, d), _summary(spark, d)))
    # bodies are small when compressed, so Spark would give nearly all of them to one task to parse
    return g, spread(save(hosts.stored_plans(g, publish.plan_summary(g))), 10_000, "task_id")


@query(
    _PLANNED
    + """, s AS (
      SELECT repo_id, r, untyped, bool_or(action_code IN ('MANUAL_REVIEW_REQUIRED', 'REVIEW_SCAN_COVERAGE', 'RESOLVE_SCAN_ERROR')) AS trigger, bool_or(action_code = 'MANUAL_REVIEW_REQUIRED') AS manual,
             bool_or(action_code = 'RERUN_SECURITY_SCAN') AS rerun, r % 9 = 4 AS cut, count(*) FILTER (WHERE lost) AS losses, count(*) FILTER (WHERE twice) AS doubles,
             count(*) FILTER (WHERE lost AND blocking) AS blocking_losses, count(*) FILTER (WHERE twice AND blocking) AS blocking_doubles FROM lost GROUP BY repo_id, r, untyped
    ), t AS (SELECT *, trigger <> (r % 5 = 1) AS partial FROM s)
    SELECT repo_id AS task_id, 'typed' AS violation FROM t WHERE untyped """
    + " ".join(f"UNION ALL SELECT repo_id, '{k}' FROM t WHERE NOT untyped AND ({v})" for k, v in _VIOLATIONS.items())
)
def q_plan_violations(spark, d):
    from quaylight.operators import stored

    return stored.violations(stored.plan_facts(_planned(spark, d)[1]))


@query(
    _PLANNED
    + """ SELECT repo_id AS task_id, action_code, CAST(finding_count AS BIGINT) AS finding_count, blocking, 'made' AS side FROM lost WHERE NOT untyped AND (lost OR miscounted)
    UNION ALL SELECT repo_id, action_code, CAST(finding_count + CASE WHEN miscounted THEN 1 ELSE 0 END AS BIGINT), blocking, 'stored' FROM lost WHERE NOT untyped AND (twice OR miscounted)"""
)
def q_plan_differences(spark, d):
    """Stored plans against plans made anew, as multisets, both ways."""
    from quaylight.operators import stored

    g, plans = _planned(spark, d)
    facts = save(stored.plan_facts(plans).select("task_id", "typed", "p"))
    made = g.withColumnRenamed("repo_id", "task_id").join(facts.where("typed").select("task_id"), "task_id", "left_semi")
    columns = ["task_id", "action_code", "finding_count", "blocking"]
    return stored.differences(stored.stored_groups(facts).select(columns), made.select(columns))


@query(
    """SELECT event_id AS task_id, (['not_json', 'not_an_object', 'score', 'score', 'score', 'score_before_caps', 'verdict', 'verdict', 'score_breakdown', 'coverage', 'score_caps', 'lists', 'schema_version'])[event_id % 16 - 2] AS reason
    FROM events WHERE event_id % 16 >= 3"""
)
def q_rejected_assessments(spark, d):
    from quaylight.operators import stored

    return stored.rejected(stored.checked_assessments(hosts.stored_assessments(spark, d))).drop("body")


@query(
    """SELECT event_id AS task_id, event_id % 101 AS score, 'pass' AS verdict, (['GitHub Token', 'Given', 'X9'])[event_id % 16 + 1] AS rule_name, CAST(50 AS BIGINT) AS max_deduction, event_id % 7 AS deduction,
    'complete' AS status, CAST(0 AS BIGINT) AS total_findings FROM events WHERE event_id % 16 < 3"""
)
def q_accepted_assessments(spark, d):
    """Three versions of stored assessments under today's names."""
    from quaylight.operators import stored

    read = stored.accepted(stored.checked_assessments(hosts.stored_assessments(spark, d)))
    first = F.col("score_breakdown")[0]
    return read.select("task_id", "score", "verdict", first["rule_name"].alias("rule_name"), first["max_deduction"].alias("max_deduction"), first["deduction"].alias("deduction"), "coverage.status", "coverage.total_findings")


_PATHS = ["a/b", "./a//b", "a\\b", "../x", "/etc/x", "~/x", "./~/x", "C:/x", "a`b", "a/./b/"]


@query("SELECT doc_id, (['a/b','a/b','a/b','<redacted-path>','<redacted-path>','<redacted-path>','<redacted-path>','<redacted-path>','<redacted-path>','a/b'])[(doc_id % 10) + 1] AS shown FROM documents")
def q_shown_path(spark, d):
    from quaylight.operators import publish

    return hosts.read(spark, d, "documents").select("doc_id", publish.shown_path(F.get(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % 10).cast("int"))).alias("shown"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'REPOSITORY_NOT_FOUND' WHEN 1 THEN 'PRIVATE_REPOSITORY' WHEN 2 THEN 'GITHUB_RATE_LIMITED' WHEN 3 THEN 'DOWNLOAD_TOO_LARGE' ELSE 'DOWNLOAD_FAILED' END AS code, 'see ' || (CASE WHEN event_id % 2 = 0 THEN '<redacted-path> now' ELSE 'https://h/tmp now' END) AS said FROM events")
def q_error_codes(spark, d):
    from quaylight.operators import publish

    e = hosts.read(spark, d, "events")
    m = F.get(F.array(*map(F.lit, ["Repo Not Found", "is private", "HTTP 429", "content-length over", "reset"])), (F.col("event_id") % 5).cast("int"))
    said = F.when(F.col("event_id") % 2 == 0, "see /var/tmp/t1/x now").otherwise("see https://h/tmp now")
    return e.select("event_id", publish.error_code(m).alias("code"), publish.without_paths(said).alias("said"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN '422' WHEN 1 THEN '404' WHEN 2 THEN '409' WHEN 3 THEN 'empty' WHEN 4 THEN 'result' ELSE 'missing' END AS answer FROM events")
def q_state_guards(spark, d):
    from quaylight.operators import publish

    k = F.col("event_id") % 6
    task = F.when(k == 0, "no-uuid").otherwise("00000000-0000-4000-8000-00000000000A")
    status = F.get(F.array(*map(F.lit, ["completed", None, "running", "failed", "completed", "completed"])), k.cast("int"))
    return hosts.read(spark, d, "events").select("event_id", publish.answer_of(task, status, k == 4).alias("answer"))


@query(EVENTS + " SELECT repo_id, count(*) AS rows, false AS too_large FROM ev GROUP BY repo_id")
def q_result_document(spark, d):
    from quaylight.operators import publish

    doc = publish.document(resolve.truncate_findings(resolve.number_findings(hosts.event_findings(spark, d))).drop("out_position"), "scan")
    return doc.select("repo_id", F.size(F.from_json("body", "array<struct<rule_id:string>>")).cast("long").alias("rows"), "too_large")


@query("SELECT event_id AS task_id FROM events WHERE event_id % 3 <> 0")
def q_stale_plans(spark, d):
    from quaylight.operators import publish

    e = hosts.read(spark, d, "events")
    plans = e.select(F.col("event_id").alias("task_id"), F.lit("t1").alias("source_scan_updated_at"))
    scans = e.where("event_id % 3 <> 1").select(F.col("event_id").alias("task_id"), F.when(F.col("event_id") % 3 == 0, "t1").otherwise("t2").alias("updated_at"))
    return publish.stale_plans(plans, scans).select("task_id")
