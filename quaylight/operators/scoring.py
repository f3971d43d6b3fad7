"""Scores from findings: damped and capped deductions per rule, score caps, verdict, coverage, blocking reasons. Integers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import vocabulary as V


def canonical_order() -> list[Column]:
    """One order whatever order findings come in; nulls count as 0 and as empty."""
    texts = ["rule_id", "rule_name", "category", "finding_type", "secret_type", "description", "message", "repair_template_key", "snippet_masked"]
    places = [F.coalesce(c, F.lit(0)) for c in ("line_start", "line_end", "column_start", "column_end")]
    return [F.when(F.col("is_blocking"), 0).otherwise(1), V.severity_rank(), V.confidence_rank(), F.coalesce("file_path", F.lit("")), *places, *[F.coalesce(c, F.lit("")) for c in texts]]


def repeat_percent(n: Column) -> Column:
    """Of the n-th finding of a rule, from 1."""
    out = F.when(n <= 1, V.REPEAT_PERCENT[0])
    for k, p in enumerate(V.REPEAT_PERCENT[1:-1], 2):
        out = out.when(n == k, p)
    return out.otherwise(V.REPEAT_PERCENT[-1])


def deduction(severity: Column, confidence: Column, blocking: Column, n: Column) -> Column:
    """Points lost by one finding, rounded half up in integers."""
    percent = F.when(blocking, 100).otherwise(V.choose(confidence, V.CONFIDENCE_PERCENT, 0))
    return F.floor((V.choose(severity, V.BASE_POINTS, 0) * percent * repeat_percent(n) + 5000) / F.lit(10000)).cast("long")


def rule_deductions(findings: DataFrame) -> DataFrame:
    """A row for each (repo_id, rule_id): finding_count, severity (highest), deductions in canonical order, their sum, cap and what applies."""
    n = F.row_number().over(Window.partitionBy("repo_id", "rule_id").orderBy(*canonical_order()))
    one = findings.withColumn("_n", n).withColumn("_d", deduction(F.col("severity"), F.col("confidence"), F.col("is_blocking"), F.col("_n")))
    out = one.groupBy("repo_id", "rule_id").agg(
        F.count("*").alias("finding_count"),
        F.min_by("severity", V.severity_rank()).alias("severity"),
        F.sum("_d").alias("deduction_before_rule_cap"),
    )
    return out.withColumn("rule_cap", V.choose(F.col("severity"), V.RULE_CAP, 0).cast("long")).withColumn("applied_deduction", F.least("deduction_before_rule_cap", "rule_cap"))


def occurrence_deductions(findings: DataFrame, most: int = 1000) -> DataFrame:
    """(repo_id, rule_id, occurrence_deductions): each finding's points in order, of results already cut to `most` findings."""
    n = F.row_number().over(Window.partitionBy("repo_id", "rule_id").orderBy(*canonical_order()))
    one = findings.withColumn("_n", n).where(F.col("_n") <= most).withColumn("_d", deduction(F.col("severity"), F.col("confidence"), F.col("is_blocking"), F.col("_n")))
    return one.groupBy("repo_id", "rule_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_d"))), lambda x: x["_d"]).alias("occurrence_deductions"))


def base_scores(deductions: DataFrame, repositories: DataFrame) -> DataFrame:
    """repo_id, score_before_caps for each of the repositories."""
    lost = deductions.groupBy("repo_id").agg(F.sum("applied_deduction").alias("_lost"))
    return repositories.select("repo_id").join(lost, "repo_id", "left").select("repo_id", F.greatest(F.lit(100) - F.coalesce("_lost", F.lit(0)), F.lit(0)).cast("long").alias("score_before_caps"))


def cap_triggers() -> dict[str, Column]:
    return {
        "BLOCKING_FINDING": F.col("blocking_findings") > 0,
        "FINDINGS_TRUNCATED": F.col("findings_truncated"),
        "NO_FILES_SCANNED": F.col("total_files_scanned") == 0,
        "SCAN_ERRORS": F.col("total_scan_errors") > 0,
    }


def score_caps(scores: DataFrame, summary: DataFrame) -> DataFrame:
    """A row for each triggered cap: reason_code, cap_value, score before and after it, applied; by value, then code."""
    on = cap_triggers()
    codes = F.array_compact(F.array(*[F.when(on[code], F.struct(F.lit(value).cast("long").alias("cap_value"), F.lit(code).alias("reason_code"))) for code, value in V.SCORE_CAPS]))
    each = scores.join(summary, "repo_id").select("repo_id", "score_before_caps", F.explode(codes).alias("c")).select("repo_id", "score_before_caps", "c.*")
    w = Window.partitionBy("repo_id").orderBy("cap_value", "reason_code").rowsBetween(Window.unboundedPreceding, -1)
    before = F.least("score_before_caps", F.coalesce(F.min("cap_value").over(w), F.col("score_before_caps")))
    out = each.withColumn("score_before_cap", before).withColumn("score_after_cap", F.least("score_before_cap", "cap_value"))
    return out.select("repo_id", "reason_code", "cap_value", "score_before_cap", "score_after_cap", (F.col("score_after_cap") < F.col("score_before_cap")).alias("applied"))


def final_score() -> Column:
    on = cap_triggers()
    return F.least(F.col("score_before_caps"), *[F.when(on[code], F.lit(value)).otherwise(F.lit(100)).cast("long") for code, value in V.SCORE_CAPS])


def verdict_of(score: Column, blocking: Column) -> Column:
    return F.when((blocking > 0) | (score <= V.BLOCKED_TO), "blocked").when(score <= V.WARNING_TO, "warning").otherwise("pass")


def assess(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """A row for each repository of a summary: score_before_caps, score, verdict, coverage and why it is partial."""
    own = findings.where(F.coalesce("dimension", F.lit(V.SENSITIVE)) == V.SENSITIVE)
    base = base_scores(rule_deductions(own), summary)
    joined = base.join(summary, "repo_id").withColumn("score", final_score())
    on = cap_triggers()
    why = F.array_compact(F.array(*[F.when(on[c], c) for c in ("FINDINGS_TRUNCATED", "NO_FILES_SCANNED", "SCAN_ERRORS")]))
    return joined.select("repo_id", "score_before_caps", "score", verdict_of(F.col("score"), F.col("blocking_findings")).alias("verdict"), F.when(F.size(why) > 0, "partial").otherwise("complete").alias("coverage_status"), why.alias("coverage_reasons"))


def blocking_reasons(findings: DataFrame, most: int = V.MAX_BLOCKING_REASONS) -> DataFrame:
    """The first blocking findings of each repository in canonical order, with their line."""
    n = F.row_number().over(Window.partitionBy("repo_id").orderBy(*canonical_order()))
    return findings.where("is_blocking").withColumn("position", n.cast("long")).where(F.col("position") <= most).select("repo_id", "position", "rule_id", "rule_name", "severity", "file_path", "line_start", "description")
