"""Repair plans: findings times actions, grouped, ordered and bounded; fallback texts; candidates for explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import vocabulary as V


def action_pairs(findings: DataFrame) -> DataFrame:
    """Findings times the actions they ask for. Blocking ones ask for the first nine, others for their template's; no template, none."""
    spark = findings.sparkSession
    acts = F.broadcast(V.actions(spark))  # twelve rows
    first = findings.where("is_blocking").withColumn("action_code", F.explode(F.array(*[F.lit(a[0]) for a in V.ACTIONS if a[2]])))
    other = findings.where("not is_blocking").join(F.broadcast(V.template_actions(spark)), F.col("repair_template_key") == F.col("template")).drop("template")
    return first.unionByName(other).join(acts, "action_code")


def needs_review(findings: DataFrame) -> DataFrame:
    """Adds mismatch: an unknown rule, or a template that is missing, unknown or not the rule's."""
    allowed = F.broadcast(V.allowed_templates(findings.sparkSession).select("rule", "template", F.lit(True).alias("_fits")))
    return findings.join(allowed, (F.col("rule_id") == F.col("rule")) & (F.col("repair_template_key") == F.col("template")), "left").withColumn("mismatch", F.col("_fits").isNull()).drop("rule", "template", "_fits")


#: Conditions and the actions that a plan then must have, each with a repeated scan. All but blocking make it partial.
CONDITIONS = {
    "BLOCKING_FINDINGS": ["VERIFY_NO_SECRET_REMAINS"],
    "FINDINGS_TRUNCATED": ["REVIEW_SCAN_COVERAGE"],
    "SCAN_ERRORS": ["RESOLVE_SCAN_ERROR", "REVIEW_SCAN_COVERAGE"],
    "NO_FILES_SCANNED": ["REVIEW_SCAN_COVERAGE"],
    "BLOCKING_MISSING": ["REVIEW_SCAN_COVERAGE"],
    "RULE_TEMPLATE_MISMATCH": ["MANUAL_REVIEW_REQUIRED"],
}


def partial_conditions(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """(repo_id, condition, action_code) for each condition that holds; findings are those that a result kept."""
    seen = needs_review(findings).groupBy("repo_id").agg(F.bool_or("mismatch").alias("_bad"), F.count_if("is_blocking").alias("_blocking"))
    s = summary.join(seen, "repo_id", "left").fillna(0, ["_blocking"]).fillna(False, ["_bad"])
    holds = {
        "BLOCKING_FINDINGS": F.col("_blocking") > 0, "FINDINGS_TRUNCATED": F.col("findings_truncated"), "SCAN_ERRORS": F.col("total_scan_errors") > 0,
        "NO_FILES_SCANNED": F.col("total_files_scanned") == 0, "BLOCKING_MISSING": F.col("blocking_findings") > F.col("_blocking"), "RULE_TEMPLATE_MISMATCH": F.col("_bad"),
    }
    pairs = [F.when(holds[c], F.struct(F.lit(c).alias("condition"), F.lit(a).alias("action_code"))) for c, acts in CONDITIONS.items() for a in [*acts, "RERUN_SECURITY_SCAN"]]
    return s.select("repo_id", F.explode(F.array_compact(F.array(*pairs))).alias("x")).select("repo_id", "x.*")


def groups(findings: DataFrame) -> DataFrame:
    """Repair groups: by action, template, rule, secret type and blocking; actions that a plan has once by action alone.

    Each has its count of findings, gravest severity and confidence, the rules, and the number of its files.
    """
    p = action_pairs(findings)
    once = F.col("singleton")
    key = {c: F.when(~once, F.col(c)) for c in ("repair_template_key", "rule_id", "secret_type")} | {"_blocking": F.when(~once, F.col("is_blocking"))}
    named = p.select("repo_id", "action_code", "priority", "singleton", *[v.alias(f"k_{k}") for k, v in key.items()], "rule_id", "file_path", "severity", "confidence", "is_blocking")
    out = named.groupBy("repo_id", "action_code", "priority", "singleton", *[f"k_{k}" for k in key]).agg(
        F.count("*").alias("finding_count"),
        F.bool_or("is_blocking").alias("blocking"),
        F.min(V.severity_rank()).alias("_s"),
        F.min(V.confidence_rank()).alias("_c"),
        F.array_sort(F.collect_set("rule_id")).alias("related_rule_ids"),
        F.countDistinct("file_path").alias("total_related_files"),
        F.min("file_path").alias("first_file"),
    )
    back = lambda c, names: F.get(F.array(*map(F.lit, names)), c)
    return out.withColumn("highest_severity", F.coalesce(back(F.col("_s"), V.SEVERITIES), F.lit("info"))).withColumn("highest_confidence", F.coalesce(back(F.col("_c"), V.CONFIDENCES), F.lit("low"))).drop("k__blocking")


def ordered_groups(made: DataFrame, most: int = V.MAX_GROUPS) -> DataFrame:
    """Adds group_id RG001... in the plan's order; beyond `most` groups, those of actions a plan has once stay before others."""
    order = [F.desc("blocking"), "priority", "_s", "_c", "action_code", F.coalesce("k_repair_template_key", F.lit("")), F.coalesce("k_rule_id", F.lit("")), F.coalesce("k_secret_type", F.lit("")), F.coalesce("first_file", F.lit(""))]
    first = Window.partitionBy("repo_id").orderBy(F.desc("singleton"), *order)
    kept = made.withColumn("_keep", F.row_number().over(first)).where(F.col("_keep") <= most).drop("_keep")
    n = F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))
    return kept.withColumn("group_id", F.format_string("RG%03d", n))


def related_files(findings: DataFrame, most: int = V.MAX_RELATED_FILES) -> DataFrame:
    """(repo_id, action_code, rule_id, file_path, place): each file of a regular group once, by its gravest finding, first `most`."""
    p = action_pairs(findings).where("not singleton").groupBy("repo_id", "action_code", "rule_id", "file_path").agg(F.min(F.struct(V.severity_rank().alias("s"), V.confidence_rank().alias("c"))).alias("g"))
    n = F.row_number().over(Window.partitionBy("repo_id", "action_code", "rule_id").orderBy("g.s", "g.c", "file_path"))
    return p.withColumn("place", n.cast("long")).where(F.col("place") <= most).drop("g")


def explanation_candidates(numbered: DataFrame, most: int = V.MAX_LLM_ITEMS, exclude_blocking: bool = False) -> DataFrame:
    """Findings that may be explained by a model: none of R001 to R005, the gravest first, stable, at most `most`."""
    some = numbered.where(~F.col("rule_id").rlike("^R00[1-5]_"))
    some = some.where("not is_blocking") if exclude_blocking else some
    n = F.row_number().over(Window.partitionBy("repo_id").orderBy(V.severity_rank(), "position"))
    return some.withColumn("item", n.cast("long")).where(F.col("item") <= most)


def with_fallback(candidates: DataFrame, texts: DataFrame, generic: tuple[str, str]) -> DataFrame:
    """explanation and instruction by rule from texts (rule, explanation, instruction), else the generic ones."""
    joined = candidates.join(F.broadcast(texts), F.col("rule_id") == F.col("rule"), "left").drop("rule")  # a row for each known rule
    return joined.withColumn("explanation", F.coalesce("explanation", F.lit(generic[0]))).withColumn("instruction", F.coalesce("instruction", F.lit(generic[1]))).withColumn("source", F.lit("fallback"))


def analysis_totals(items: DataFrame) -> DataFrame:
    """repo_id, total_analyzed, total_llm, total_fallback, source (llm, fallback or mixed)."""
    llm = F.count_if(F.col("source") == "llm")
    out = items.groupBy("repo_id").agg(F.count("*").alias("total_analyzed"), llm.alias("total_llm"), F.count_if(F.col("source") == "fallback").alias("total_fallback"))
    return out.withColumn("source", F.when(F.col("total_llm") == 0, "fallback").when(F.col("total_fallback") == 0, "llm").otherwise("mixed"))


def parsed_answer(text: Column) -> Column:
    """struct<explanation, instruction> of a model's JSON answer, fenced or not, cut to size; null if it isn't one or a part is blank."""
    from quaylight.functions.text import mask_text

    body = F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    got = F.from_json(body, "explanation string, instruction string")
    whole = (F.trim(got["explanation"]) != "") & (F.trim(got["instruction"]) != "")
    return F.when(whole, F.struct(mask_text(F.left(got["explanation"], F.lit(2000))).alias("explanation"), mask_text(F.left(got["instruction"], F.lit(3000))).alias("instruction")))
