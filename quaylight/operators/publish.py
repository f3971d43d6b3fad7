"""What leaves the engine: safe texts and paths, documents of results, plans with their mandatory groups, and checks of stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import vocabulary as V
from quaylight.functions.text import mask_text
from quaylight.operators import repair

REDACTED_PATH = "<redacted-path>"
# What no text may hold; how long results may be; what makes a plan partial.
HIDDEN = "[\\p{Cc}\\p{Cf}\\p{Zl}\\p{Zp}]"
MAX_BYTES = {"scan": 8 << 20, "assessment": 2 << 20, "repair": 2 << 20, "analysis": 4 << 20}
PARTIAL_ACTIONS = ["MANUAL_REVIEW_REQUIRED", "REVIEW_SCAN_COVERAGE", "RESOLVE_SCAN_ERROR"]
MAX_PROMPT_CHARS = 65_536


def without_paths(text: Column | str) -> Column:
    """Absolute paths of all kinds become <redacted-path>; addresses with a scheme stay."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(t, r"""(?<=^|[\s\[({<"'])(?:/[A-Za-z][^\s"'<>]*|[A-Za-z]:[/\\][^\s"'<>]*|\\\\[^\s"'<>]*|//[^\s"'<>]*)""", REDACTED_PATH)


def shown_path(path: Column | str) -> Column:
    """A relative path in one spelling, masked; <redacted-path> for what leaves the repository, hides characters or ends a code span. Once is enough."""
    p = mask_text(path)
    slashed = F.replace(p, F.lit("\\"), F.lit("/"))
    plain = F.array_join(F.filter(F.split(slashed, "/"), lambda s: ~s.isin("", ".")), "/")
    bad = lambda c: c.rlike(r"^(/|~|[A-Za-z]:)")
    unsafe = p.rlike(HIDDEN) | p.contains("`") | F.array_contains(F.split(slashed, "/"), "..") | bad(slashed) | bad(plain)
    return F.when(p == REDACTED_PATH, p).when(unsafe, REDACTED_PATH).otherwise(plain)


def shown_rule(rule_id: Column | str) -> Column:
    r = F.col(rule_id) if isinstance(rule_id, str) else rule_id
    return F.when(r.isin([x[0] for x in V.RULES if x[0][0] == "R"]), r).otherwise("<unknown-rule>")


# Words of an error, and its code.
DOWNLOAD_ERRORS = [(["not found", "does not exist"], "REPOSITORY_NOT_FOUND"), (["private"], "PRIVATE_REPOSITORY"), (["rate limit", "429", "403"], "GITHUB_RATE_LIMITED"), (["too large", "content-length", "streaming"], "DOWNLOAD_TOO_LARGE")]
EXTRACTION_ERRORS = [(["too large", "exceeds limit", "too many files"], "EXTRACTION_LIMIT_EXCEEDED")]


def error_code(message: Column | str, table: list[tuple[list[str], str]] = DOWNLOAD_ERRORS, other: str = "DOWNLOAD_FAILED") -> Column:
    low = F.lower(F.col(message) if isinstance(message, str) else message)
    out = None
    for words, code in table:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(other)


def answer_of(task_id: Column, status: Column, has_result: Column) -> Column:
    """What a read of a task's result gets: 422 for no UUID, 404 for no task, 409 before the end, empty for a failed one, result, or missing."""
    uuid = F.lower(task_id).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(~uuid, "422").when(status.isNull(), "404").when(status.isin("pending", "running"), "409").when(status == "failed", "empty").when(has_result, "result").otherwise("missing")


def document(rows: DataFrame, kind: str) -> DataFrame:
    """(repo_id, body, too_large): rows of each repository, already cut to the limits of a result, as one JSON list in their order of `position`."""
    item = F.struct("position", F.struct(*[c for c in rows.columns if c not in ("repo_id", "position")]).alias("row"))
    body = F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["row"]))
    return rows.groupBy("repo_id").agg(body.alias("body")).withColumn("too_large", F.octet_length("body") > MAX_BYTES[kind])


def stale_plans(plans: DataFrame, scans: DataFrame) -> DataFrame:
    """Plans (task_id, source_scan_updated_at) made of another version of their scan (task_id, updated_at), or of none."""
    s = scans.select(F.col("task_id").alias("_t"), F.col("updated_at").alias("_u"))
    return plans.join(s, F.col("task_id") == F.col("_t"), "left").where(F.col("_u").isNull() | (F.col("_u") != F.col("source_scan_updated_at"))).drop("_t", "_u")


def plan(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """The groups of each repository's plan with ids; mandatory actions that no finding asks for have a group without findings."""
    made = repair.groups(findings)
    must = repair.partial_conditions(findings, summary).select("repo_id", "action_code").distinct()
    lack = must.join(made.select("repo_id", "action_code").distinct(), ["repo_id", "action_code"], "left_anti").join(F.broadcast(V.actions(findings.sparkSession)), "action_code")
    given = {
        "finding_count": F.lit(0).cast("long"), "blocking": F.lit(False), "_s": F.lit(len(V.SEVERITIES) - 1), "_c": F.lit(len(V.CONFIDENCES) - 1), "related_rule_ids": F.array().cast("array<string>"),
        "total_related_files": F.lit(0).cast("long"), "highest_severity": F.lit("info"), "highest_confidence": F.lit("low"),
    }
    empty = lack.select(*[given[c].alias(c) if c in given else F.col(c) if c in lack.columns else F.lit(None).cast(made.schema[c].dataType).alias(c) for c in made.columns])
    return repair.ordered_groups(made.unionByName(empty))


def plan_summary(groups: DataFrame) -> DataFrame:
    """repo_id, plan_status, total_groups, blocking_groups, and what is to be verified at the end, in order."""
    out = groups.groupBy("repo_id").agg(F.count("*").alias("total_groups"), F.count_if("blocking").alias("blocking_groups"), F.bool_or(F.col("action_code").isin(PARTIAL_ACTIONS)).alias("_partial"))
    steps = F.array_compact(F.array(F.when(F.col("blocking_groups") > 0, "blocking_fixed"), F.when(F.col("blocking_groups") > 0, "secrets_replaced"), F.lit("tests_run"), F.when(F.col("_partial"), "coverage_reviewed"), F.lit("scan_repeated")))
    return out.withColumn("plan_status", F.when(F.col("_partial"), "partial").otherwise("complete")).withColumn("verification", steps).drop("_partial")


def prompt_lines(groups: DataFrame, room: int = MAX_PROMPT_CHARS) -> DataFrame:
    """(repo_id, group_id, line): a line for each group in order, up to the first that no longer fits; later ones aren't tried."""
    rules = F.array_join(F.slice("related_rule_ids", 1, 10), ", ")
    line = F.concat_ws(" ", F.concat(F.lit("- ["), F.col("action_code"), F.lit("]")), F.when(F.col("finding_count") > 0, F.concat(F.lit("("), F.col("finding_count").cast("string"), F.lit(" findings)"))), F.when(rules != "", F.concat(F.lit("rules: "), rules)))
    w = Window.partitionBy("repo_id").orderBy("group_id").rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumn("line", line).withColumn("_sum", F.sum(F.length("line") + 1).over(w)).where(F.col("_sum") <= room).select("repo_id", "group_id", "line")
