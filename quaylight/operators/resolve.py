"""From findings to a result: the riskiest per rule and file, overlaps, order, limits of a result, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import vocabulary as V


def risk_order() -> list[Column]:
    """Riskiest first: blocking, severity, confidence, then earlier places."""
    return [F.desc("is_blocking"), V.severity_rank(), V.confidence_rank(), F.coalesce("line_start", F.lit(0)), F.coalesce("column_start", F.lit(0))]


def top_per_rule_and_file(findings: DataFrame, k: int = V.FINDINGS_PER_RULE_FILE) -> DataFrame:
    """At most k (at least 1) findings of a rule in a file, the riskiest."""
    w = Window.partitionBy("repo_id", "file_path", "rule_id").orderBy(*risk_order())
    return findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(1, k)).drop("_n")


def priority_of(rule_id: str = "rule_id", none: int = 999) -> Column:
    return V.choose(F.col(rule_id), {r[0]: r[6] for r in V.RULES if r[6] is not None}, none)


def drop_overlaps(findings: DataFrame) -> DataFrame:
    """Of findings that overlap in columns on a line of a file, that of the first rule by priority stays.

    Greedy in the order of priority: a finding that fell doesn't push out others. Findings of kind file, and those
    without columns, stay. A line's findings are bounded by the limit for each rule. The findings are read once.
    """
    placed = (F.col("finding_type") == "content") & F.col("line_start").isNotNull()
    row = F.struct(*V.FINDING_COLUMNS)
    item = F.struct(priority_of().alias("p"), F.coalesce("column_start", F.lit(-1)).alias("s"), F.col("rule_id").alias("r"), F.coalesce("column_end", F.lit(-1)).alias("e"), row.alias("row"))
    lines = findings.groupBy("repo_id", "file_path", "line_start", placed.alias("placed")).agg(F.collect_list(item).alias("items"))

    def step(kept: Column, x: Column) -> Column:
        y = lambda k: x["row"]["column_start"].isNotNull() & (x["row"]["column_start"] < k["row"]["column_end"]) & (k["row"]["column_start"] < x["row"]["column_end"])
        return F.when(F.coalesce(F.exists(kept, y), F.lit(False)), kept).otherwise(F.concat(kept, F.array(x)))

    one = F.size("items") == 1
    kept = F.when(one | ~F.col("placed"), F.col("items")).otherwise(F.aggregate(F.sort_array("items"), F.slice("items", 1, 0), step))
    return lines.select(F.explode(kept).alias("k")).select("k.row.*")


def place_order() -> list[Column]:
    """The order of a result: path, line, column (none: before the first), priority, rule."""
    return [F.col("file_path"), F.coalesce("line_start", F.lit(-1)), F.coalesce("column_start", F.lit(-1)), priority_of(), F.col("rule_id")]


def number_findings(findings: DataFrame) -> DataFrame:
    """Adds position from 0 in the order of a repository's result."""
    return findings.withColumn("position", F.row_number().over(Window.partitionBy("repo_id").orderBy(*place_order(), "line_end", "column_end", "snippet_masked")).cast("long") - 1)


def truncate_findings(numbered: DataFrame, limit: int = V.MAX_FINDINGS) -> DataFrame:
    """Kept findings and out_position. Beyond the limit the riskiest stay, sensitive data first, in that order; else all in theirs."""
    w = Window.partitionBy("repo_id")
    risk = w.orderBy(F.desc("is_blocking"), F.when(F.col("dimension") == V.SENSITIVE, 0).otherwise(1), V.severity_rank(), V.confidence_rank(), "position")
    many = F.count("*").over(w) > max(1, limit)
    ranked = numbered.withColumn("_r", F.row_number().over(risk).cast("long") - 1).withColumn("out_position", F.when(many, F.col("_r")).otherwise(F.col("position")))
    return ranked.where(F.col("out_position") < max(1, limit)).drop("_r")


def truncate_rows(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    w = Window.partitionBy("repo_id").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(1, limit)).drop("_n")


def summarize(findings: DataFrame, others: DataFrame, limit: int = V.MAX_FINDINGS) -> DataFrame:
    """A row for each of others (repo_id, total_notices, total_skipped_files, total_scan_errors, total_files_scanned, total_lines_scanned).

    Totals are of all findings; returned and truncated of what a result keeps. dimension_counts has all five keys.
    """
    counted = findings.groupBy("repo_id").agg(F.count("*").alias("total_findings"), F.count_if("is_blocking").alias("blocking_findings"), *[F.count_if(F.coalesce("dimension", F.lit(V.SENSITIVE)) == d).alias(f"_{d}") for d in V.DIMENSIONS])
    out = others.join(counted, "repo_id", "left").fillna(0, ["total_findings", "blocking_findings", *[f"_{d}" for d in V.DIMENSIONS]])
    for total, name, most in (("total_findings", "findings", limit), ("total_notices", "notices", V.MAX_NOTICES), ("total_skipped_files", "skipped_files", V.MAX_SKIPPED), ("total_scan_errors", "scan_errors", V.MAX_ERRORS)):
        out = out.withColumn(f"returned_{name}", F.least(F.col(total), F.lit(most)).cast("long")).withColumn(f"{name}_truncated", F.col(total) > most)
    counts = F.create_map(*[x for d in V.DIMENSIONS for x in (F.lit(d), F.col(f"_{d}"))])
    return out.withColumn("dimension_counts", counts).drop(*[f"_{d}" for d in V.DIMENSIONS])


def sensitive_summary(summary: DataFrame) -> DataFrame:
    """The summary as scoring sees it: total_findings of sensitive data only; blocking_findings stays."""
    total = F.coalesce(F.element_at("dimension_counts", F.lit(V.SENSITIVE)), F.lit(0))
    return summary.withColumn("findings_truncated", total > F.col("returned_findings")).withColumn("total_findings", total)
