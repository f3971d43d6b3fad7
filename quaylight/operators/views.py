"""The read side: filters, pages, explanations beside findings, and the exported document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filtered(findings: DataFrame, dimension: str | None = None, severity: str | None = None, text: str = "") -> DataFrame:
    """By dimension, severity, and text in the path or the rule's name, whatever its case."""
    out = findings if dimension is None else findings.where(F.col("dimension") == dimension)
    out = out if severity is None else out.where(F.col("severity") == severity)
    t = F.lit(text.lower())
    return out.where(F.lower("file_path").contains(t) | F.lower("rule_name").contains(t)) if text else out


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """A page of each repository's rows; numbers below 1 and beyond the last are drawn to the nearest."""
    w = Window.partitionBy("repo_id")
    n = F.row_number().over(w.orderBy(*order))
    pages = F.greatest(F.ceil(F.count("*").over(w) / size), F.lit(1))
    at = F.least(F.lit(max(1, number)), pages)
    return rows.withColumn("_n", n).withColumn("_p", at).where((F.col("_n") > (F.col("_p") - 1) * size) & (F.col("_n") <= F.col("_p") * size)).withColumn("page", F.col("_p").cast("long")).drop("_n", "_p")


def with_analysis(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Each finding (repo_id, position, ...) with its best item (item, path, line, rule, explanation): same line first, then same file.

    A path matches if it is the other's end. Both sides meet by repository, rule and file name.
    """
    name = lambda c: F.substring_index(c, "/", -1)
    i = items.select(F.col("repo_id").alias("_r"), F.col("rule_id").alias("_rule"), F.col("file_path").alias("_path"), F.col("line_start").alias("_line"), "item", "explanation").withColumn("_name", name("_path"))
    same = (F.col("repo_id") == F.col("_r")) & (F.col("rule_id") == F.col("_rule")) & (name("file_path") == F.col("_name"))
    pairs = findings.join(i, same, "left")
    fits = F.col("file_path").endswith(F.col("_path")) | F.col("_path").endswith(F.col("file_path"))
    rank = F.when(fits & (F.col("_line") == F.col("line_start")), 0).when(fits, 1).otherwise(2)
    n = F.row_number().over(Window.partitionBy("repo_id", "position").orderBy("_k", "item"))
    out = pairs.withColumn("_k", rank).withColumn("_n", n).where("_n = 1")
    return out.withColumn("explanation", F.when(F.col("_k") < 2, F.col("explanation"))).drop("_r", "_rule", "_path", "_line", "_name", "item", "_k", "_n")


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """(repo_id, document): a JSON document of each repository with a list for each table."""
    out = None
    for name, t in tables.items():
        one = t.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in t.columns if c != "repo_id"]))).alias(name))
        out = one if out is None else out.join(one, "repo_id", "full")
    return out.select("repo_id", F.to_json(F.struct(*tables)).alias("document"))
