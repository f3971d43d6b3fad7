"""Whole repositories in two readings of their texts: what the rules of all five dimensions need is kept, small, and they read that.

The first reading gives a row for each file: why it is skipped, how many lines it has, its text if its name says that some rule
reads it as a whole, and the few lines in which a secret or an open configuration can be. The second lexes source files
that hold a word of some rule and keeps the lines that some rule needs. Everything after it reads these two tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight import vocabulary as V
from quaylight.functions.text import has_any, once
from quaylight.operators import deploy, docs, incomplete, lexer, resolve, secrets, security
from quaylight.sources import files as S
from quaylight.storage import discard, save

#: A pattern that no text matches.
NEVER = r"[^\x00-\x{10ffff}]"
_LINE = "array<struct<line_no: bigint, line: string>>"


def _some_lines(lines: Column, keep) -> Column:
    numbered = F.transform(lines, lambda line, i: F.when(keep(line), F.struct((i + 1).cast("long").alias("line_no"), line.alias("line"))))
    return F.array_compact(numbered)


def chosen(rules: list[str] | None) -> set[str]:
    """The ids of rules given by their beginnings ("R", "I001", a whole id); all for None. An unknown one is an error."""
    every = [r[0] for r in V.RULES]
    out = {r for r in every if rules is None or r.startswith(tuple(rules))}
    if unknown := [x for x in rules or [] if not any(r.startswith(x) for r in every)]:
        raise ValueError(f"no such rules: {unknown}")
    return out


def _some(rules: set[str], letters: str) -> bool:
    return any(r[0] in letters for r in rules)


def walk(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(repo_id, file_path, length, reason, n_lines, content, suspects, configs), a row a file; content only of files that are read whole.

    suspects and configs are the lines that secrets.worth_a_look() and security.config_lines() take; a file without any isn't cut into lines.
    What none of the rules reads is null and costs nothing.
    """
    use = chosen(rules)
    text = F.col("content").cast("string")
    good = F.col("reason").isNull()
    config = S.suffix().isin(security.CONFIG_SUFFIXES) & ~S.in_folders("file_path", lexer.EXCLUDED_FOLDERS, lower=True)
    open_to_all = once(F.lower(text), lambda low: has_any(low, security.ORIGIN_WORDS))
    hidden = _some_lines(S.lines_of(text), secrets.worth_a_look)
    open_lines = _some_lines(S.lines_of(text), lambda line: ~line.rlike(r"^\s*(#|//|$)") & security.any_of(line, security.CORS))
    reason = F.coalesce("reason", S.reason_skipped()) if "reason" in files.columns else S.reason_skipped()  # a source may have told
    return files.withColumn("reason", reason).select(
        "repo_id", "file_path", "length", "reason", F.when(good, S.line_count(text)).otherwise(0).alias("n_lines"),
        (F.when(good & (deploy.is_named() | docs.is_named()), text) if _some(use, "DC") else F.lit(None).cast("string")).alias("content"),
        (F.when(good & secrets.worth_a_look(text), hidden) if _some(use, "R") else F.lit(None).cast(_LINE)).alias("suspects"),
        (F.when(good & config & open_to_all, open_lines) if _some(use, "B") else F.lit(None).cast(_LINE)).alias("configs"),
    )


def relevant_lines(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Lexed lines that some of the rules needs, and for B all lines of files that import a rate limiter, whose calls have any name. Sources in which none of them finds a word aren't lexed."""
    use = chosen(rules)
    need = F.col("whole")
    dimensions = [dimension for letter, dimension in (("I", incomplete), ("D", deploy), ("B", security)) if _some(use, letter)]
    for dimension in dimensions:
        need = need | dimension.relevant()
    some = files.where(F.lit(bool(dimensions)) & lexer.is_source() & S.reason_skipped().isNull())
    limiter = lexer.any_word(["express-rate-limit"]) if _some(use, "B") else NEVER
    return lexer.lex(some, "|".join(dimension.MAY_HAVE for dimension in dimensions), limiter).where(need).drop("whole")


def _lines(walked: DataFrame, column: str) -> DataFrame:
    return walked.select("repo_id", "file_path", F.explode(column).alias("x")).select("repo_id", "file_path", "x.line_no", "x.line")


def scan(files: DataFrame, rules: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The findings of rules over files (repo_id, file_path, content, length), and the walked files. rules as in chosen(): all dimensions for None.

    Both are saved tables. Findings of lines are limited and masked; only those of R and I push out one another where
    they overlap, and rules that aren't chosen push out none. Sources are lexed only for I, D and B.
    """
    use = chosen(rules)
    walked = save(walk(files, rules))
    code = save(relevant_lines(files)) if _some(use, "IDB") else None
    read = walked.where("reason is null")
    parts = []
    if _some(use, "R"):
        parts.append(secrets.one_pass(read, _lines(walked, "suspects")))
    if _some(use, "I"):
        parts.append(incomplete.found(code))
    if parts:
        lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        parts = [resolve.drop_overlaps(secrets.limited(lines.where(F.col("rule_id").isin(*use))))]
    if _some(use, "D"):
        parts.append(deploy.scan(read, code))
    if _some(use, "B"):
        parts.append(security.scan(code, _lines(walked, "configs")))
    if _some(use, "C"):
        parts.append(docs.scan(read, walked))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    out = save(found.where(F.col("rule_id").isin(*use)))
    if code is not None:
        discard(code)
    return out, walked


def totals(walked: DataFrame) -> DataFrame:
    """(repo_id, total_notices, total_skipped_files, total_scan_errors, total_files_scanned, total_lines_scanned)."""
    error = F.coalesce(F.col("reason").isin("stat_error", "read_error"), F.lit(False))
    read, notice = F.col("reason").isNull(), S.base_name().isin(S.ENV_EXAMPLES)
    return walked.groupBy("repo_id").agg(
        F.count_if(read & notice).alias("total_notices"), F.count_if(~read & ~error).alias("total_skipped_files"), F.count_if(error).alias("total_scan_errors"),
        F.count_if(read).alias("total_files_scanned"), F.sum("n_lines").alias("total_lines_scanned"),
    )
