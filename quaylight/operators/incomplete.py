"""Unfinished code, I001 to I005, over lexed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.text import has_any, matches, once
from quaylight.operators.lexer import any_word
from quaylight.operators.secrets import finding, limited

# What marks unfinished code. RE2 and Java agree on these but for word ends beside letters beyond ASCII.
# Quoted texts are two alternatives, one a quote, as RE2, which the SQL runs on, has no back-references.
MARKER = r"(?iU)\b(?:TODO|FIXME|HACK|XXX)\b"
PLACEHOLDER = r"(?iU)\b(?:TODO|FIXME|HACK|XXX|placeholder|not\s+implemented)\b"
EMPTY_RETURN = r"(?iU)^\s*return\s+(?:\[\]|\{\}|None|null|nil|undefined)\s*;?\s*$"
UNIMPLEMENTED = [
    r"^\s*raise\s+NotImplementedError\b",
    r"^\s*throw\s+new\s+NotImplementedException\s*\(",
    r"(?i)^\s*raise\s+[A-Za-z_][\w.]*\s*\(\s*(?:'\s*not\s+implemented\b.*?'|\"\s*not\s+implemented\b.*?\")\s*\)",
    r"\b(?:todo|unimplemented)!\s*\(",
    r"(?i)^\s*throw\s+(?:new\s+)?[A-Za-z_$][\w$]*\s*\(\s*(?:'\s*not\s+implemented\b.*?'|\"\s*not\s+implemented\b.*?\")\s*\)",
    r"(?i)^\s*(?:return\s+)?panic\s*\(\s*(?:'\s*not\s+implemented\b.*?'|\"\s*not\s+implemented\b.*?\")\s*\)",
]
BREAKPOINTS = [r"\bdebugger\b\s*;?", r"\bbreakpoint\s*\(\s*\)", r"\b(?:pdb|ipdb)\.set_trace\s*\(\s*\)"]
OUTPUTS = [r"\bconsole\.log\s*\(", r"\bSystem\.(?:out|err)\.println\s*\(", r"(?<![.\w])print\s*\(", r"(?<![.\w])println!?\s*\("]
MOST_OUTPUTS = 5


def _each(lines: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Matches of any of the patterns, a row each."""
    some = lines.where(F.col(column).rlike("|".join(f"(?:{p})" for p in patterns)))
    found = F.flatten(F.array(*[matches(F.col(column), p) for p in patterns]))
    return some.select("repo_id", "file_path", "line_no", "line", "strings", "abstract", F.explode(found).alias("m")).select("repo_id", "file_path", "line_no", "line", "strings", "abstract", "m.*")


def todo_comments(lexed: DataFrame) -> DataFrame:
    """I001: markers in comments."""
    c = lexed.select("repo_id", "file_path", "line_no", "line", F.explode("comments").alias("c")).where(F.col("c.text").rlike(MARKER))
    m = c.select("repo_id", "file_path", "line_no", "line", F.col("c.start").alias("base"), F.explode(matches(F.col("c.text"), MARKER)).alias("m"))
    hits = m.select("repo_id", "file_path", "line_no", "line", (F.col("base") + F.col("m.start")).alias("start"), (F.col("base") + F.col("m.end")).alias("end"))
    return finding(hits, "I001")


def unimplemented(lexed: DataFrame) -> DataFrame:
    """I002: outside strings; abstract methods may."""
    hits = _each(lexed, "code", UNIMPLEMENTED).where(~F.exists("strings", lambda s: (s["start"] <= F.col("start")) & (F.col("start") < s["end"])))
    return finding(hits.where(~(F.col("abstract") & F.col("text").contains("NotImplementedError"))), "I002")


def placeholder_returns(lexed: DataFrame) -> DataFrame:
    """I003: an empty return with a placeholder's word in a comment of its line, or of the comment-only line before."""
    said: Column = F.exists("comments", lambda c: c["text"].rlike(PLACEHOLDER))
    w = Window.partitionBy("repo_id", "file_path").orderBy("line_no")
    alone = (F.trim("code") == "") & said
    just_before = F.lag("line_no").over(w) == F.col("line_no") - 1  # lexed may hold relevant() lines only
    near = lexed.withColumn("_before", F.coalesce(F.lag(alone).over(w) & just_before, F.lit(False)))
    start = F.length("line") - F.length(F.regexp_replace("line", "(?U)^\\s+", ""))
    hits = near.where(F.col("code").rlike(EMPTY_RETURN) & (said | F.col("_before"))).withColumn("start", start.cast("long")).withColumn("end", F.length(F.regexp_replace("line", "(?U)\\s+$", "")).cast("long"))
    return finding(hits, "I003")


def breakpoints(lexed: DataFrame) -> DataFrame:
    """I004: outside comments and strings."""
    return finding(_each(lexed, "bare", BREAKPOINTS), "I004")


def debug_output(lexed: DataFrame) -> DataFrame:
    """I005: a finding for a file with more than five calls, at the first."""
    n = sum((F.regexp_count("bare", F.lit(p)) for p in OUTPUTS), F.lit(0))
    per = lexed.withColumn("_n", n).where("_n > 0").groupBy("repo_id", "file_path").agg(F.sum("_n").alias("total"), F.min("line_no").alias("line_no")).where(F.col("total") > MOST_OUTPUTS)
    count = F.concat(F.lit("<debug-output-count:"), F.col("total").cast("string"), F.lit(">"))
    zero = F.lit(0).cast("long")
    return finding(per.withColumn("start", zero).withColumn("end", zero).withColumn("line", F.lit("")), "I005", None, snippet_masked=count)


# Words without one of which no rule matches, in lower case.
WORDS = "todo fixme hack xxx placeholder implemented debugger breakpoint set_trace console.log print".split()
#: A pattern for lexer.lex() that any text has in which some rule finds something.
MAY_HAVE = any_word(WORDS)
# Those of UNIMPLEMENTED and EMPTY_RETURN, in lower case, and those of BREAKPOINTS and OUTPUTS, as they are.
CODE_WORDS = ["implemented", "todo!", "return"]
BARE_WORDS = ["debugger", "breakpoint", "set_trace", "console.log", "print"]


def may_have(lowered: Column) -> Column:
    """False only for texts, in lower case, in which no rule finds anything."""
    return has_any(lowered, WORDS)


def relevant() -> Column:
    """Lexed lines that the rules need: all that can break one, and those that can be the comment before."""
    said = F.exists("comments", lambda c: c["text"].rlike(MARKER) | c["text"].rlike(PLACEHOLDER))
    code = once(F.lower("code"), lambda low: has_any(low, CODE_WORDS)) & F.col("code").rlike("|".join(f"(?:{p})" for p in [*UNIMPLEMENTED, EMPTY_RETURN]))
    return said | code | has_any(F.col("bare"), BARE_WORDS) & F.col("bare").rlike("|".join(f"(?:{p})" for p in [*BREAKPOINTS, *OUTPUTS]))


def found(lexed: DataFrame) -> DataFrame:
    """What all rules find, unlimited, the source line as it is in snippet_masked."""
    out = todo_comments(lexed)
    for rule in (unimplemented, placeholder_returns, breakpoints, debug_output):
        out = out.unionByName(rule(lexed))
    return out


def scan(lexed: DataFrame) -> DataFrame:
    """All I findings, at most 100 of a rule in a file, with masked snippets."""
    return limited(found(lexed))
