"""Stored results read back: strictly typed or set aside with a reason, in any version, against invariants, and against what would be made today.

Bodies are JSON read as VARIANT, so a number in quotes or a boolean for a number is seen and never cast away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight import vocabulary as V
from quaylight.functions.text import mask_text
from quaylight.operators import publish

# Of the formats and the prompt.
ASSESSMENT_POLICY, ASSESSMENT_SCHEMA, REPAIR_POLICY, REPAIR_SCHEMA, REPAIR_SCOPE = "p0-6-v1", 1, "p0-7-v1", 1, "sensitive_data_security"
VERDICTS = ["pass", "warning", "blocked"]
PROMPT_HEAD = "## 修复动作摘要"
PROMPT_FIELDS = ["repo_url", "owner", "repo_name", "snippet", "数据库路径", "临时路径", "临时绝对路径"]
PROMPT_PATTERNS = [
    r"https?://[^\s\"'<>]+",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"AKIA[0-9A-Z]{16}",
    r"[A-Za-z]:[/\\][^\s\"'<>]+",
    r"/(?:var|tmp|home|Users)/[^\s\"'<>]+",
    r"\\x[0-9a-fA-F]{2}",
]
BREAKDOWN = "reason_code string, rule_id string, rule_name string, category string, severity string, finding_count bigint, occurrence_deductions array<bigint>, deduction_before_rule_cap bigint, max_deduction bigint, deduction bigint, description string"
CAPS = "reason_code string, cap_value bigint, score_before_cap bigint, score_after_cap bigint, applied boolean, description string"
REASONS = "rule_id string, rule_name string, severity string, file_path string, description string"
COVERAGE = (
    "status string, reasons array<string>, total_findings bigint, scored_findings bigint, findings_truncated boolean, total_blocking_findings bigint, returned_blocking_reasons bigint, "
    "blocking_reasons_truncated boolean, total_scan_errors bigint, total_files_scanned bigint, total_skipped_files bigint"
)
#: Fields of a breakdown that an earlier version named otherwise.
FORMER_NAMES = {"max_deduction": "rule_cap", "deduction": "applied_deduction"}


def _fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(f.split(" ")) for f in ddl.split(", ")]


def kind(v: Column, path: str = "$") -> Column:
    """What stands at a path of a VARIANT: OBJECT, ARRAY, BIGINT, BOOLEAN, STRING, VOID for null, ...; null if nothing does."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def _is(v: Column, path: str, kinds: list[str]) -> Column:
    """At the path is one of the kinds, or nothing."""
    return F.coalesce(kind(v, path).isin(kinds), F.lit(True))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


_KINDS = {"string": ["STRING", "VOID"], "bigint": ["BIGINT"], "boolean": ["BOOLEAN"], "array<bigint>": ["ARRAY"], "array<string>": ["ARRAY"]}
_OF_LIST = {"array<bigint>": ["BIGINT"], "array<string>": ["STRING", "VOID"]}


def _all_of(items: Column, kinds: list[str]) -> Column:
    return F.forall(items, lambda x: kind(x).isin(kinds))


def _typed(v: Column, ddl: str) -> Column:
    """An object whose fields, where they are, have the kinds of the ddl."""
    out = kind(v) == "OBJECT"
    for name, type_ in _fields(ddl):
        path = f"$.{name}"
        out = out & _is(v, path, _KINDS[type_])
        if type_ in _OF_LIST:
            out = out & _all_of(_items(v, path), _OF_LIST[type_])
    return out


def reason_rejected(v: Column) -> Column:
    """Why an assessment's body isn't read, or null: the first test that it fails."""
    former = ", ".join(f"{old} bigint" for old in FORMER_NAMES.values())
    whole = lambda name: _is(v, f"$.{name}", ["BIGINT"]) & F.coalesce(F.try_variant_get(v, f"$.{name}", "bigint").between(0, 100), F.lit(True))
    tests = {
        "not_json": v.isNotNull(),
        "not_an_object": kind(v) == "OBJECT",
        "schema_version": F.coalesce((kind(v, "$.schema_version") == "BIGINT") & (F.try_variant_get(v, "$.schema_version", "bigint") <= ASSESSMENT_SCHEMA), F.lit(True)),
        "lists": _is(v, "$.score_breakdown", ["ARRAY"]) & _is(v, "$.score_caps", ["ARRAY"]) & _is(v, "$.blocking_reasons", ["ARRAY"]),
        "coverage": _is(v, "$.coverage", ["OBJECT"]) & F.coalesce(_typed(F.try_variant_get(v, "$.coverage", "variant"), COVERAGE), F.lit(True)),
        "score": whole("score"),
        "score_before_caps": whole("score_before_caps"),
        "verdict": F.coalesce((kind(v, "$.verdict") == "STRING") & F.try_variant_get(v, "$.verdict", "string").isin(VERDICTS), F.lit(False)),
        "score_breakdown": F.forall(_items(v, "$.score_breakdown"), lambda x: _typed(x, f"{BREAKDOWN}, {former}")),
        "score_caps": F.forall(_items(v, "$.score_caps"), lambda x: _typed(x, CAPS)),
        "blocking_reasons": F.forall(_items(v, "$.blocking_reasons"), lambda x: _typed(x, REASONS)),
    }
    return F.coalesce(*[F.when(~ok, F.lit(name)) if name != "not_json" else F.when(v.isNull(), F.lit(name)) for name, ok in tests.items()])


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row. As a plain column, Spark would put its expression into each of those that use it, a parse for each test."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def checked_assessments(stored: DataFrame) -> DataFrame:
    """stored (task_id, body) with v, the body as VARIANT, and reason: null for those that can be read. One reading serves both sides."""
    parsed = once(stored, "v", F.try_parse_json("body"))
    return once(parsed, "reason", reason_rejected(F.col("v")))


def rejected(checked: DataFrame) -> DataFrame:
    """(task_id, reason, body): what is set aside."""
    return checked.where("reason is not null").select("task_id", "reason", "body")


def accepted(checked: DataFrame) -> DataFrame:
    """Readable assessments, typed, of any version, in today's names; what lacks has its default, texts are masked, paths are relative.

    A breakdown's former names count where today's lack. A rule without a name gets that of its id, an unknown one its id.
    """
    entry = f"struct<{', '.join(f'{n}: {t}' for n, t in _fields(BREAKDOWN))}, {', '.join(f'{old}: bigint' for old in FORMER_NAMES.values())}>"
    body = (
        f"schema_version bigint, score bigint, score_before_caps bigint, verdict string, score_breakdown array<{entry}>, score_caps array<struct<{', '.join(f'{n}: {t}' for n, t in _fields(CAPS))}>>, "
        f"blocking_reasons array<struct<{', '.join(f'{n}: {t}' for n, t in _fields(REASONS))}>>, coverage struct<{', '.join(f'{n}: {t}' for n, t in _fields(COVERAGE))}>"
    )
    names = F.create_map(*[F.lit(x) for r in V.RULES for x in r[:2]])
    said = lambda c: publish.without_paths(mask_text(c))

    def defaults(x: Column, ddl: str, special: dict[str, Column]) -> Column:
        made = []
        for name, type_ in _fields(ddl):
            value = special.get(name, x[name])
            if type_ == "bigint":
                value = F.coalesce(value, F.lit(0).cast("long"))
            elif type_ == "boolean":
                value = F.coalesce(value, F.lit(False))
            elif type_.startswith("array"):
                value = F.coalesce(value, F.array().cast(type_))
            elif name not in special:
                value = said(value) if name == "description" else mask_text(value)
            made.append(value.alias(name))
        return F.struct(*made)

    def breakdown(x: Column) -> Column:
        now = {new: F.coalesce(x[new], x[old]) for new, old in FORMER_NAMES.items()}
        return defaults(x, BREAKDOWN, now | {"rule_name": F.coalesce(F.nullif(mask_text(x["rule_name"]), F.lit("")), F.element_at(names, x["rule_id"]), x["rule_id"])})

    b = F.from_json("body", body)
    each = lambda c, f: F.coalesce(F.transform(c, f), F.array())
    return checked.where("reason is null").withColumn("b", b).select(
        "task_id", F.lit(ASSESSMENT_SCHEMA).alias("schema_version"), F.lit(ASSESSMENT_POLICY).alias("policy_version"),
        F.coalesce("b.score", F.lit(0)).cast("long").alias("score"), F.coalesce("b.score_before_caps", F.lit(0)).cast("long").alias("score_before_caps"), F.col("b.verdict").alias("verdict"),
        each(F.col("b.score_breakdown"), breakdown).alias("score_breakdown"),
        each(F.col("b.score_caps"), lambda x: defaults(x, CAPS, {})).alias("score_caps"),
        each(F.col("b.blocking_reasons"), lambda x: defaults(x, REASONS, {"file_path": publish.shown_path(x["file_path"])})).alias("blocking_reasons"),
        defaults(F.col("b.coverage"), COVERAGE, {}).alias("coverage"),
    )


# stored plans


_GROUP = "group_id string, action_code string, finding_count bigint, blocking boolean, highest_severity string, highest_confidence string, related_rule_ids array<string>, related_files_truncated boolean"
_SUMMARY = "total_repair_groups bigint, blocking_repair_groups bigint, manual_review_required boolean, coverage_warning boolean, groups_truncated boolean"
_ACTIONS = ", ".join(f"'{a[0]}'" for a in V.ACTIONS)
_PARTIAL = ", ".join(f"'{a}'" for a in publish.PARTIAL_ACTIONS)
_CUT = "(p.summary.groups_truncated or files_cut)"

#: What holds for every stored plan: a name and a condition over plan_facts(). A body that isn't typed is told of by the first alone.
INVARIANTS = {
    "typed": "typed",
    "schema_version": f"p.schema_version = {REPAIR_SCHEMA}",
    "policy_version": f"p.policy_version = '{REPAIR_POLICY}'",
    "repair_scope": f"p.repair_scope = '{REPAIR_SCOPE}'",
    "task_id": "p.task_id = task_id",
    "plan_status": "p.plan_status in ('complete', 'partial')",
    "status_column": "p.plan_status = plan_status",
    "coverage_warning": "p.summary.coverage_warning = (p.plan_status = 'partial')",
    "trigger_in_complete": "not trigger or p.plan_status = 'partial'",
    "cut_in_complete": f"not {_CUT} or p.plan_status = 'partial'",
    "cut_without_review": f"not {_CUT} or manual",
    "cut_without_scan": f"not {_CUT} or rerun",
    "partial_without_reason": f"p.plan_status <> 'partial' or trigger or {_CUT}",
    "total": "p.summary.total_repair_groups = total",
    "blocking": "p.summary.blocking_repair_groups = blocking",
    "manual": "p.summary.manual_review_required = manual",
    "total_column": "p.summary.total_repair_groups = total_repair_groups",
    "blocking_column": "p.summary.blocking_repair_groups = blocking_repair_groups",
    "source_column": "p.source_scan_updated_at = source_scan_updated_at",
    "group_ids": "numbered",
    "actions": f"forall(p.repair_groups, g -> g.action_code in ({_ACTIONS}))",
    "rule_ids": "forall(p.repair_groups, g -> g.related_rule_ids = array_sort(array_distinct(g.related_rule_ids)) and not array_contains(g.related_rule_ids, ''))",
    "prompt_characters": "not p.agent_prompt rlike '[\\\\p{Cf}\\\\p{Zl}\\\\p{Zp}]'",
    "prompt_content": "prompt_clean",
    "prompt_length": f"length(p.agent_prompt) <= {publish.MAX_PROMPT_CHARS}",
}


def plan_facts(stored: DataFrame) -> DataFrame:
    """Adds to stored plans (task_id, body, plan_status, total_repair_groups, blocking_repair_groups, source_scan_updated_at) what INVARIANTS speak of.

    p is the parsed body; typed tells whether every field is there and of its kind, where strings aren't null.
    """
    v = F.col("v")
    there = lambda x, ddl: [F.coalesce(kind(x, f"$.{n}").isin([k for k in _KINDS[t] if k != "VOID"]), F.lit(False)) for n, t in _fields(ddl)]
    top = "policy_version string, repair_scope string, task_id string, plan_status string, agent_prompt string, source_scan_updated_at string, schema_version bigint"
    typed = F.coalesce(kind(v) == "OBJECT", F.lit(False))
    for ok in [*there(v, top), *there(F.try_variant_get(v, "$.summary", "variant"), _SUMMARY), F.coalesce(kind(v, "$.repair_groups") == "ARRAY", F.lit(False))]:
        typed = typed & ok

    def group(x: Column) -> Column:
        out = kind(x) == "OBJECT"
        for ok in there(x, _GROUP):
            out = out & ok
        return out & F.forall(_items(x, "$.related_rule_ids"), lambda r: kind(r) == "STRING")

    as_type = lambda ddl: ", ".join(f"{n}: {t}" for n, t in _fields(ddl))
    parsed = F.from_json("body", f"{top}, summary struct<{as_type(_SUMMARY)}>, repair_groups array<struct<{as_type(_GROUP)}>>")
    rows = once(once(stored, "v", F.try_parse_json("body")), "typed", typed & F.forall(_items(v, "$.repair_groups"), group)).drop("v")
    rows = once(rows, "p", parsed)
    after = F.when(F.instr("p.agent_prompt", PROMPT_HEAD) > 0, F.substring_index("p.agent_prompt", PROMPT_HEAD, -1)).otherwise("")
    clean = ~after.rlike("|".join(f"(?:{p})" for p in PROMPT_PATTERNS))
    for word in PROMPT_FIELDS:
        clean = clean & ~after.contains(word)
    g = F.col("p.repair_groups")
    return rows.withColumns(
        {
            "trigger": F.expr(f"exists(p.repair_groups, g -> g.action_code in ({_PARTIAL}))"),
            "manual": F.expr("exists(p.repair_groups, g -> g.action_code = 'MANUAL_REVIEW_REQUIRED')"),
            "rerun": F.expr("exists(p.repair_groups, g -> g.action_code = 'RERUN_SECURITY_SCAN')"),
            "files_cut": F.exists(g, lambda x: x["related_files_truncated"]),
            "total": F.size(g).cast("long"),
            "blocking": F.size(F.filter(g, lambda x: x["blocking"])).cast("long"),
            "numbered": F.transform(g, lambda x, i: x["group_id"]) == F.transform(g, lambda x, i: F.format_string("RG%03d", i + 1)),
            "prompt_clean": clean,
        }
    )


def violations(facts: DataFrame, invariants: dict[str, str] = INVARIANTS) -> DataFrame:
    """(task_id, violation): every invariant that a plan breaks, in one pass; one that can't be told counts as broken."""
    broken = F.array(*[F.when(~F.coalesce(F.expr(condition), F.lit(False)), F.lit(name)) for name, condition in invariants.items()])
    named = F.when(F.col("typed"), F.array_compact(broken)).otherwise(F.array(F.lit("typed")))
    return facts.select("task_id", F.explode(named).alias("violation"))


def stored_groups(facts: DataFrame) -> DataFrame:
    """(task_id, action_code, finding_count, blocking, highest_severity, highest_confidence) of typed plans, a row a group."""
    return facts.where("typed").select("task_id", F.explode("p.repair_groups").alias("g")).select("task_id", "g.action_code", "g.finding_count", "g.blocking", "g.highest_severity", "g.highest_confidence")


def differences(stored: DataFrame, made: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, as often as it lacks them, and side: stored or made. Both have the same columns, in any order."""
    made = made.select(stored.columns)
    return stored.exceptAll(made).withColumn("side", F.lit("stored")).unionByName(made.exceptAll(stored).withColumn("side", F.lit("made")))


def bodies(groups: DataFrame, summary: DataFrame) -> DataFrame:
    """(repo_id, body): plans as they are stored, from groups with ids (publish.plan) and plan_summary's rows with a prompt, cut and source_scan_updated_at."""
    item = F.struct("group_id", "action_code", "finding_count", "blocking", "highest_severity", "highest_confidence", "related_rule_ids", (F.col("total_related_files") > V.MAX_RELATED_FILES).alias("related_files_truncated"))
    listed = groups.groupBy("repo_id").agg(F.sort_array(F.collect_list(item)).alias("repair_groups"))
    s = summary.join(listed, "repo_id")
    manual = F.exists("repair_groups", lambda x: x["action_code"] == "MANUAL_REVIEW_REQUIRED")
    return s.select(
        "repo_id",
        F.to_json(F.struct(
            F.lit(REPAIR_SCHEMA).alias("schema_version"), F.lit(REPAIR_POLICY).alias("policy_version"), F.lit(REPAIR_SCOPE).alias("repair_scope"), F.col("repo_id").alias("task_id"), "plan_status",
            F.struct(F.col("total_groups").alias("total_repair_groups"), F.col("blocking_groups").alias("blocking_repair_groups"), manual.alias("manual_review_required"), (F.col("plan_status") == "partial").alias("coverage_warning"), F.col("cut").alias("groups_truncated")).alias("summary"),
            "repair_groups", "agent_prompt", "source_scan_updated_at",
        )).alias("body"),
    )
