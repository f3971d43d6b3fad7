"""Sensitive-data rules R001 to R011 over lines (repo_id, file_path, line_no, line) and files; each gives findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight import vocabulary as V
from quaylight.functions import text as T
from quaylight.sources.files import ENV_EXAMPLES, base_name, explode_lines

# What findings say.
SAYS = {
    "R001": ("GitHub personal access token detected", "token", "github_token"),
    "R002": ("AWS access key detected", "token", "aws_access_key"),
    "R003": ("AWS secret access key detected", "token", "aws_secret_key"),
    "R004": ("Google API key detected", "token", "google_api_key"),
    "R005": ("Private key detected", "private_key", "private_key"),
    "R006": ("Hardcoded password assignment detected", "password", "password"),
    "R007": ("Hardcoded secret/token assignment detected", "secret", "generic_token"),
    "R008": ("Connection string with embedded password detected", "connection_string", "connection_string"),
    "R009": (".env file detected -- may contain environment secrets", "env_file", "env_file"),
    "R011": ("Production environment file contains hardcoded secret", "production_env", "production_secret"),
    "I001": ("An unfinished-work marker remains in production source code.", "unfinished_comment", ""),
    "I002": ("Executable code explicitly reports that it is not implemented.", "unimplemented_code", ""),
    "I004": ("An active debugger breakpoint remains in production source code.", "debug_breakpoint", ""),
    "I003": ("A return value is explicitly marked as a placeholder.", "placeholder_return", ""),
    "I005": ("This production source file contains more than five debug output calls.", "excessive_debug_output", ""),
}
PRODUCTION_FILES = [".env.production", ".env.prod", ".env.staging"]
KEY_KINDS = ["RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "PRIVATE KEY", "DSA PRIVATE KEY", "PGP PRIVATE KEY BLOCK"]
_RULES = {r[0][:4]: r for r in V.RULES}


def finding(hits: DataFrame, rule: str, low: Column | None = None, **other: Column) -> DataFrame:
    """Findings of a rule from (repo_id, file_path, line_no, start, end, line). low: where it counts as low, low, not blocking."""
    rule_id, name, severity, confidence, blocking, kind, _, template = _RULES[rule]
    says, category, secret = SAYS.get(rule, (name, V.DIMENSIONS["RIDBC".index(rule[0])], ""))
    low = F.lit(False) if low is None else F.coalesce(low, F.lit(False))
    made = {
        "repo_id": F.col("repo_id"), "rule_id": F.lit(rule_id), "rule_name": F.lit(name),
        "severity": F.when(low, "low").otherwise(severity), "confidence": F.when(low, "low").otherwise(confidence),
        "file_path": F.col("file_path"), "line_start": F.col("line_no"), "line_end": F.col("line_no"), "column_start": F.col("start"), "column_end": F.col("end"),
        "snippet_masked": F.col("line"), "is_blocking": F.lit(blocking) & ~low, "finding_type": F.lit(kind), "description": F.lit(says),
        "category": F.lit(category), "secret_type": F.lit(secret), "message": F.lit(says), "repair_template_key": F.lit(template),
        "dimension": F.lit(V.DIMENSIONS["RIDBC".index(rule[0])]),
    } | other
    return hits.select(*[made[c].alias(c) for c in V.FINDING_COLUMNS])


def findings_of(hits: DataFrame, rules: list[str]) -> DataFrame:
    """As finding(), for rows of several rules of one dimension; rule names each row's."""
    fields = [("rule_id", 0), ("rule_name", 1), ("severity", 2), ("confidence", 3), ("is_blocking", 4), ("finding_type", 5), ("repair_template_key", 7)]
    cases = {}
    for name, at in fields:
        for k in rules:
            value = F.lit(_RULES[k][at])
            cases[name] = F.when(F.col("rule") == k, value) if name not in cases else cases[name].when(F.col("rule") == k, value)
    says = {k: SAYS.get(k, (_RULES[k][1], V.DIMENSIONS["RIDBC".index(k[0])], "")) for k in rules}
    for i, name in enumerate(("description", "category", "secret_type")):
        for k in rules:
            cases[name] = F.when(F.col("rule") == k, says[k][i]) if name not in cases else cases[name].when(F.col("rule") == k, says[k][i])
    cases["message"] = cases["description"]
    return finding(hits, rules[0], None, **cases)


KEY_MARK = "-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"


def worth_a_look(text: Column) -> Column:
    """False only for lines, or whole texts, in which no rule can find anything."""
    return T.may_assign(text) | T.has_any(text, ["://", "ghp_", "AKIA", "AIza", "PRIVATE KEY"])


def suspects(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, line_no, line): the lines that are worth a look. Other files aren't cut into lines at all."""
    text = F.col("content").cast("string")
    return explode_lines(files.where(worth_a_look(text))).where(worth_a_look(F.col("line")))


def token_rule(lines: DataFrame, rule: str, pattern: str) -> DataFrame:
    """R001, R002, R004: tokens of a known format; a repetitive body counts as low."""
    hits = lines.where(F.col("line").rlike(pattern)).select("*", F.explode(T.matches("line", pattern)).alias("m")).select("repo_id", "file_path", "line_no", "line", "m.*")
    return finding(hits, rule, T.is_low_entropy("text", 4))


def sensitive_assignments(lines: DataFrame) -> DataFrame:
    """Assignments with a sensitive key and a value; parsed once for R003, R006, R007 and R011."""
    a = lines.where(T.may_assign("line")).select("*", F.explode(T.assignments("line")).alias("a")).select("repo_id", "file_path", "line_no", "line", "a.*")
    return a.withColumn("class", T.key_class("key")).where("class is not null and value <> ''")


def in_tests() -> Column:
    return F.col("file_path").rlike("(^|/)tests?/")


def aws_secret_rule(assigned: DataFrame) -> DataFrame:
    """R003: a 40-character value of an AWS secret's key."""
    hits = assigned.where((F.col("class") == "aws_secret") & F.col("value").rlike("^[A-Za-z0-9/+]{40}\\z") & ~T.is_placeholder("value"))
    return finding(hits, "R003", T.is_low_entropy("value", 0))


def _literal(assigned: DataFrame) -> DataFrame:
    """Values that may be secrets in code: no constants, expressions, documentation, references, masks."""
    like = T.is_placeholder_like("value")
    dynamic = ~like & T.is_dynamic("value", F.col("quoted"), "file_path")
    keep = ~T.is_nullish("value") & ~dynamic & ~T.is_documentation("value") & ~T.is_env_reference("value", F.col("quoted")) & ~T.is_masked("value")
    return assigned.where(keep).withColumn("low", like | in_tests())


def password_rule(assigned: DataFrame) -> DataFrame:
    """R006."""
    return finding(_literal(assigned.where("class = 'password'")), "R006", F.col("low"))


def token_assignment_rule(assigned: DataFrame) -> DataFrame:
    """R007: secrets, and AWS secrets whose value isn't R003's."""
    aws = F.col("class") == "aws_secret"
    hits = _literal(assigned.where((F.col("class") == "secret") | (aws & ~F.col("value").rlike("^[A-Za-z0-9/+]{40}\\z"))))
    says = F.when(aws, "AWS secret key with non-standard value detected").otherwise(SAYS["R007"][0])
    return finding(hits, "R007", F.col("low"), description=says, message=says, secret_type=F.when(aws, "aws_secret_key_generic").otherwise("generic_token"), repair_template_key=F.when(aws, "rotate_aws_credentials").otherwise("use_env_var_secret"))


def connection_rule(lines: DataFrame) -> DataFrame:
    """R008: the password's place in scheme://user:password@host."""
    some = lines.where(F.col("line").contains("://")).select("*", F.explode(T.matches_of_connection("line")).alias("m")).select("repo_id", "file_path", "line_no", "line", "m.*")
    hits = some.where(~T.is_env_reference("password", F.lit(False)) & ~T.is_masked("password"))
    return finding(hits, "R008", T.is_placeholder("password") | T.is_documentation("password"))


def production_rule(assigned: DataFrame) -> DataFrame:
    """R011: any sensitive key in a production environment file, but for comments and values that are no secret."""
    hits = assigned.where(base_name().isin(PRODUCTION_FILES) & ~F.col("line").rlike("(?U)^\\s*#"))
    return finding(hits.where(~T.is_env_reference("value", F.col("quoted")) & ~T.is_placeholder("value") & ~T.is_masked("value") & ~T.is_no_secret("value")), "R011")


def env_file_rule(files: DataFrame) -> DataFrame:
    """R009: a finding without a place."""
    none = F.lit(None).cast("long")
    at = files.where(base_name() == ".env").select("repo_id", "file_path", none.alias("line_no"), none.alias("start"), none.alias("end"), F.lit("").alias("line"))
    return finding(at, "R009")


def env_example_notices(files: DataFrame) -> DataFrame:
    """R010: a notice, not a finding."""
    return files.where(base_name().isin(ENV_EXAMPLES)).select("repo_id", F.lit("R010_ENV_EXAMPLE_FILE").alias("rule_id"), F.concat(F.lit("Environment example file found: "), base_name()).alias("message"), "file_path")


def private_key_rule(lines: DataFrame) -> DataFrame:
    """R005: blocks from a BEGIN line to their own END; the first BEGIN holds until then. One open at the end is reported as incomplete.

    Only lines with a header or footer are gathered, in order, and folded with one state: the open kind, its line, its column.
    """
    marks = lines.where(F.col("line").rlike(KEY_MARK)).groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("marks"))
    kinds = F.array(*map(F.lit, KEY_KINDS))
    block = "array<struct<line_no:bigint,line_b:bigint,start:bigint,kind:string,whole:boolean>>"
    edge = lambda word, kind: F.concat(F.lit(f"-----{word} "), kind, F.lit("-----"))
    made = lambda **c: F.named_struct(*(x for k, v in c.items() for x in (F.lit(k), v)))
    nothing = made(kind=F.lit(None).cast("string"), a=F.lit(0).cast("long"), start=F.lit(0).cast("long"), out=F.array().cast(block))

    def step(s: Column, m: Column) -> Column:
        opened = F.get(F.filter(kinds, lambda k: m["line"].contains(edge("BEGIN", k))), F.lit(0))
        at = F.instr(m["line"], edge("BEGIN", opened))  # from 1
        rest = F.substring(m["line"], (at + F.length(edge("BEGIN", opened))).cast("int"), F.length(m["line"]))
        same_line = made(line_no=m["line_no"], line_b=m["line_no"], start=(at - 1).cast("long"), kind=opened, whole=F.lit(True))
        closed = made(line_no=s["a"], line_b=m["line_no"], start=s["start"], kind=s["kind"], whole=F.lit(True))
        idle = made(kind=F.lit(None).cast("string"), a=F.lit(0).cast("long"), start=F.lit(0).cast("long"), out=s["out"])
        return (
            F.when(s["kind"].isNotNull() & m["line"].contains(edge("END", s["kind"])), made(kind=F.lit(None).cast("string"), a=F.lit(0).cast("long"), start=F.lit(0).cast("long"), out=F.concat(s["out"], F.array(closed).cast(block))))
            .when(s["kind"].isNotNull(), s)
            .when(opened.isNull(), idle)
            .when(rest.contains(edge("END", opened)), made(kind=F.lit(None).cast("string"), a=F.lit(0).cast("long"), start=F.lit(0).cast("long"), out=F.concat(s["out"], F.array(same_line).cast(block))))
            .otherwise(made(kind=opened, a=m["line_no"], start=(at - 1).cast("long"), out=s["out"]))
        )

    folded = marks.withColumn("s", F.aggregate("marks", nothing, step))
    left = F.array(made(line_no=F.col("s.a"), line_b=F.col("s.a"), start=F.col("s.start"), kind=F.col("s.kind"), whole=F.lit(False))).cast(block)
    blocks = F.concat(F.col("s.out"), F.when(F.col("s.kind").isNotNull() & (F.size("s.out") < V.FINDINGS_PER_RULE_FILE), left).otherwise(F.array().cast(block)))
    each = folded.select("repo_id", "file_path", F.explode(blocks).alias("k")).select("repo_id", "file_path", "k.*", F.lit(T.KEY_REDACTED).alias("line"))
    each = each.withColumn("end", F.col("start") + F.length(edge("BEGIN", F.col("kind"))))
    says = F.concat(F.when(F.col("whole"), "Private key block detected (").otherwise("Incomplete private key block -- BEGIN header found without matching END ("), F.lit("BEGIN "), F.col("kind"), F.lit(")"))
    return finding(each, "R005", None, line_end=F.col("line_b"), description=says, message=F.lit("Private key block detected"))


def rule_by_rule(files: DataFrame, lines: DataFrame) -> DataFrame:
    """The findings of all rules, each rule reading the lines for itself; one_pass() gives the same."""
    plain = lines.where(~base_name().isin(ENV_EXAMPLES))
    every = sensitive_assignments(lines)
    other = every.where(~base_name().isin(ENV_EXAMPLES))
    found = [
        token_rule(lines, "R001", T.GITHUB), token_rule(lines, "R002", T.AWS_KEY), aws_secret_rule(every), token_rule(lines, "R004", T.GOOGLE), private_key_rule(lines),
        password_rule(other), token_assignment_rule(other), connection_rule(plain), env_file_rule(files), production_rule(other),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def one_pass(files: DataFrame, lines: DataFrame) -> DataFrame:
    """The findings of all rules from one reading of the lines, and one more of those that bound key blocks.

    Tokens, connections and assignments of a line are one array; its elements become rows, and each row the rules that
    it breaks. Files named as examples get R001 to R005 only.
    """
    line = F.col("line")
    hit = lambda rule, start, end, value, key, quoted: F.named_struct(F.lit("rule"), F.lit(rule), F.lit("start"), start, F.lit("end"), end, F.lit("value"), value, F.lit("key"), key, F.lit("quoted"), quoted)
    token = lambda rule, pattern: F.when(line.rlike(pattern), F.transform(T.matches(line, pattern), lambda m: hit(rule, m["start"], m["end"], m["text"], F.lit(""), F.lit(False))))
    strings = F.when(line.contains("://"), F.transform(T.matches_of_connection(line), lambda m: hit("R008", m["start"], m["end"], m["password"], F.lit(""), F.lit(False))))
    given = F.when(T.may_assign(line), F.transform(T.assignments(line), lambda a: hit("", a["start"], a["end"], a["value"], a["key"], a["quoted"])))
    parts = [token("R001", T.GITHUB), token("R002", T.AWS_KEY), token("R004", T.GOOGLE), strings, given]
    some = lines.where(T.may_assign(line) | line.contains("://") | line.rlike(f"{T.GITHUB}|{T.AWS_KEY}|{T.GOOGLE}"))
    hits = some.select("repo_id", "file_path", "line_no", "line", F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("x")).select("repo_id", "file_path", "line_no", "line", "x.*").where("value <> ''")
    hits = hits.withColumn("class", F.when(F.col("rule") == "", T.key_class("key"))).where("rule <> '' or class is not null")
    example = base_name().isin(ENV_EXAMPLES)
    assigned, quoted = F.col("rule") == "", F.col("quoted")
    strict = (F.col("class") == "aws_secret") & F.col("value").rlike("^[A-Za-z0-9/+]{40}\\z")
    like, exact, masked, env = T.is_placeholder_like("value"), T.is_placeholder("value"), T.is_masked("value"), T.is_env_reference("value", quoted)
    literal = ~T.is_nullish("value") & (like | ~T.is_dynamic("value", quoted, "file_path")) & ~T.is_documentation("value") & ~env & ~masked
    broken = {
        "R001": F.col("rule") == "R001", "R002": F.col("rule") == "R002", "R004": F.col("rule") == "R004",
        "R003": assigned & strict & ~exact,
        "R006": assigned & ~example & (F.col("class") == "password") & literal,
        "R007": assigned & ~example & ((F.col("class") == "secret") | (F.col("class") == "aws_secret") & ~strict) & literal,
        "R008": (F.col("rule") == "R008") & ~example & ~T.is_env_reference("value", F.lit(False)) & ~masked,
        "R011": assigned & base_name().isin(PRODUCTION_FILES) & ~line.rlike("(?U)^\\s*#") & ~env & ~exact & ~masked & ~T.is_no_secret("value"),
    }
    low = {
        **{r: T.is_low_entropy("value", 4) for r in ("R001", "R002", "R004")}, "R003": T.is_low_entropy("value", 0),
        "R006": like | in_tests(), "R007": like | in_tests(), "R008": exact | T.is_documentation("value"), "R011": F.lit(False),
    }
    rows = hits.select("*", F.explode(F.array_compact(F.array(*[F.when(c, F.named_struct(F.lit("r"), F.lit(r), F.lit("low"), F.coalesce(low[r], F.lit(False)))) for r, c in broken.items()]))).alias("b"))
    r, is_low = F.col("b.r"), F.col("b.low")

    def of(value) -> Column:
        out = None
        for k in broken:
            out = F.when(r == k, F.lit(value(k))) if out is None else out.when(r == k, F.lit(value(k)))
        return out

    odd = (r == "R007") & (F.col("class") == "aws_secret")
    says = F.when(odd, "AWS secret key with non-standard value detected").otherwise(of(lambda k: SAYS[k][0]))
    made = {
        "repo_id": F.col("repo_id"), "rule_id": of(lambda k: _RULES[k][0]), "rule_name": of(lambda k: _RULES[k][1]),
        "severity": F.when(is_low, "low").otherwise(of(lambda k: _RULES[k][2])), "confidence": F.when(is_low, "low").otherwise(of(lambda k: _RULES[k][3])),
        "file_path": F.col("file_path"), "line_start": F.col("line_no"), "line_end": F.col("line_no"), "column_start": F.col("start"), "column_end": F.col("end"),
        "snippet_masked": line, "is_blocking": of(lambda k: _RULES[k][4]) & ~is_low, "finding_type": F.lit("content"), "description": says,
        "category": of(lambda k: SAYS[k][1]), "secret_type": F.when(odd, "aws_secret_key_generic").otherwise(of(lambda k: SAYS[k][2])), "message": says,
        "repair_template_key": F.when(odd, "rotate_aws_credentials").otherwise(of(lambda k: _RULES[k][7])), "dimension": F.lit(V.SENSITIVE),
    }
    return rows.select(*[made[c].alias(c) for c in V.FINDING_COLUMNS]).unionByName(private_key_rule(lines)).unionByName(env_file_rule(files))


def scan(files: DataFrame, lines: DataFrame) -> DataFrame:
    """All sensitive-data findings, at most 100 of a rule in a file, with masked snippets."""
    return limited(one_pass(files, lines))


def limited(findings: DataFrame) -> DataFrame:
    """What any rule that reads lines gives: at most 100 of a rule in a file, then their lines masked and cut."""
    from quaylight.operators.resolve import top_per_rule_and_file

    return with_snippets(top_per_rule_and_file(findings))


def with_snippets(findings: DataFrame) -> DataFrame:
    """Lines become snippets: masked whole, then cut to 200 characters. Only rows that are kept get here."""
    line = F.col("snippet_masked")
    masked = F.when(line.isin("", T.KEY_REDACTED), line).otherwise(F.left(T.mask_line(line), F.lit(200)))
    return findings.withColumn("snippet_masked", masked).withColumn("file_path", T.mask_text("file_path"))
