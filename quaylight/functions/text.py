"""Column functions over lines and values: matches with places, assignments, key classes, value classes, masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Values that stand for no secret.
PLACEHOLDERS = (
    "foobar foo bar baz changeme change_me change-me example sample demo test testing test123 testtest dummy placeholder temp temporary "
    "your_password your_secret your_token your_api_key your_password_here your_secret_here xxx xxxx xxxxx xxxxxxxx todo tbd fixme none null nil undefined "
    "password secret token apikey api_key pass pwd user username *** your-password your-secret your-token your-key <password> <secret> <token> <api_key> "
    "string str value val redacted masked hidden"
).split()
# Settings that are no secret.
SETTINGS = (
    "production staging development dev prod test info debug warning error warn trace us-east-1 us-east-2 us-west-1 us-west-2 eu-west-1 eu-central-1 "
    "ap-northeast-1 ap-southeast-1 localhost 127.0.0.1 0.0.0.0 api web worker scheduler celery json yaml xml text html redis postgres mysql mongodb sqlite"
).split()
SWITCHES = "true false yes no on off enabled disabled".split()
CONFIG_SUFFIXES = ".env .yaml .yml .toml .ini .cfg .conf .properties .json".split()
# Parts of keys.
AWS_SECRET_NAMES = ["AWS_SECRET_ACCESS_KEY", "SECRET_ACCESS_KEY", "AWS_SECRET"]
PASSWORD_PARTS, SECRET_PARTS = ["PASSWORD", "PASSWD", "PWD"], ["SECRET", "TOKEN", "APIKEY"]
NOISE_PARTS = "LIMIT PATTERNS MAX MIN COUNT SIZE LENGTH DEFAULT VALUE MODEL SCHEMA MASKED HAS FLAG ENABLED PRESENT DISPLAY NAME TYPE".split()
SECRET_PAIRS = ["API_KEY", "ACCESS_KEY", "PRIVATE_KEY", "CLIENT_SECRET", "JWT_SECRET", "ACCESS_TOKEN", "GITHUB_TOKEN"]
# Formats.
GITHUB, AWS_KEY, GOOGLE = "ghp_[A-Za-z0-9]{36}", "AKIA[A-Z0-9]{16}", "AIza[A-Za-z0-9_\\-]{35}"
_NO = "@\\s\"'`,;\\]}"
CONNECTION = f"(?U)([a-zA-Z][a-zA-Z0-9+.-]*)://([^:/{_NO}]+):([^{_NO}]+)@([^{_NO[1:]}]+)"
NAME = "[A-Za-z_][A-Za-z0-9_]*"
ENV_REFERENCES = [
    r"\$[A-Z_][A-Z0-9_]*",
    rf"\$\{{{NAME}\}}",
    rf"\$\{{{NAME}:-.+\}}",
    rf"process\.env\.{NAME}",
    rf'process\.env\["{NAME}"\]',
    rf'os\.environ\["{NAME}"\]',
    rf"""os\.environ\.get\(["']{NAME}["']\)""",
    rf"""os\.environ\.get\(["']{NAME}["'],\s*["']?[A-Za-z0-9_\-.]*["']?\)""",
    rf"""os\.getenv\(["']{NAME}["']\)""",
    rf"""os\.getenv\(["']{NAME}["'],\s*["']?[A-Za-z0-9_\-.]*["']?\)""",
    rf"""getenv\(["']{NAME}["']\)""",
]
REDACTED, KEY_REDACTED = "<REDACTED>", "<PRIVATE_KEY_REDACTED>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_any(lowered: Column, words: list[str]) -> Column:
    """Whether a text holds any of some words as they are: a search of bytes, far cheaper than a pattern, to put before one."""
    out = lowered.contains(words[0])
    for w in words[1:]:
        out = out | lowered.contains(w)
    return out


def once(value: Column, test: Callable[[Column], Column]) -> Column:
    """test(value) with the value worked out once. Behind an or, an and or a condition Spark works it out again at each place that names it."""
    return F.get(F.transform(F.array(value), test), F.lit(0))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def matches(line: Column | str, pattern: str) -> Column:
    """array<struct<start, end, text>>: all matches without overlap, in 0-based code points. The pattern has no groups."""
    both = F.arrays_zip(_all(_col(line), f"(?s)(.*?)({pattern})", 2).alias("t"), _all(_col(line), f"(?s)(.*?)({pattern})", 0).alias("s"))
    nothing = F.named_struct(F.lit("end"), F.lit(0).cast("long"), F.lit("out"), F.array().cast("array<struct<start:bigint,end:bigint,text:string>>"))

    def step(done: Column, x: Column) -> Column:
        end = done["end"] + F.length(x["s"])
        hit = F.named_struct(F.lit("start"), end - F.length(x["t"]), F.lit("end"), end, F.lit("text"), x["t"])
        return F.named_struct(F.lit("end"), end, F.lit("out"), F.concat(done["out"], F.array(hit)))

    return F.aggregate(both, nothing, step, lambda done: done["out"])


def matches_of_connection(line: Column | str) -> Column:
    """array<struct<start, end, password>>: the place of the password in each connection string."""
    spans = _all(_col(line), f"(?s).*?(?:{CONNECTION})", 0)
    ends = lambda i: F.aggregate(F.slice(spans, 1, i + 1), F.lit(0).cast("long"), lambda n, s: n + F.length(s))

    def one(s: Column, i: Column) -> Column:
        password, host = (F.regexp_extract(s, f"(?s)^.*?(?:{CONNECTION})", k) for k in (3, 4))
        end = ends(i) - F.length(host) - 1
        return F.named_struct(F.lit("start"), end - F.length(password), F.lit("end"), end, F.lit("password"), password)

    return F.transform(spans, one)


_S = r"[\s\x1f]"
_IN1, _IN2, _IN3 = (rf"((?:\\.|(?!\{g}).)*+)" for g in (2, 8, 5))
_ASSIGN = rf"""(?:(["'])((?:\\.|(?!\1).)*+)\1(?:{_S}|["'])*+(=(?![=>])|:(?!=))|([A-Za-z_][A-Za-z0-9_.\-]*+)(?:{_S}|["'])*+(=)(?![=>])){_S}*+(?:(["'])((?:\\.|(?!\6).)*+)(\6|\z)|((?:\\.|[^\s\x1f])++))"""
_SKIP = r"""(["'])(?:\\.|(?!\10).)*+\10|[A-Za-z_][A-Za-z0-9_.\-]*+"""
_TOKEN = rf"(?sU).*?(?:{_ASSIGN}|{_SKIP})"


#: Stands between the groups of a token; a private-use character, and lines that have it take the longer way.
_GROUP_MARK = "\ue000"


def assignments(line: Column | str) -> Column:
    """array<struct<key, value, quoted, start, end, op>>: key = value pairs from left to right; values are never read again.

    A name takes =, a quoted name also a colon; ==, => and := are no assignments. A quoted value ends at its quote or at
    the end of the line, another one at white space. start and end are the value's, without quotes, in code points.
    """
    line = _col(line)
    found = _all(line, _TOKEN, 0)
    # every token's groups by one replacement, not by an extraction each
    marked = lambda t: F.split(F.regexp_replace(t, _TOKEN, _GROUP_MARK.join(f"${k}" for k in range(1, 10))), _GROUP_MARK, -1)
    extracted = lambda t: F.array(*[F.regexp_extract(t, _TOKEN, k) for k in range(1, 10)])
    plain = lambda s: F.regexp_replace(s, r"(?s)\\(.)", "$1")

    def pairs(groups: Callable[[Column], Column]) -> Column:
        tokens = F.transform(found, lambda t: F.named_struct(F.lit("n"), F.length(t), F.lit("g"), groups(t)))

        def one(ts: Column, t: Column, i: Column) -> Column:
            g = lambda k: F.get(t["g"], F.lit(k - 1))
            raw = F.when(g(6) != "", g(7)).otherwise(g(9))
            end = F.aggregate(F.slice(ts, 1, i + 1), F.lit(0).cast("long"), lambda n, x: n + x["n"]) - F.length(g(8))
            key = F.when(g(1) != "", plain(g(2))).otherwise(g(4))
            parts = {"key": key, "value": plain(raw), "quoted": g(6) != "", "start": end - F.length(raw), "end": end, "op": F.concat(g(3), g(5))}
            return F.when((g(3) != "") | (g(5) != ""), F.named_struct(*(x for k, v in parts.items() for x in (F.lit(k), v))))

        # inside an array of one, so that tokens are made once
        return F.get(F.transform(F.array(tokens), lambda ts: F.array_compact(F.transform(ts, lambda t, i: one(ts, t, i)))), F.lit(0))

    return F.when(line.contains(_GROUP_MARK), pairs(extracted)).otherwise(pairs(marked))


def key_parts(key: Column | str) -> Column:
    """Upper-case parts of a key, cut at separators and at capitals; other characters fall out."""
    return F.transform(_all(_col(key), "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+"), lambda p: F.upper(p))


def key_class(key: Column | str) -> Column:
    """'aws_secret', 'password', 'secret' or null. Words such as LIMIT beside a secret's make the key a setting."""
    def of(p: Column) -> Column:
        noise = F.arrays_overlap(p, F.array(*map(F.lit, NOISE_PARTS)))
        pairs = F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda s, i: F.concat(s, F.lit("_"), F.get(p, i + 1)))
        single = F.arrays_overlap(p, F.array(*map(F.lit, SECRET_PARTS))) & ~((F.size(p) > 1) & noise)
        double = F.arrays_overlap(pairs, F.array(*map(F.lit, SECRET_PAIRS))) & ~((F.size(p) > 2) & noise)
        return F.when(F.array_join(p, "_").isin(AWS_SECRET_NAMES), "aws_secret").when(F.arrays_overlap(p, F.array(*map(F.lit, PASSWORD_PARTS))), "password").when(single | double, "secret")

    return F.get(F.transform(F.array(key_parts(key)), of), F.lit(0))


def is_placeholder(v: Column | str) -> Column:
    return F.lower(_col(v)).isin(PLACEHOLDERS)


def is_placeholder_like(v: Column | str) -> Column:
    """A placeholder, one of its shapes, or an example that ends in dots."""
    v = _col(v)
    return is_placeholder(v) | v.rlike(r"(?i)^(your|example|sample|change|replace|placeholder|dummy|changeme|foobar|test|demo)([-_ ].*)?$") | v.rlike("(?U)(\\.\\.\\.|…)\\s*\\z")


def is_nullish(v: Column | str) -> Column:
    return F.lower(F.regexp_replace(_col(v), r"[,;)\]]+\z", "")).isin("true", "false", "none", "null")


def is_config_file(path: Column | str) -> Column:
    p = F.lower(_col(path))
    out = p.endswith(CONFIG_SUFFIXES[0])
    for s in CONFIG_SUFFIXES[1:]:
        out = out | p.endswith(s)
    return out


def is_dynamic(v: Column | str, quoted: Column, path: Column | str) -> Column:
    """An expression of code: a call, an index, a lambda, a shell command; without quotes also a dotted name, and outside settings files any name."""
    v = _col(v)
    call = v.rlike(r'(?U)^(?:[A-Za-z_][\w.]*[(\[]|lambda|await\b|"?\$\()')
    chain = v.rlike(r"(?U)^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+[,;)]?$")
    return call | (~quoted & (chain | (~is_config_file(path) & v.rlike(rf"^{NAME}[,;)]?$"))))


def is_documentation(v: Column | str) -> Column:
    return _col(v).rlike('[\\x{4e00}-\\x{9fff}]|^"?\\*{2,}"?$')


def is_env_reference(v: Column | str, quoted: Column) -> Column:
    return ~quoted & F.trim(_col(v)).rlike("^(?:" + "|".join(ENV_REFERENCES) + ")$")


def is_masked(v: Column | str) -> Column:
    v = _col(v)
    return v.isin(REDACTED, KEY_REDACTED) | v.rlike(r"^\*+\z") | v.rlike(r"(?U)^\w{4}\.\.\.\w{4}\z")


def is_low_entropy(v: Column | str, prefix: int) -> Column:
    """Four characters or more behind the prefix that are one unit of one to four, repeated."""
    body = F.substring(_col(v), prefix + 1, 1 << 30)
    return (F.length(body) >= 4) & body.rlike(r"^(?s:(.)\1+|(.{2})\2+|(.{3})\3+|(.{4})\4+)\z")


def is_no_secret(v: Column | str) -> Column:
    """Switches, numbers, short values, addresses, paths and common settings in a production file."""
    v = _col(v)
    low = F.lower(v)
    address = v.rlike("^(http|https|ftp)://") & ~v.contains("@")
    return low.isin(SWITCHES) | v.rlike(r"^\p{Nd}+\z") | (F.length(v) < 4) | address | v.rlike(r"^(/|\./|\.\./)") | low.isin(SETTINGS) | (low.rlike(r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)+$") & ~v.contains("@"))


def mask_secret(v: Column | str, kind: Column | str) -> Column:
    """A value masked by its kind: keys with a prefix keep four characters at both ends, connections lose the password."""
    v, kind = _col(v), _col(kind)
    ends = F.when(F.length(v) <= 8, REDACTED).otherwise(F.concat(F.left(v, F.lit(4)), F.lit("..."), F.right(v, F.lit(4))))
    connection = F.when(v.rlike(r"(?U)^[a-zA-Z][a-zA-Z0-9+.-]*://[^:/@\s]+:[^@\s]+@.*$"), F.regexp_replace(v, r"(?U)^([a-zA-Z][a-zA-Z0-9+.-]*://[^:/@\s]+):[^@\s]+@", "$1:***@")).otherwise(REDACTED)
    return F.when(v == "", v).when(kind == "private_key", KEY_REDACTED).when(kind == "connection_string", connection).when(kind.isin("github_token", "aws_access_key", "google_api_key"), ends).otherwise(REDACTED)


def mask_text(t: Column | str) -> Column:
    """Tokens of known formats first, then passwords of connections in the result."""
    out = F.regexp_replace(_col(t), "(ghp_)[A-Za-z0-9]{32}([A-Za-z0-9]{4})", "$1...$2")
    out = F.regexp_replace(out, "(AKIA)[A-Z0-9]{12}([A-Z0-9]{4})", "$1...$2")
    out = F.regexp_replace(out, r"(AIza)[A-Za-z0-9_\-]{31}([A-Za-z0-9_\-]{4})", "$1...$2")
    return F.regexp_replace(out, CONNECTION, "$1://$2:***@$4")


def splice(text: Column, spans: Column, by: str) -> Column:
    """Text with each of the ordered spans (start, end) replaced; spans don't overlap."""
    start = F.named_struct(F.lit("out"), F.lit(""), F.lit("at"), F.lit(0).cast("long"))
    step = lambda s, x: F.named_struct(F.lit("out"), F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(by)), F.lit("at"), x["end"])
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def may_assign(line: Column | str) -> Column:
    """False only for lines without any sensitive key or without a sign that assigns (a colon does after a quote): a cheap test before assignments()."""
    line = _col(line)
    signs = line.contains("=") | line.contains(":") & has_any(line, ['"', "'"])
    return signs & once(F.lower(F.replace(line, F.lit("\\"), F.lit(""))), lambda low: has_any(low, ["passw", "pwd", "secret", "token", "key"]))


def mask_line(line: Column | str) -> Column:
    """All sensitive values of a line masked: those of sensitive keys, then mask_text. References to the environment too."""
    line = _col(line)
    secret = lambda a: key_class(a["key"]).isNotNull() & (a["value"] != "") & ~is_masked(a["value"])
    return mask_text(F.when(may_assign(line), splice(line, F.filter(assignments(line), secret), REDACTED)).otherwise(line))


def safe_path(path: Column | str) -> Column:
    """A relative path, or <redacted-path> for absolute, drive, home, parent and NUL paths."""
    p = _col(path)
    bad = p.rlike(r"^(/|\\|~|[A-Za-z]:)") | F.array_contains(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), "..") | p.contains("\x00")
    return F.when(bad, "<redacted-path>").otherwise(p)
