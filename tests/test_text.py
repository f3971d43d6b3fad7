import random
import re

import pytest
from pyspark.sql import functions as F

from quaylight.functions import text as T
from quaylight.sources.files import LINE_END, base_name, line_count, lines_of  # noqa: F401


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r["x"] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_lines(spark):
    rows = ["", "a", "a\n", "\ufeffa\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e\u2028f", "\n\n", "a\n\nb"]
    assert values(spark, lines_of, rows) == [r.removeprefix("\ufeff").splitlines() for r in rows]


def test_counts_of_lines(spark):
    rows = ["", "a", "a\n", "\ufeff", "\ufeff\n", "\ufeffa\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e\u2028f", "\n\n", "a\n\nb", "\r", "\ufeff\r\n", "é\u2029\n", None]
    assert values(spark, line_count, rows) == [None if r is None else len(r.removeprefix("\ufeff").splitlines()) for r in rows]
    assert values(spark, base_name, ["", "a", "a/", "/a", "a/b.c", "//", None]) == ["", "a", "", "a", "b.c", "", None]


def python_matches(pattern, line):
    return [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, line)]


def test_places_of_matches(spark):
    rows = ["", "x AKIA" + "A" * 16 + " é🙂 AKIA" + "B2" * 8 + "AKIA" + "C" * 16, "none"]
    got = values(spark, lambda v: T.matches(v, T.AWS_KEY), rows)
    assert [[tuple(m) for m in g] for g in got] == [python_matches(T.AWS_KEY, r) for r in rows]


def plain_assignments(line):
    """The tokenizer again, as a scan over characters."""
    out, i, n = [], 0, len(line)
    name = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")

    def quoted(j):
        q, text, k = line[j], "", j + 1
        while k < n:
            if line[k] == "\\" and k + 1 < n:
                text, k = text + line[k + 1], k + 2
            elif line[k] == q:
                return text, k, True
            else:
                text, k = text + line[k], k + 1
        return text, n, False

    while i < n:
        if line[i] in "\"'":
            key, k, closed = quoted(i)
            if not closed:
                i += 1
                continue
            end, is_quoted = k + 1, True
        elif m := name.match(line, i):
            key, end, is_quoted = m.group(), m.end(), False
        else:
            i += 1
            continue
        j = end
        while j < n and (line[j].isspace() or line[j] in "\"'"):
            j += 1
        good = j < n and (line[j] == "=" and line[j + 1 : j + 2] not in ("=", ">") or line[j] == ":" and is_quoted and line[j + 1 : j + 2] != "=")
        j += 1
        while good and j < n and line[j].isspace():
            j += 1
        if not good or j >= n:
            i = end
            continue
        if line[j] in "\"'":
            value, k, closed = quoted(j)
            out.append((key, value, True, j + 1, k))
            i = k + 1
        else:
            k, value = j, ""
            while k < n and not line[k].isspace():
                if line[k] == "\\" and k + 1 < n:
                    value, k = value + line[k + 1], k + 2
                else:
                    value, k = value + line[k], k + 1
            out.append((key, value, False, j, k))
            i = k
    return out


def test_assignments(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "key", "=", ":", "==", "=>", ":=", '"', "'", "\\", " ", "  ", "#", "é", "$X", "{", "}", ",", "1"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    rows += ['password = "a b" token=x', '{"api_key": "v\\"w", "n": 1}', "x == y", "def f(a: str = 'z')", "k = ${DB_PASSWORD:-d} z=1", 'un="open', "a=b#c d", "'q' = 'w'"]
    got = values(spark, T.assignments, rows)
    for row, g in zip(rows, got):
        assert [(a["key"], a["value"], a["quoted"], a["start"], a["end"]) for a in g] == plain_assignments(row), row


@pytest.mark.parametrize("key, kind", [("DB_PASSWORD", "password"), ("apiKey", "secret"), ("TOKEN_LIMIT", None), ("AWS_SECRET", "aws_secret"), ("awsSecretAccessKey", "aws_secret"), ("mypassword", None), ("API2KEY", "secret"), ("PASSWORD_LENGTH", "password"), ("has_auth_token", None), ("apikey", "secret"), ("", None), ("client.secret", "secret"), ("access_key_id", "secret")])
def test_key_classes(spark, key, kind):
    assert values(spark, T.key_class, [key]) == [kind]


def test_low_entropy(spark):
    rows = ["ghp_" + "A" * 36, "ghp_" + "AB" * 18, "ghp_" + "ABC" * 12, "ghp_" + "ABCD" * 9, "ghp_" + "ABCDE" * 7 + "A", "ghp_AAA", "ghp_AAAAAAAAAA", "ghp_"]
    assert values(spark, lambda v: T.is_low_entropy(v, 4), rows) == [True, True, True, True, False, False, True, False]


def test_value_classes(spark):
    assert values(spark, T.is_nullish, ["true", "null;", "None)", "trueish", ""]) == [True, True, True, False, False]
    assert values(spark, T.is_placeholder_like, ["your-key", "yourkey", "changeme", "eyJ...", "Test pw", "real"]) == [True, False, True, True, True, False]
    assert values(spark, T.is_masked, ["<REDACTED>", "***", "ghp_...1wX2", "", "ab...cd", "x***"]) == [True, True, True, False, False, False]
    env = ["$VAR", "$var", "${a}", "${A:-x}", "process.env.X", 'os.environ["A"]', "os.getenv('A', 'b')", "os.getenv(A)", "x$VAR"]
    assert values(spark, lambda v: T.is_env_reference(v, F.lit(False)), env) == [True, False, True, True, True, True, True, False, False]
    assert values(spark, T.is_no_secret, ["yes", "12", "abc", "https://x/y", "https://u:p@x", "./a", "staging", "db.prod", "S3cret!"]) == [True, True, True, True, False, True, True, True, False]


def test_masks(spark):
    gh, db = "ghp" + "_" + "a1B2" * 9, "postgres://u:" + "pw1" + "@h/d"
    rows = [f"x {gh} y", f"a {db}, b {db}", 'password = "hunter2x" token=' + gh, "k=v", "", "PASSWORD=${X}"]
    out = values(spark, T.mask_line, rows)
    assert out == ["x ghp_...a1B2".replace("a1B2", gh[-4:]) + " y", "a postgres://u:***@h/d, b postgres://u:***@h/d", 'password = "<REDACTED>" token=<REDACTED>', "k=v", "", "PASSWORD=<REDACTED>"]
    assert values(spark, T.mask_line, out) == out  # once is enough
    kinds = spark.createDataFrame([("AKIA" + "X" * 16, "aws_access_key"), ("short", "github_token"), (db, "connection_string"), ("v", "password"), ("k", "private_key")], "v string, k string")
    assert [r[0] for r in kinds.select(T.mask_secret("v", "k")).collect()] == ["AKIA...XXXX", "<REDACTED>", "postgres://u:***@h/d", "<REDACTED>", "<PRIVATE_KEY_REDACTED>"]
    assert values(spark, T.safe_path, ["a/b", "/a", "~x", "C:\\a", "a/../b", "a..b"]) == ["a/b", "<redacted-path>", "<redacted-path>", "<redacted-path>", "<redacted-path>", "a..b"]
