"""Whole repositories in two readings against each rule over all lines; limits, masks and guards of the rules."""

import re

import pytest
from pyspark.sql import functions as F

from quaylight.operators import deploy, docs, incomplete, lexer, resolve, secrets, security, whole
from quaylight.sources import files as S

SECRET = "hunter2" + "x9k3"
REPOS = [
    ("a", "package.json", '{"name": "x", "dependencies": {"a": "1"}, "scripts": {"start": "node s.js"}}'),
    ("a", "src/server.js", "import rl from 'express-rate-limit'\napp.get('/users', (req, res) => {})\nconst q = req.body\napp.use(cors())\ndb.query('SELECT a FROM t WHERE x=' + req.query.x)\nconst k = process.env.KEY\nrl()\n"),
    ("a", "Dockerfile", "FROM --platform=x node AS build\nUSER app\nFROM node:latest\nCMD run\n"),
    ("a", "img/x.png", "binary"),
    ("a", "key.pem", "x\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\n"),
    ("b", "README.md", "# Two\nRequirements: python\nDeploy to production with gunicorn app\n## Project structure\n```\nimg/y.png\nimg/z.png\n```\n"),
    ("b", "img/y.png", "binary"),
    ("b", "requirements.txt", "a==1.0\nb==2\n"),
    ("b", "docker-compose.yml", "services:\n  web:\n    command:\n      - run\n    user: app\n"),
    ("b", "app.py", f"from x import HTTPBearer\n@app.get('/items')\ndef f(): pass\n# TODO password = \"{SECRET}\"\n# placeholder\nreturn None\n" + "print(1)\n" * 7),
    ("b", "conf/app.yml", "# allowed-origins: *\nallowed-origins: *\n"),
    ("c", "many.py", "# TODO\n" * 151 + "breakpoint()\r\nif x:\x0c    raise NotImplementedError\u2028pass"),
    ("c", "main.go", "package main\nfunc main() {\n os.Getenv(\"A\")\n}\n"),
    ("c", ".env.example", "A=1\n"),
    ("c", "bad.py", "x\x00y # TODO"),
    ("d", "empty.py", ""),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(r, p, bytearray(t.encode())) for r, p, t in REPOS]
    return spark.createDataFrame(rows, "repo_id string, file_path string, content binary").withColumn("length", F.octet_length("content").cast("long")).withColumn("content", F.col("content"))


def key(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


def test_two_readings_give_what_each_rule_gives_over_all_lines(spark, files):
    found, walked = whole.scan(files)
    good = files.where(S.reason_skipped().isNull())
    lexed, lines = lexer.lex(good), S.explode_lines(good)
    want = resolve.drop_overlaps(secrets.limited(secrets.rule_by_rule(good, lines).unionByName(incomplete.found(lexed))))
    for more in (deploy.scan(good, lexed), security.scan(lexed, security.config_lines(good)), docs.scan(good, files)):
        want = want.unionByName(more)
    assert key(found.collect()) == key(want.select(found.columns).collect())
    totals = {r["repo_id"]: r.asDict() for r in whole.totals(walked).collect()}
    assert totals["a"]["total_skipped_files"] == 1 and totals["a"]["total_files_scanned"] == 4 and totals["a"]["total_lines_scanned"] == 1 + 7 + 4 + 4
    assert totals["c"]["total_notices"] == 1 and totals["c"]["total_skipped_files"] == 1 and totals["d"]["total_lines_scanned"] == 0
    # a path that is there but not read counts as there
    c4 = [r["line_start"] for r in found.where("rule_id like 'C004%' and repo_id = 'b'").collect()]
    assert c4 == [7]


def test_findings_of_lines_are_masked_and_limited(spark, files):
    lexed = lexer.lex(files)
    for got in (incomplete.scan(lexed), whole.scan(files)[0]):
        rows = got.collect()
        assert rows and not any(SECRET in (r["snippet_masked"] or "") for r in rows)
        todo = [r for r in rows if r["rule_id"].startswith("I001") and r["file_path"] == "many.py"]
        assert sorted(r["line_start"] for r in todo) == list(range(1, 101))
        assert [r["snippet_masked"] for r in rows if r["rule_id"].startswith("I001") and r["repo_id"] == "b"] == ['# TODO password = "<REDACTED>"']
    line = f"db.query('SELECT a FROM t WHERE x=' + req.query.x); password = \"{SECRET}\""
    one = spark.createDataFrame([("r", "s.js", line + "\n")], "repo_id string, file_path string, content string")
    snippets = [r["snippet_masked"] for r in security.scan(lexer.lex(one), security.config_lines(one)).where("rule_id like 'B005%'").collect()]
    assert len(snippets) == 1 and SECRET not in snippets[0]


def test_a_comment_further_up_does_not_count_as_the_line_before(spark):
    text = "# placeholder\nx = 1\nreturn None\n# placeholder\nreturn None\n"
    lexed = lexer.lex(spark.createDataFrame([("r", "a.py", text)], "repo_id string, file_path string, content string"))
    for some in (lexed, lexed.where(incomplete.relevant())):
        assert [r["line_start"] for r in incomplete.placeholder_returns(some).collect()] == [5]


#: A line for each alternative of the patterns behind a guard.
EXAMPLES = {
    incomplete: ["# FIXME", "# xXx", "# Not  Implemented", "raise NotImplementedError", "todo! ( )", "panic('not implemented')", "debugger", "breakpoint()", "ipdb.set_trace()", "Console.log(", "System.err.println(", "println!(", "# HACK", "# PlaceHolder"],
    deploy: ["process.env.A", "process.env [", "os.getenv(", "os.environ [", "System.getenv(", "Environment.GetEnvironmentVariable(", "std::env::var(", "os.Getenv(", "ENV [", "$_ENV[", "$_SERVER [", "func main(", "static void main(", "fun main("],
    security: [
        "@app.get('/x'", "api.Post ('/x'", "@GetMapping", "@Post (", "[HttpGet", "[Route", "r.HandleFunc(", "http.HandleFunc(", "Route::get(", "Router :: get(", "get '/x'", "  POST \"/x\"", "app.MapGet(", "path('x'", "re_path (", "export async function GET(",
        "OAuth2PasswordBearer", "HTTPBearer", "passport.authenticate", "jwt_required", "login_required", "permission_classes", "authentication_classes", "@Authorize", "AddAuthentication(", "UseAuthentication(", "SecurityFilterChain", "@PreAuthorize", "Depends(current_user", "Auth::guard", "authenticate!",
        "BaseModel", "Field(", "@Valid", "@Validated", "zod", "Joi", "express-validator", "class-validator", "validateOrReject", ".safeParse(", ".parse(req.", "serializer.is_valid(", "Schema", "validator.Struct(", "ShouldBindJSON(", "ModelState.IsValid", "[Required", "[StringLength", "[Range", "FluentValidation", "FormRequest",
        "@limiter.limit", "Limiter(", "@Throttle", "throttle:", "Rack::Attack", "UseRateLimiter", "AddRateLimiter", "AspNetCoreRateLimit", "golang.org/x/time/rate", "rate.NewLimiter", "resilience4j-ratelimiter", "Bucket4j",
        "request.body", "request.get_json(", "req.query", "request.getParameter(", "Request.Form", "params [", "$_POST [", "r.Body", "r.FormValue", "r.URL.Query(", "cors()", "flask_cors", "import c from 'cors'", "allow_origins=['*'", "@CrossOrigin('*'", ".AllowAnyOrigin(", "CORS_ALLOW_ALL_ORIGINS = True", "origins '*'", "allowed-origins: *",
    ],
}
SOURCES = {
    incomplete: [incomplete.MARKER, incomplete.PLACEHOLDER, *incomplete.UNIMPLEMENTED, *incomplete.BREAKPOINTS, *incomplete.OUTPUTS],
    deploy: [deploy.ENV_USAGE, r"\bfunc\s+main\s*\(|\bstatic\s+void\s+main\s*\(|\bfun\s+main\s*\("],
    security: [*security.ROUTES, security.DJANGO, security.NEXT, security.AUTH, security.VALIDATION, security.RATE_LIMIT, security.RAW_INPUT, security.CORS_IMPORT, *security.CORS, r"(?i)\bflask_cors\b|\bcors\s*\("],
}


@pytest.mark.parametrize("rules", list(EXAMPLES), ids=lambda m: m.__name__.rsplit(".", 1)[-1])
def test_guards_let_every_alternative_pass(spark, rules):
    rows = spark.createDataFrame([(x,) for x in EXAMPLES[rules]], "line string")
    matched = F.lit(False)
    for p in SOURCES[rules]:
        matched = matched | F.col("line").rlike(p)
    got = rows.select("line", matched.alias("matched"), rules.may_have(F.lower("line")).alias("passes")).collect()
    assert not [r["line"] for r in got if r["matched"] and not r["passes"]]
    missed = [r["line"] for r in got if not r["matched"]]
    assert len(missed) <= 3, missed  # "Router ::" and the like aren't routes


def test_lines_end_where_python_ends_them(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k", "\r\n", "\n\n", "\ufeffx\ny", "ends\r", "ends\r\n", "\x85", "a\n\r\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["lines"], r["n"]) for r in rows.select("i", S.lines_of(F.col("t")).alias("lines"), S.line_count(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        want = re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", t.removeprefix("\ufeff"))
        want = want[:-1] if want[-1] == "" else want
        assert got[i] == (want, len(want)), t


def test_chosen_rules_are_planned_and_found_alone(spark, files, monkeypatch):
    every = whole.scan(files)[0].collect()
    lexed = []
    monkeypatch.setattr(whole, "relevant_lines", lambda f, real=whole.relevant_lines: lexed.append(1) or real(f))
    for rules, lexes in ((["R"], 0), (["C", "R009"], 0), (["I001"], 1), (["D"], 1), (["B004_PERMISSIVE_CORS"], 1)):
        lexed.clear()
        got = whole.scan(files, rules)[0].collect()
        assert key(got) == key([r for r in every if r["rule_id"].startswith(tuple(rules))]) and len(lexed) == lexes, rules
    plan = whole.walk(files, ["I"])._jdf.queryExecution().optimizedPlan().toString()
    assert "ghp_" not in plan and "ghp_" in whole.walk(files)._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        whole.scan(files, ["Z001"])
