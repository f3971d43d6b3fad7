"""Small repositories planted from the table of customers: a row is a repository, its key says which files it has and what stands in them.

Files are given by SQL over the key n that both Spark and the oracle understand; ~ stands for a line's end. What the rules have to
find is said by SQL over n alone (FLAGS and below), not by reading the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.storage import small_parts, spread

_README = """# Tool~~This tool collects numbers from many places and shows them on one page, so that nobody has to look for them by hand.~~Requirements: node. Deploy to production with npm start.~~## Built with~~- React~~## Usage~~```~npm run build~make all~python src/tool.py~```~~## Project structure~~```~src/app.js~src/gone.js~```~"""
_SECRET = "substr(md5(CAST(n AS STRING)), 1, 12)"
_APP = f"""
  (CASE WHEN n % 8 < 4 THEN 'const k = process.env.KEY' ELSE 'const k = 1' END) || '~' || (CASE WHEN n % 9 < 6 THEN 'app.get(''/users'', (req, res) => {{}})' ELSE '// nothing' END) || '~'
  || (CASE WHEN n % 9 < 3 THEN 'const q = req.body' ELSE 'const q = 2' END) || '~' || (CASE WHEN n % 10 < 3 THEN 'jwt_required' ELSE 'x()' END) || '~'
  || (CASE WHEN n % 11 < 4 THEN 'res.setHeader(''Access-Control-Allow-Origin'', ''*'')' ELSE 'y()' END) || '~'
  || (CASE WHEN n % 12 = 0 THEN 'db.query(''SELECT a FROM t WHERE x='' + req.query.x + "" + ''password='' )' ELSE 'z()' END) || '~'
  || (CASE WHEN n % 13 < 5 THEN '// TODO password = "' || {_SECRET} || '"' ELSE '// fine' END) || '~' || (CASE WHEN n % 14 = 3 THEN 'debugger;' ELSE 'w()' END) || '~'
  || (CASE WHEN n % 43 < 8 THEN 'import rl from ''express-rate-limit''~' ELSE '' END) || (CASE WHEN n % 43 < 4 THEN 'rl()~' ELSE '' END)"""
_PACKAGE = """
  CASE WHEN n % 22 = 0 THEN '{' ELSE '{"name": "p", "dependencies": {"' || (CASE WHEN n % 8 = 6 THEN 'react' ELSE 'left' END) || '": "1"}, "scripts": {' || (CASE WHEN n % 4 = 0 THEN '"start": "node s.js"' ELSE '"build": "x"' END) || '}}' END"""
#: Path, when it is there, its text.
FILES = [
    ("LICENSE", "true", "'text here~'"),
    ("package.json", "n % 2 = 0", _PACKAGE),
    ("package-lock.json", "n % 6 = 0", "'{}'"),
    ("sub/package.json", "n % 10 = 4", """'{"dependencies": {"left": "1"}}'"""),
    ("sub/yarn.lock", "n % 20 = 4", "'#~'"),
    ("Dockerfile", "n % 5 > 0", "CASE n % 5 WHEN 1 THEN 'RUN x~' WHEN 2 THEN 'FROM node~CMD run~' WHEN 3 THEN 'FROM node:20~USER app~CMD run~' ELSE 'FROM a:1 AS b~USER app~CMD x~FROM c:latest~' END"),
    ("docker-compose.yml", "n % 29 < 6", "CASE WHEN n % 29 < 3 THEN 'services:~ web:~  command: run~  user: root~' ELSE 'services:~ web:~  image: x~  user: app~' END"),
    ("README.md", "n % 3 > 0", f"CASE WHEN n % 3 = 1 THEN '# T~short~' ELSE '{_README}' END"),
    ("readme.txt", "n % 21 < 4", "'notes~'"),
    (".env.example", "n % 16 = 5", "'KEY=~'"),
    (".env", "n % 20 = 7", "'A=1~'"),
    ("src/app.js", "n % 7 <> 0", _APP),
    ("src/lib.py", "n % 15 < 7", "'def f():~' || (CASE WHEN n % 17 < 8 THEN '    raise NotImplementedError()~' ELSE '    return None  # placeholder~' END) || repeat('print(1)~', CAST(n % 9 AS INT))"),
    ("src/many.py", "n % 59 = 1", "repeat('# TODO~', 150)"),
    ("src/settings.py", "n % 19 = 0", "'auth ghp' || '_' || substr(md5(CAST(n AS STRING)) || md5('x'), 1, 36) || '~'"),
    ("src/tool.py", "n % 53 < 20", "'x = 1~'"),
    ("main.go", "n % 31 < 5", "'package main~func main() {~}~'"),
    ("go.mod", "n % 31 < 3", "'module x~require y v1~'"),
    ("go.sum", "n % 31 = 0", "'y v1~'"),
    ("pom.xml", "n % 37 < 3", "CASE WHEN n % 37 = 0 THEN '<project>' ELSE '<project><dependencies><dependency/></dependencies></project>' END"),
    ("requirements.txt", "n % 23 < 5", "'-r req/base.txt~' || (CASE WHEN n % 23 = 1 THEN 'a>=1~' ELSE 'a==1.0~' END)"),
    ("req/base.txt", "n % 23 < 5", "'-r more.txt~b==2~'"),
    ("req/more.txt", "n % 23 < 5", "'c_d~-r ../requirements.txt~'"),
    ("conf/app.yml", "n % 41 < 3", "'a: 1~allowed-origins: *~'"),
    ("Makefile", "n % 47 < 9", "'all: x~\techo~'"),
    ("img/a.png", "n % 61 < 9", "'not an image'"),
]


#: A key is a few bytes and its files are thousands: a block of the table's file would be far too much for one task.
KEYS_A_TASK = 8192


def repositories(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, file_path, content, length)."""
    small_parts(spark)
    each = ", ".join(f"CASE WHEN {when} THEN named_struct('file_path', '{path}', 'content', replace({text}, '~', chr(10))) END" for path, when, text in FILES)
    keys = spread(spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").cast("long").alias("n"), F.col("c_custkey").cast("string").alias("repo_id")), KEYS_A_TASK, "repo_id")
    made = keys.select("repo_id", F.explode(F.expr(f"array_compact(array({each}))")).alias("f"))
    return made.select("repo_id", "f.file_path", "f.content", F.octet_length("f.content").cast("long").alias("length"))


#: What each repository has, by its key.
FLAGS = """
  WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS repo_id, c_custkey AS n FROM customer),
  g AS (
    SELECT *, n % 7 <> 0 AS js, n % 2 = 0 AND n % 22 <> 0 AS pkg, n % 10 = 4 AS sub, n % 5 AS dk, n % 29 < 6 AS comp, n % 29 < 3 AS comp_start, n % 29 BETWEEN 3 AND 5 AS comp_other,
           n % 3 = 2 AS documented, CASE WHEN n % 3 > 0 THEN 'README.md' WHEN n % 21 < 4 THEN 'readme.txt' END AS readme FROM c
  ), f AS (
    SELECT *, js AND n % 9 < 6 AS route, js AND (n % 9 < 3 OR n % 12 = 0) AS raw, js AND n % 10 < 3 AS auth, js AND n % 43 < 4 AS limited, pkg AND n % 8 = 6 AS react,
           coalesce(readme, '<repository>') AS readme_or_root FROM g
  )"""


def _union(rows: list[tuple[str, str, str, str]], more: str = "") -> str:
    """SQL of (repo_id, rule_id, file_path, line_start) for (rule, path, line, condition) over FLAGS."""
    return " UNION ALL ".join(f"SELECT repo_id, '{rule}' AS rule_id, {path} AS file_path, CAST({line} AS BIGINT) AS line_start FROM f WHERE {when}" for rule, path, line, when in rows) + more


DEPLOY = [
    ("D001_PRODUCTION_START", "'<repository>'", "NULL", "NOT (pkg AND n % 4 = 0 OR n % 31 < 5 OR dk IN (2, 3) OR comp_start OR documented)"),
    ("D002_ENVIRONMENT_DOCUMENTATION", "'src/app.js'", "NULL", "js AND n % 8 < 4 AND n % 16 <> 5"),
    ("D003_DEPENDENCY_LOCK", "'package.json'", "NULL", "pkg AND n % 6 <> 0"),
    ("D003_DEPENDENCY_LOCK", "'sub/package.json'", "NULL", "sub AND n % 20 <> 4"),
    ("D003_DEPENDENCY_LOCK", "'go.mod'", "NULL", "n % 31 IN (1, 2)"),
    ("D003_DEPENDENCY_LOCK", "'requirements.txt'", "NULL", "n % 23 = 1"),
    ("D003_DEPENDENCY_LOCK", "'pom.xml'", "NULL", "n % 37 IN (1, 2)"),
    ("D004_DEPLOYMENT_DOCUMENTATION", "readme_or_root", "NULL", "NOT documented"),
    ("D005_DOCKER_MISSING", "'<repository>'", "NULL", "dk = 0 AND NOT comp"),
    ("D006_DOCKER_MISSING_FROM", "'Dockerfile'", "NULL", "dk = 1"),
    ("D007_DOCKER_MUTABLE_BASE", "'Dockerfile'", "NULL", "dk IN (2, 4)"),
    ("D008_DOCKER_ROOT_USER", "'Dockerfile'", "NULL", "dk IN (2, 4) AND NOT comp_other OR dk = 3 AND comp_start"),
    ("D008_DOCKER_ROOT_USER", "'docker-compose.yml'", "NULL", "dk = 0 AND comp_start"),
    ("D009_DOCKER_MISSING_START", "'Dockerfile'", "NULL", "dk = 4 AND NOT comp_start"),
    ("D009_DOCKER_MISSING_START", "'docker-compose.yml'", "NULL", "dk = 0 AND comp_other"),
    ("D010_INVALID_DEPLOYMENT_CONFIG", "'package.json'", "NULL", "n % 22 = 0"),
    ("D010_INVALID_DEPLOYMENT_CONFIG", "'pom.xml'", "NULL", "n % 37 = 0"),
]
SECURITY = [
    ("B001_API_AUTHENTICATION", "'src/app.js'", "NULL", "route AND NOT auth"),
    ("B002_INPUT_VALIDATION", "'src/app.js'", "NULL", "route AND raw"),
    ("B003_RATE_LIMITING", "'src/app.js'", "NULL", "route AND NOT limited"),
    ("B004_PERMISSIVE_CORS", "'src/app.js'", "5", "js AND n % 11 < 4"),
    ("B004_PERMISSIVE_CORS", "'conf/app.yml'", "2", "n % 41 < 3"),
    ("B005_SQL_INJECTION", "'src/app.js'", "6", "js AND n % 12 = 0"),
]
DOCS = [
    ("C001_README_COMPLETENESS", "readme_or_root", "NULL", "NOT documented"),
    ("C002_TECH_STACK_MISMATCH", "readme", "9", "documented AND (pkg OR sub) AND NOT react"),
    ("C003_START_COMMAND_MISMATCH", "readme", "14", "documented AND NOT (pkg AND n % 4 = 2)"),
    ("C003_START_COMMAND_MISMATCH", "readme", "15", "documented AND n % 47 >= 9"),
    ("C003_START_COMMAND_MISMATCH", "readme", "16", "documented AND n % 53 >= 20"),
    ("C004_PROJECT_STRUCTURE_MISMATCH", "readme", "22", "documented AND NOT js"),
    ("C004_PROJECT_STRUCTURE_MISMATCH", "readme", "23", "documented"),
]
INCOMPLETE = [
    ("I001_TODO_COMMENT", "'src/app.js'", "7", "js AND n % 13 < 5"),
    ("I002_UNIMPLEMENTED_CODE", "'src/lib.py'", "2", "n % 15 < 7 AND n % 17 < 8"),
    ("I003_PLACEHOLDER_RETURN", "'src/lib.py'", "2", "n % 15 < 7 AND n % 17 >= 8"),
    ("I004_DEBUG_BREAKPOINT", "'src/app.js'", "8", "js AND n % 14 = 3"),
    ("I005_EXCESSIVE_DEBUG_OUTPUT", "'src/lib.py'", "3", "n % 15 < 7 AND n % 9 > 5"),
]
SECRETS = [
    ("R001_GITHUB_TOKEN", "'src/settings.py'", "1", "n % 19 = 0"),
    ("R006_PASSWORD_ASSIGNMENT", "'src/app.js'", "7", "js AND n % 13 < 5"),
    ("R009_ENV_FILE_PRESENT", "'.env'", "NULL", "n % 20 = 7"),
]
#: A file with 150 markers gives 100.
_MANY = " UNION ALL SELECT repo_id, 'I001_TODO_COMMENT', 'src/many.py', unnest(range(1, 101)) FROM f WHERE n % 59 = 1"
_SNIPPETS = """CASE rule_id WHEN 'I001_TODO_COMMENT' THEN CASE file_path WHEN 'src/many.py' THEN '# TODO' ELSE '// TODO password = "<REDACTED>"' END WHEN 'I002_UNIMPLEMENTED_CODE' THEN '    raise NotImplementedError()'
    WHEN 'I003_PLACEHOLDER_RETURN' THEN '    return None  # placeholder' WHEN 'I004_DEBUG_BREAKPOINT' THEN 'debugger;' ELSE '<debug-output-count:' || CAST(CAST(repo_id AS BIGINT) % 9 AS VARCHAR) || '>' END"""

DEPLOY_SQL = FLAGS + f" SELECT repo_id, rule_id, file_path FROM ({_union(DEPLOY)})"
SECURITY_SQL = FLAGS + _union(SECURITY)
DOCS_SQL = FLAGS + _union(DOCS)
INCOMPLETE_SQL = FLAGS + f" SELECT *, {_SNIPPETS} AS snippet_masked FROM ({_union(INCOMPLETE, _MANY)})"
LOCKS_SQL = FLAGS + f" SELECT repo_id, file_path FROM ({_union([r for r in DEPLOY if r[0].startswith('D003')])})"
ALL_SQL = FLAGS + f", every AS ({_union(SECRETS + INCOMPLETE + DEPLOY + SECURITY + DOCS, _MANY)}) "
STAGES_SQL = FLAGS + " SELECT repo_id, 'Dockerfile' AS file_path, CASE dk WHEN 2 THEN 'node' WHEN 3 THEN 'node:20' WHEN 4 THEN 'c:latest' END AS base, dk IN (2, 3) AS has_start FROM f WHERE dk > 0"
README_SQL = FLAGS + " SELECT repo_id, readme AS file_path FROM f WHERE readme IS NOT NULL"
REQUIREMENTS_SQL = FLAGS + " SELECT repo_id, 'package:python:' || unnest(['a', 'b', 'c-d']) AS fact FROM f WHERE n % 23 < 5"
COMMENTS_SQL = FLAGS + """, x AS (
    SELECT repo_id, 'src/app.js' AS file_path, 2 AS line_no, '' AS before, '// nothing' AS said FROM f WHERE js AND n % 9 >= 6
    UNION ALL SELECT repo_id, 'src/app.js', 7, '', CASE WHEN n % 13 < 5 THEN '// TODO password = "' || substr(md5(CAST(n AS VARCHAR)), 1, 12) || '"' ELSE '// fine' END FROM f WHERE js
    UNION ALL SELECT repo_id, 'src/lib.py', 2, '    return None  ', '# placeholder' FROM f WHERE n % 15 < 7 AND n % 17 >= 8
    UNION ALL SELECT repo_id, 'src/many.py', unnest(range(1, 151)), '', '# TODO' FROM f WHERE n % 59 = 1)
  SELECT repo_id, file_path, CAST(line_no AS BIGINT) AS line_no, before || repeat(' ', length(said)) AS code, said AS comment FROM x"""
CARD_SQL = FLAGS + """, s AS (
    SELECT repo_id, n % 19 = 0 AS token, 100 - (CASE WHEN n % 19 = 0 THEN 25 ELSE 0 END) - (CASE WHEN js AND n % 13 < 5 THEN 11 ELSE 0 END) - (CASE WHEN n % 20 = 7 THEN 8 ELSE 0 END) AS before FROM f)
  SELECT repo_id, CAST(before AS BIGINT) AS score_before_caps, CAST(CASE WHEN token THEN least(before, 49) ELSE before END AS BIGINT) AS score,
         CASE WHEN token THEN 'blocked' WHEN before <= 74 THEN 'warning' ELSE 'pass' END AS verdict, 'complete' AS coverage_status FROM s"""
