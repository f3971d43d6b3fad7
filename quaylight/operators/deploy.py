"""Readiness for deployment, D001 to D010: facts of files, folded per repository, then predicates."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.text import has_any, once
from quaylight.operators.lexer import EXCLUDED_FOLDERS, any_word
from quaylight.operators.secrets import findings_of
from quaylight.sources.files import ENV_EXAMPLES, base_name, explode_lines, in_folders, suffix
from quaylight.storage import save

# Names of files and patterns of texts.
READMES = ["readme", "readme.md", "readme.rst", "readme.txt"]
TEMPLATE_FOLDERS = "config.example config.sample config.template settings.example settings.sample env.example env.sample env.template".split()
COMPOSE_NAME = r"^(?:docker-)?compose(?:[._-][a-z0-9_-]+)?\.ya?ml$"
DEV_START = re.compile(r"\b(?:next\s+dev|vite(?:\s|$)|webpack-dev-server|nodemon|ts-node-dev|react-scripts\s+start)\b", re.I)
SERVER = r"(?i)\b(?:gunicorn|uvicorn|hypercorn|waitress-serve|waitress\.serve)\b"
ENV_DOC = r"(?i)environment\s+variables?|configuration|\.env\b|环境变量|配置变量"
DEPLOY_DOC = r"(?i)deploy(?:ment)?|production|run(?:ning)?|start|部署|生产|启动|运行"
DEPLOY_COMMAND = (
    r"(?i)npm\s+(?:run\s+)?start|pnpm\s+(?:run\s+)?start|yarn\s+start|docker\s+compose\s+up|docker-compose\s+up|gunicorn|uvicorn|hypercorn|waitress|go\s+(?:run|build)|"
    r"cargo\s+(?:run|build)|java\s+-jar|dotnet\s+(?:run|publish)|bundle\s+exec|php\s+(?:artisan|bin/console)|(?:上传|upload).{0,12}(?:部署|deploy)|云端安装依赖|"
    r"serverless\s+deploy|sls\s+deploy|firebase\s+deploy|vercel\s+deploy|wrangler\s+(?:deploy|publish)|gcloud\s+functions\s+deploy|云函数.*部署|云开发.*部署"
)
PREREQUISITES = r"(?i)prerequisites?|requirements?|before\s+you\s+begin|install(?:ation)?|requires?\s+(?:node|python|java|go|rust|ruby|php|\.net)|前置条件|安装要求|环境要求|快速开始|快速上手|quick\s+start|运行环境"
ENV_USAGE = (
    r"\bprocess\.env\.[A-Za-z_][A-Za-z0-9_]*|\bprocess\.env\s*\[|\bos\.(?:getenv|environ\.get)\s*\(|\bos\.environ\s*\[|\bSystem\.getenv\s*\(|\bEnvironment\.GetEnvironmentVariable\s*\(|"
    r"\bstd::env::var\s*\(|\bos\.Getenv\s*\(|\bENV\s*\[|(?<![.\w])getenv\s*\(|\$_(?:ENV|SERVER)\s*\["
)
NODE_LOCKS = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lock bun.lockb".split()
ROOT = "<repository>"
SNIPPET = "<repository-deployability-check>"
ECOSYSTEMS = ["dotnet", "go", "gradle", "maven", "php", "python", "ruby", "rust"]  # node goes by manifest


def is_dockerfile(name: Column) -> Column:
    return name.isin("dockerfile", "containerfile") | name.startswith("dockerfile.") | name.startswith("containerfile.")


def is_mutable_base(image: Column) -> Column:
    """No tag, or latest; scratch, digests and variables are not."""
    low = F.lower(image)
    last = F.substring_index(low, "/", -1)
    return F.coalesce((low != "") & (low != "scratch") & ~low.contains("@sha256:") & ~low.contains("$") & (~last.contains(":") | (F.substring_index(last, ":", -1) == "latest")), F.lit(False))


def user_name(value: Column) -> Column:
    return F.lower(F.substring_index(F.regexp_replace(F.trim(value), "^['\"]+|['\"]+$", ""), ":", 1))


def is_root(value: Column) -> Column:
    return F.coalesce(user_name(value).isin("root", "0"), F.lit(False))


def is_other_user(value: Column) -> Column:
    u = user_name(value)
    return F.coalesce((F.trim(value) != "") & ~u.contains("$") & ~u.isin("root", "0"), F.lit(False))


def dockerfiles(files: DataFrame) -> DataFrame:
    """repo_id, file_path, has_from, base, has_start, user of the last stage of each: stages are counted along its lines."""
    lines = explode_lines(files.where(is_dockerfile(F.lower(base_name())))).withColumn("s", F.trim("line")).where("s <> '' and not s like '#%'")
    base = F.regexp_extract("s", r"(?i)^FROM\s+(?:--\S+\s+)*([^-\s]\S*|-(?!-)\S*)", 1)
    stage = F.sum(F.col("s").rlike(r"(?i)^FROM\s+\S").cast("int")).over(Window.partitionBy("repo_id", "file_path").orderBy("line_no"))
    each = lines.withColumn("stage", stage).withColumn("_last", F.max("stage").over(Window.partitionBy("repo_id", "file_path"))).where("stage = _last")
    made = each.groupBy("repo_id", "file_path").agg(
        F.max(F.when(F.col("s").rlike(r"(?i)^FROM\s+\S"), base)).alias("base"),
        F.bool_or(F.col("s").rlike(r"(?i)^(CMD|ENTRYPOINT)\s+")).alias("has_start"),
        F.max_by(F.regexp_extract("s", r"(?i)^USER\s+(.+)$", 1), F.when(F.col("s").rlike(r"(?i)^USER\s+\S"), F.col("line_no"))).alias("user"),
    )
    every = files.where(is_dockerfile(F.lower(base_name()))).select("repo_id", "file_path")
    return every.join(made.hint("merge"), ["repo_id", "file_path"], "left").withColumn("has_from", F.coalesce(F.col("base") != "", F.lit(False))).withColumn("has_start", F.coalesce("has_start", F.lit(False)))


def compose(files: DataFrame) -> DataFrame:
    """repo_id, compose_path (first), compose_start, compose_root, compose_other, by a line and the next that isn't blank or a comment."""
    lines = explode_lines(files.where(F.lower(base_name()).rlike(COMPOSE_NAME))).withColumn("s", F.trim("line")).withColumn("indent", F.length("line") - F.length(F.ltrim("line"))).where("s <> '' and not s like '#%'")
    w = Window.partitionBy("repo_id", "file_path").orderBy("line_no")
    given = F.regexp_extract("s", r"(?i)^(?:command|entrypoint)\s*:\s*(.*)$", 1)
    start = F.col("s").rlike(r"(?i)^(command|entrypoint)\s*:") & F.when(given == "", F.coalesce(F.lead("indent").over(w) > F.col("indent"), F.lit(False))).otherwise(~F.lower(F.trim(given)).isin("[]", "{}", "null", "~"))
    user = F.when(F.col("s").rlike(r"(?i)^user\s*:\s*\S"), F.regexp_extract("s", r"(?i)^user\s*:\s*(.+)$", 1))
    each = lines.withColumn("_start", start).withColumn("_root", is_root(user)).withColumn("_other", is_other_user(user))
    return each.groupBy("repo_id").agg(F.min("file_path").alias("compose_path"), F.bool_or("_start").alias("compose_start"), F.bool_or("_root").alias("compose_root"), F.bool_or("_other").alias("compose_other"))


_PIN = re.compile(r"^[A-Za-z0-9_.-]+(?:\[[A-Za-z0-9_,.-]+\])?==[^*\s]+(?:\s|$)")
_DOTNET = re.compile(r"^[0-9]+(?:\.[0-9]+){1,3}(?:[-+][0-9A-Za-z.-]+)?$")


def read_manifest(name: str, text: str) -> dict | None:
    """Facts of a manifest or lock: ecosystem, is_manifest, has_dependencies, locked, exact, valid, start, application. None for other files."""
    out = {"ecosystem": None, "is_manifest": False, "has_dependencies": False, "locked": False, "exact": True, "valid": True, "start": False, "application": False}
    any_of = lambda data, *keys: any(isinstance(data.get(k), dict) and data[k] for k in keys)

    def parsed(kind: str):
        try:
            got = json.loads(text) if kind == "json" else tomllib.loads(text) if kind == "toml" else ET.fromstring(text)
        except (ValueError, ET.ParseError, RecursionError):
            got = None
        if got is None or (kind == "json" and not isinstance(got, dict)):
            out["valid"] = False
            return None
        return got

    locks = {"pipfile.lock": ("python", "json"), "poetry.lock": ("python", "toml"), "uv.lock": ("python", "toml"), "pdm.lock": ("python", "toml"), "cargo.lock": ("rust", "toml"), "composer.lock": ("php", "json"), "packages.lock.json": ("dotnet", "json"), "package-lock.json": ("node", "json"), "npm-shrinkwrap.json": ("node", "json"), "go.sum": ("go", ""), "gemfile.lock": ("ruby", "")}
    if name in locks or name in NODE_LOCKS:
        out["ecosystem"], kind = locks.get(name, ("node", ""))
        out["locked"] = not kind or parsed(kind) is not None
        return out
    out["is_manifest"] = True
    if name == "package.json":
        out["ecosystem"] = "node"
        if data := parsed("json"):
            out["has_dependencies"] = any_of(data, "dependencies", "devDependencies", "peerDependencies")
            scripts = data.get("scripts")
            start = scripts.get("start") if isinstance(scripts, dict) else None
            out["start"] = isinstance(start, str) and bool(start.strip()) and not DEV_START.search(start)
    elif name == "pyproject.toml":
        out["ecosystem"] = "python"
        if data := parsed("toml"):
            project, tool = data.get("project"), data.get("tool")
            poetry = tool.get("poetry", {}) if isinstance(tool, dict) else {}
            wanted = poetry.get("dependencies") if isinstance(poetry, dict) else None
            out["has_dependencies"] = bool(isinstance(project, dict) and project.get("dependencies")) or (isinstance(wanted, dict) and any(k.lower() != "python" for k in wanted))
    elif name in ("pipfile", "cargo.toml"):
        out["ecosystem"] = "python" if name == "pipfile" else "rust"
        if data := parsed("toml"):
            out["has_dependencies"] = any_of(data, *(("packages", "dev-packages") if name == "pipfile" else ("dependencies", "dev-dependencies", "build-dependencies")))
            out["application"] = name == "cargo.toml" and bool(data.get("bin"))
    elif name == "composer.json":
        out["ecosystem"] = "php"
        if data := parsed("json"):
            out["has_dependencies"] = any_of(data, "require", "require-dev")
    elif re.fullmatch(r"requirements.*\.txt", name):
        out["ecosystem"] = "python"
        active = [s.strip() for s in text.splitlines() if s.strip() and not s.lstrip().startswith(("#", "-"))]
        out["has_dependencies"] = bool(active)
        out["exact"] = all(_PIN.match(s) for s in active)
        out["locked"] = bool(active) and out["exact"]
    elif name == "go.mod":
        out["ecosystem"], out["has_dependencies"] = "go", bool(re.search(r"(?m)^\s*require(?:\s|\()", text))
    elif name == "gemfile":
        out["ecosystem"], out["has_dependencies"] = "ruby", bool(re.search(r"(?m)^\s*gem\s+['\"]", text))
    elif name in ("build.gradle", "build.gradle.kts"):
        out["ecosystem"], out["has_dependencies"] = "gradle", bool(re.search(r"(?m)^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation)\s*\(?", text))
    elif name == "pom.xml" or name.endswith((".csproj", ".fsproj", ".vbproj")):
        out["ecosystem"] = "maven" if name == "pom.xml" else "dotnet"
        root = parsed("xml")
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        wanted = [e for e in root.iter() if local(e) == ("dependency" if name == "pom.xml" else "PackageReference")] if root is not None else []
        out["has_dependencies"] = bool(wanted)
        if name != "pom.xml":
            versions = [e.attrib.get("Version") or next((c.text for c in e if local(c) == "Version"), None) for e in wanted]
            out["exact"] = all(v and _DOTNET.match(v.strip()) for v in versions)
    else:
        return None
    return out


MANIFEST_NAME = r"^(package\.json|pyproject\.toml|pipfile|requirements.*\.txt|go\.mod|cargo\.toml|gemfile|composer\.json|pom\.xml|build\.gradle(\.kts)?|.*\.(cs|fs|vb)proj|package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?|pipfile\.lock|poetry\.lock|uv\.lock|pdm\.lock|go\.sum|cargo\.lock|gemfile\.lock|composer\.lock|packages\.lock\.json)$"


def manifests(files: DataFrame) -> DataFrame:
    """Facts of manifests and locks. Only they reach Python, for TOML and XML, which Spark has no tolerant reader of."""
    names = ["ecosystem", "is_manifest", "has_dependencies", "locked", "exact", "valid", "start", "application"]
    schema = pa.schema([("repo_id", pa.string()), ("file_path", pa.string()), ("ecosystem", pa.string()), *((n, pa.bool_()) for n in names[1:])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, text in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "file_path", "content"))):
                if facts := read_manifest(path.rsplit("/", 1)[-1].lower(), text or ""):
                    rows.append({"repo_id": repo, "file_path": path} | facts)
            yield pa.RecordBatch.from_pylist(rows, schema)

    some = files.where(F.lower(base_name()).rlike(MANIFEST_NAME)).select("repo_id", "file_path", F.col("content").cast("string").alias("content"))
    return some.mapInArrow(run, "repo_id string, file_path string, ecosystem string, " + ", ".join(f"{n} boolean" for n in names[1:]))


def _folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def unlocked(facts: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(repo_id, file_path) of D003: Node manifests without a lock in their own folder, and for others the first manifest of an unlocked ecosystem."""
    node = facts.where("ecosystem = 'node'").withColumn("folder", _folder(F.col("file_path")))
    bare = node.where("is_manifest and has_dependencies").join(node.where("locked").select("repo_id", "folder").distinct().hint("merge"), ["repo_id", "folder"], "left_anti").select("repo_id", "file_path")
    is_m, req = F.col("is_manifest"), F.lower(base_name()).rlike(r"^requirements.*\.txt$")
    eco = facts.where(F.col("ecosystem").isin(ECOSYSTEMS)).groupBy("repo_id", "ecosystem").agg(
        F.min(F.when(is_m, F.col("file_path"))).alias("file_path"), F.bool_or("has_dependencies").alias("wanted"), F.bool_or(F.col("locked") & ~is_m).alias("lock"),
        F.coalesce(F.bool_and(F.when(req & F.col("has_dependencies"), F.col("exact"))), F.lit(False)).alias("pinned"), F.bool_and("exact").alias("exact"), F.bool_or("application").alias("app"),
    ).join(wrappers.hint("merge"), "repo_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    locked = (
        F.when(F.col("ecosystem") == "python", F.col("lock") | F.col("pinned"))
        .when(F.col("ecosystem") == "rust", F.col("lock") | ~(F.col("app") | yes("rust_main")))
        .when(F.col("ecosystem") == "maven", yes("mvn_script") & yes("mvn_config"))
        .when(F.col("ecosystem") == "gradle", yes("gradle_script") & yes("gradle_config"))
        .when(F.col("ecosystem") == "dotnet", F.col("lock") | F.col("exact"))
        .otherwise(F.col("lock"))
    )
    return bare.union(eco.where(F.col("wanted") & ~locked).select("repo_id", "file_path"))


def is_named(path: str = "file_path") -> Column:
    """Files whose text says something by their name: READMEs, manifests, container files, examples of settings."""
    name = F.lower(base_name(path))
    return name.isin("procfile", *READMES, *ENV_EXAMPLES) | is_dockerfile(name) | name.rlike(COMPOSE_NAME) | name.rlike(MANIFEST_NAME) | in_template(path)


def in_template(path: str = "file_path") -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEMPLATE_FOLDERS)))


def _main() -> Column:
    bare, ext = F.col("bare"), suffix()
    return ((ext == ".go") & bare.rlike(r"\bfunc\s+main\s*\(")) | ((ext == ".java") & bare.rlike(r"\bstatic\s+void\s+main\s*\(")) | (ext.isin(".kt", ".kts") & bare.rlike(r"\bfun\s+main\s*\("))


# Words without one of which a line of source shows nothing, in lower case.
WORDS = ["env", "$_", "main"]
#: A pattern for lexer.lex() that any text has in which some rule finds something.
MAY_HAVE = any_word(WORDS)


def may_have(lowered: Column) -> Column:
    """False only for sources, in lower case, that show nothing to the rules."""
    return has_any(lowered, WORDS)


def relevant() -> Column:
    """Lexed lines that the rules need."""
    return once(F.lower("bare"), may_have) & (F.col("bare").rlike(ENV_USAGE) | _main())


#: What is known of a repository: whether something is there, and the first path of some kinds. Merged by or and by least.
FLAGS = "doc command needs env_doc start main script docker docker_start compose_start compose_root compose_other rust_main mvn_script mvn_config gradle_script gradle_config".split()
FIRST_PATHS = ["readme", "env_path", "compose_path"]


def state(files: DataFrame, lexed: DataFrame, facts: DataFrame, docker: DataFrame) -> DataFrame:
    """A row for each repository of files: FLAGS and FIRST_PATHS, from one fold over partial rows of files, lines, manifests and container files."""
    own = files.where(~in_folders("file_path", EXCLUDED_FOLDERS, lower=True))
    name, low, text, path = F.lower(base_name()), F.lower("file_path"), F.col("content").cast("string"), F.col("file_path")
    readme = name.isin(READMES)
    env_doc = (readme & text.rlike(ENV_DOC)) | (name.isin(ENV_EXAMPLES) & text.rlike(r"(?m)^\s*[A-Za-z_][A-Za-z0-9_]*\s*=")) | (in_template() & text.rlike(r"\S"))
    starts = (
        (readme & text.rlike(SERVER)) | ((name == "procfile") & text.rlike(r"(?im)^\s*web\s*:\s*\S")) | low.rlike(r"(^|/)src/main\.rs$") | (name == "config.ru") | low.rlike(r"/bin/rails$")
        | (name == "artisan") | low.rlike(r"(^|/)public/index\.php$") | low.rlike(r"(^|/)bin/console$") | (name == "program.cs")
    )
    shown = own.select(
        "repo_id", F.when(readme, path).alias("readme"), (readme & text.rlike(DEPLOY_DOC)).alias("doc"), (readme & text.rlike(DEPLOY_COMMAND)).alias("command"),
        (readme & text.rlike(PREREQUISITES)).alias("needs"), env_doc.alias("env_doc"), starts.alias("start"),
        low.rlike(r"(^|/)src/main\.rs$").alias("rust_main"), name.isin("mvnw", "mvnw.cmd").alias("mvn_script"), low.rlike(r"(^|/)\.mvn/wrapper/maven-wrapper\.properties$").alias("mvn_config"),
        name.isin("gradlew", "gradlew.bat").alias("gradle_script"), low.rlike(r"(^|/)gradle/wrapper/gradle-wrapper\.properties$").alias("gradle_config"),
    )
    code = lexed.select("repo_id", F.when(F.col("bare").rlike(ENV_USAGE), path).alias("env_path"), _main().alias("main"))
    parts = [files.select("repo_id").distinct(), shown, code, docker.select("repo_id", F.lit(True).alias("docker"), F.col("has_start").alias("docker_start")), facts.select("repo_id", F.col("start").alias("script")), compose(own)]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    return rows.groupBy("repo_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in FLAGS], *[F.min(c).alias(c) for c in FIRST_PATHS])


def scan(files: DataFrame, lexed: DataFrame) -> DataFrame:
    """All D findings of the repositories in files (repo_id, file_path, content as text); lexed has the relevant() lines at least. Both are read several times, so they should be saved tables.

    Only is_named() files need their content.
    """
    own = files.where(~in_folders("file_path", EXCLUDED_FOLDERS, lower=True))
    facts, docker = save(manifests(own)), save(dockerfiles(own))
    r = save(state(files, lexed, facts, docker))
    yes = {c: F.col(c) for c in [*FLAGS, *FIRST_PATHS]}
    documented = yes["readme"].isNotNull() & yes["doc"] & yes["command"] & yes["needs"]
    has_compose = yes["compose_path"].isNotNull()
    only = has_compose & ~yes["docker"]
    user_bad = is_root(F.col("user")) | yes["compose_root"] | ~(is_other_user(F.col("user")) | yes["compose_other"])
    none, path, root = F.lit(None).cast("long"), F.col("file_path"), F.lit(ROOT)

    def broken(rows: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
        """(repo_id, rule, file_path): a row for each rule that a row breaks."""
        each = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), at.alias("at"))) for rule, bad, at in rules]))
        return rows.select("repo_id", F.explode(each).alias("x")).select("repo_id", "x.rule", F.col("x.at").alias("file_path"))

    of_repository = [
        ("D001", ~(yes["start"] | yes["main"] | yes["script"] | yes["docker_start"] | yes["compose_start"] | documented), root),
        ("D002", yes["env_path"].isNotNull() & ~yes["env_doc"], yes["env_path"]),
        ("D004", ~documented, F.coalesce("readme", root)),
        ("D005", ~yes["docker"] & ~has_compose, root),
        ("D008", only & (yes["compose_root"] | ~yes["compose_other"]), yes["compose_path"]),
        ("D009", only & ~yes["compose_start"], yes["compose_path"]),
    ]
    of_dockerfile = [
        ("D006", ~F.col("has_from"), path),
        ("D007", F.col("has_from") & is_mutable_base(F.col("base")), path),
        ("D008", F.col("has_from") & user_bad, path),
        ("D009", F.col("has_from") & ~F.col("has_start") & ~yes["compose_start"], path),
    ]
    found = broken(r, of_repository)
    found = found.unionByName(broken(docker.join(r.select("repo_id", "compose_start", "compose_root", "compose_other").hint("merge"), "repo_id"), of_dockerfile))
    found = found.unionByName(broken(facts, [("D010", ~F.col("valid"), path)])).unionByName(unlocked(facts, r).withColumn("rule", F.lit("D003")))
    at = found.select("repo_id", "file_path", none.alias("line_no"), none.alias("start"), none.alias("end"), F.lit(SNIPPET).alias("line"), "rule")
    return findings_of(at, [f"D{k:03d}" for k in range(1, 11)])
