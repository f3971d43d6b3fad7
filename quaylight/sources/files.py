"""The files relation (repo_id, file_path, content, length): from folders, archives and text tables; eligibility; lines."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quaylight import vocabulary as V

# Folders that are never walked; suffixes of binary files; names that neither a repository nor its owner can have.
IGNORED_FOLDERS = "node_modules .next dist build coverage __pycache__ .git vendor .venv venv .pytest_cache .mypy_cache .idea .vscode".split()
BINARY_SUFFIXES = (
    ".png .jpg .jpeg .gif .bmp .ico .webp .zip .tar .gz .tgz .bz2 .xz .7z .rar .exe .dll .so .dylib .o .a .lib .pyc .pyo .class .jar .war "
    ".pdf .doc .docx .xls .xlsx .mp3 .mp4 .avi .mov .mkv .wav .flv .ttf .otf .woff .woff2 .eot .sqlite .db .db3 .s3db"
).split()
RESERVED_NAMES = (
    "settings orgs users search explore topics trending collections events sponsors marketplace new notifications login signup sessions about pricing "
    "security customer-stories readme enterprise"
).split()
ENV_EXAMPLES = [".env.example", ".env.sample", ".env.template"]
#: Where lines end: LF, CR LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def folder_files(spark: SparkSession, folder: str, repo_id: str) -> DataFrame:
    """Every file below a folder, path relative to it, but those in ignored folders. Content is read only where it is used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    return raw.select(F.lit(repo_id).alias("repo_id"), path.alias("file_path"), "content", "length").where(~in_folders("file_path", IGNORED_FOLDERS))


def in_folders(path: str | Column, names: list[str], lower: bool = False) -> Column:
    """Whether any folder of a path is one of the names; the last part is the file's own."""
    p = F.split(F.lower(path) if lower else (F.col(path) if isinstance(path, str) else path), "/")
    return F.arrays_overlap(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def base_name(path: str | Column = "file_path") -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: str | Column = "file_path") -> Column:
    """Lower-case suffix with its dot; none for names that only begin with one."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def archive_kind(content: Column) -> Column:
    return F.when(F.startswith(content, F.lit(b"PK\x03\x04")), "zip").when(F.startswith(content, F.lit(b"\x1f\x8b")), "gzip")


def upload_refused(name: str | Column, content: Column) -> Column:
    """Why an uploaded archive isn't opened, or null: no name, a suffix of no known kind, bytes of another kind than the suffix says, or too many of them."""
    low = F.lower(F.trim(F.col(name) if isinstance(name, str) else name))
    said = F.when(low.endswith(".zip"), "zip").when(low.endswith(".tar.gz") | low.endswith(".tgz"), "gzip")
    fits = F.coalesce(archive_kind(content) == said, F.lit(False))
    return F.when(F.coalesce(low, F.lit("")) == "", "name").when(said.isNull(), "suffix").when(~fits, "magic").when(F.octet_length(content) > V.MAX_ARCHIVE_BYTES, "archive_size")


def unsafe_member(name: str | Column) -> Column:
    """Why a member's name is refused, or null."""
    n = F.col(name) if isinstance(name, str) else name
    return (
        F.when(n.contains("\x00"), "nul")
        .when(n.contains("\\"), "backslash")
        .when(n.startswith("/"), "absolute")
        .when(n.rlike("^[A-Za-z]:"), "drive")
        .when(F.array_contains(F.split(n, "/"), ".."), "parent")
        .when(n.rlike("[\\x01-\\x08\\x0a-\\x1f\\x7f]"), "control")
    )


def archive_members(archives: DataFrame) -> DataFrame:
    """(repo_id, member_no, name, kind, size, content) of tar.gz and zip archives given as (repo_id, content).

    kind is file, folder, link or other. A member's content is read only if it is a file within the size limit. A
    broken archive gives one row of kind broken, after the members before the break. Reading ends with the member that
    brings an archive over the limit of files or bytes, since admitted() refuses it whole: what follows isn't unpacked.
    """

    def members(raw: bytes) -> Iterator[tuple[str, str, int, bytes | None]]:
        if raw[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for m in z.infolist():
                    kind = "folder" if m.is_dir() else "link" if m.external_attr >> 28 == 0xA else "file"
                    data = None
                    if kind == "file":
                        with z.open(m) as f:
                            data = f.read(V.MAX_FILE_BYTES + 1)
                    yield m.filename, kind, len(data or b""), data
        elif raw[:2] == b"\x1f\x8b":
            with tarfile.open(fileobj=io.BytesIO(raw), mode="r|gz") as t:
                for m in t:
                    kind = "file" if m.isreg() else "folder" if m.isdir() else "link" if m.issym() or m.islnk() else "other"
                    yield m.name, kind, m.size, t.extractfile(m).read() if kind == "file" and m.size <= V.MAX_FILE_BYTES else None
        else:
            raise ValueError("neither zip nor gzip")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("repo_id", pa.string()), ("member_no", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            for repo, raw in zip(batch.column("repo_id").to_pylist(), batch.column("content").to_pylist()):
                no = files = total = 0
                try:
                    for name, kind, size, data in members(raw or b""):
                        yield pa.RecordBatch.from_pylist([{"repo_id": repo, "member_no": no, "name": name, "kind": kind, "size": size, "content": data}], schema)
                        no, files, total = no + 1, files + (kind == "file"), total + (size if kind == "file" else 0)
                        if files > V.MAX_FILES or total > V.MAX_TOTAL_BYTES or size > V.MAX_FILE_BYTES:
                            break
                except (ValueError, OSError, EOFError, tarfile.TarError, zipfile.BadZipFile, NotImplementedError):
                    yield pa.RecordBatch.from_pylist([{"repo_id": repo, "member_no": no, "name": None, "kind": "broken", "size": 0, "content": None}], schema)

    return archives.select("repo_id", "content").mapInArrow(run, "repo_id string, member_no long, name string, kind string, size long, content binary")


def admitted(members: DataFrame) -> DataFrame:
    """Members and breach: the first rule that each breaks, by running totals of its archive. An archive with any is refused whole."""
    w = Window.partitionBy("repo_id").orderBy("member_no").rowsBetween(Window.unboundedPreceding, 0)
    is_file = F.col("kind") == "file"
    breach = (
        F.when(F.col("kind") == "broken", "broken")
        .when(~F.col("kind").isin("file", "folder"), "type")
        .when(unsafe_member("name").isNotNull(), F.concat(F.lit("name_"), unsafe_member("name")))
        .when(F.col("size") > V.MAX_FILE_BYTES, "file_size")
        .when(F.sum(is_file.cast("long")).over(w) > V.MAX_FILES, "file_count")
        .when(F.sum(F.when(is_file, F.col("size")).otherwise(0)).over(w) > V.MAX_TOTAL_BYTES, "total_size")
    )
    return members.withColumn("breach", breach)


def repository_address(url: str | Column) -> Column:
    """struct<owner, repo> of https://github.com/{owner}/{repo}, or null for any other address."""
    u = F.trim(F.col(url) if isinstance(url, str) else url)
    form = r"^https://github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}[A-Za-z0-9])?)/([A-Za-z0-9._-]+?)(?:\.git)?/?$"
    owner, repo = F.regexp_extract(u, form, 1), F.regexp_extract(u, form, 2)
    return F.when((owner != "") & ~F.lower(owner).isin(RESERVED_NAMES) & ~F.lower(repo).isin(RESERVED_NAMES), F.struct(owner.alias("owner"), repo.alias("repo")))


def allowed_redirect(url: str | Column) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce((F.try_parse_url(u, F.lit("PROTOCOL")) == "https") & F.try_parse_url(u, F.lit("HOST")).isin("github.com", "codeload.github.com", "api.github.com", "objects.githubusercontent.com"), F.lit(False))


def reason_skipped() -> Column:
    """Why a file of (file_path, length, content) isn't scanned, in the order of the tests, or null."""
    known = suffix().isin(BINARY_SUFFIXES)
    return (
        F.when(F.col("length") > V.MAX_SCANNED_BYTES, "too_large")
        .when(known, "binary")
        .when(F.col("content").isNull(), "read_error")
        .when(F.col("content").cast("string").contains("\x00"), "binary")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "binary")
    )


#: One-character line ends but the line feed itself.
_OTHER_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def _has_other_ends(text: Column) -> Column:
    other = text.contains(_OTHER_ENDS[0])
    for end in _OTHER_ENDS[1:]:
        other = other | text.contains(end)
    return other


def _same_ends(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), _OTHER_ENDS, "\n" * len(_OTHER_ENDS))


def _plain_ends(text: Column) -> Column:
    """A text without its byte order mark, whose lines all end with a line feed. Each step is written once, as Spark works out again what stands twice."""
    bare = F.when(text.startswith("\ufeff"), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    return F.when(_has_other_ends(text), _same_ends(bare)).otherwise(bare)


def lines_of(text: Column) -> Column:
    """Lines of a text without its byte order mark; no empty line after the last end."""
    parts = F.split(_plain_ends(text), "\n", -1)
    # inside an array of one, so that the text is split once
    return F.get(F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)), F.lit(0))


def line_count(text: Column) -> Column:
    """How many lines lines_of() gives, by lengths alone."""
    feeds = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
    same = _same_ends(text)
    mixed = feeds(same) + F.when(same.endswith("\n"), 0).otherwise(1)
    plain = feeds(text) + F.when(text.isin("", "\ufeff") | text.endswith("\n"), 0).otherwise(1)
    return F.when(_has_other_ends(text), mixed).otherwise(plain).cast("long")


def explode_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """(repo_id, file_path, line_no from 1, line)."""
    return files.select("repo_id", "file_path", F.posexplode(lines_of(F.col(text).cast("string"))).alias("at", "line")).select("repo_id", "file_path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def paths_and_parents(files: DataFrame, once: bool = True) -> DataFrame:
    """(repo_id, path, is_folder): every file and every folder above one, each once; else a folder for each file below it."""
    p = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))
    up = files.select("repo_id", F.explode(F.when(F.size(p) > 1, above)).alias("path"), F.lit(True).alias("is_folder"))
    every = files.select("repo_id", F.col("file_path").alias("path"), F.lit(False).alias("is_folder")).union(up)
    return every.distinct() if once else every


def folder_stats(files: DataFrame) -> DataFrame:
    """repo_id, file_count, total_size, top_level_dir (the first by name)."""
    top = F.when(F.instr("file_path", "/") > 0, F.substring_index("file_path", "/", 1))
    return files.groupBy("repo_id").agg(F.count("*").alias("file_count"), F.sum("length").cast("long").alias("total_size"), F.min(top).alias("top_level_dir"))
