"""Folders of repositories as a data source of Spark: spark.read.format("tree").load(folder).

Every child of the folder is a repository, or the folder itself is one if the option repo_id names it. The driver lists only the
first two levels, for the partitions; each task walks its own part of a repository and reads its files. The folder is a path that
all executors mount. Links are never followed and give no rows; a file that resolves to a place outside of its repository
gives a row without its name.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from quaylight import vocabulary as V
from quaylight.sources.files import BINARY_SUFFIXES, IGNORED_FOLDERS

SCHEMA = "repo_id string, file_path string, content binary, length bigint, reason string"
OUTSIDE = "<outside_root>"
#: Bytes of content in a batch; one larger file is a batch alone.
BATCH_BYTES = 4 << 20


@dataclass
class Part(InputPartition):
    """A folder right below a repository's root with all below it, or the root's own files (top is empty)."""

    repo_id: str
    root: str
    top: str


def inside(path: str, root: str) -> str | None:
    """The path from a resolved root to where a file really is, or None if that is elsewhere or can't be told."""
    try:
        return Path(path).resolve().relative_to(root).as_posix()
    except (ValueError, OSError, RuntimeError):
        return None


def folders(path: str) -> list[str]:
    """Names of the folders in a folder that are walked, in order: no links, none of the ignored ones."""
    try:
        with os.scandir(path) as found:
            return sorted(e.name for e in found if e.name not in IGNORED_FOLDERS and e.is_dir(follow_symlinks=False))
    except OSError:
        return []


def walk(part: Part) -> Iterator[str]:
    """Paths of the files of a part that are no links, in the order of their names, folder by folder."""
    start = os.path.join(part.root, part.top) if part.top else part.root
    for at, below, names in os.walk(start):
        below[:] = [] if not part.top else [d for d in sorted(below) if d not in IGNORED_FOLDERS and not os.path.islink(os.path.join(at, d))]
        yield from (p for p in (os.path.join(at, n) for n in sorted(names)) if not os.path.islink(p))


def row(repo_id: str, path: str, root: str) -> tuple:
    """What SCHEMA has of a file. It is read only if its size and suffix allow; a reason says why it has no content."""
    name = inside(path, root)
    if name is None:
        return repo_id, OUTSIDE, None, None, "outside_root"
    try:
        size = os.path.getsize(path)
    except OSError:
        return repo_id, name, None, None, "stat_error"
    if size > V.MAX_SCANNED_BYTES:
        return repo_id, name, None, size, "too_large"
    if os.path.splitext(path)[1].lower() in BINARY_SUFFIXES:
        return repo_id, name, None, size, "binary"
    try:
        with open(path, "rb") as f:
            return repo_id, name, f.read(V.MAX_SCANNED_BYTES + 1), size, None
    except OSError:
        return repo_id, name, None, size, "read_error"


class TreeReader(DataSourceReader):
    def __init__(self, folder: str, repo_id: str | None):
        self.folder, self.repo_id, self.only = folder, repo_id, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """One repository by its name needs no listing of the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("repo_id",):
                self.only = f.value if self.only in (None, f.value) else ""
            else:
                yield f

    def partitions(self) -> list[Part]:
        if self.repo_id:
            roots = [(self.repo_id, self.folder)]
        else:
            roots = [(name, os.path.join(self.folder, name)) for name in folders(self.folder) if self.only in (None, name)]
        roots = [(name, str(Path(path).resolve())) for name, path in roots if self.only in (None, name)]
        return [Part(name, root, top) for name, root in roots for top in ("", *folders(root))]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        held, size = [], 0
        for path in walk(part):
            held.append(row(part.repo_id, path, part.root))
            size += len(held[-1][2] or b"") + 256
            if size >= BATCH_BYTES:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        if not self.options.get("path"):
            raise ValueError("load() needs a folder")
        return TreeReader(self.options["path"].removeprefix("file://"), self.options.get("repo_id"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
