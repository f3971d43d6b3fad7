"""The folder source on trees with links, ignored folders, large and binary files."""

import os

import pytest

from quaylight import vocabulary as V
from quaylight.operators import whole
from quaylight.sources import tree


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("repos")
    texts = {
        "one/README.md": "# One\n", "one/src/b.py": "breakpoint()\n", "one/src/a.py": "x = 1\n", "one/src/deep/er/c.py": "y\n", "one/node_modules/x.js": "no", "one/src/.git/config": "no", "one/img/p.PNG": "no text",
        "one/big.txt": "x" * (V.MAX_SCANNED_BYTES + 1), "one/full.txt": "x" * V.MAX_SCANNED_BYTES, "one/empty": "", "two/main.go": "package main\n", "two/ü ñ/z.txt": "z", "loose.txt": "of no repository", "vendor/lib/x.py": "no",
    }
    for path, text in texts.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    os.symlink(base / "two", base / "one/linked")
    os.symlink(base / "two/main.go", base / "one/src/linked.go")
    os.symlink("/nowhere", base / "one/broken")
    os.symlink(base / "one", base / "three")
    return str(base)


def test_rows_of_a_tree(spark, folder):
    tree.register(spark)
    rows = spark.read.format("tree").load(folder).collect()
    got = {(r["repo_id"], r["file_path"]): (None if r["content"] is None else len(r["content"]), r["length"], r["reason"]) for r in rows}
    assert len(got) == len(rows) and got == {
        ("one", "README.md"): (6, 6, None), ("one", "src/a.py"): (6, 6, None), ("one", "src/b.py"): (13, 13, None), ("one", "src/deep/er/c.py"): (2, 2, None), ("one", "img/p.PNG"): (None, 7, "binary"),
        ("one", "big.txt"): (None, V.MAX_SCANNED_BYTES + 1, "too_large"), ("one", "full.txt"): (V.MAX_SCANNED_BYTES, V.MAX_SCANNED_BYTES, None), ("one", "empty"): (0, 0, None),
        ("two", "main.go"): (13, 13, None), ("two", "ü ñ/z.txt"): (1, 1, None),
    }
    assert [(r["repo_id"], r["file_path"]) for r in rows] == [(r["repo_id"], r["file_path"]) for r in spark.read.format("tree").load(folder).collect()]


def test_one_repository_by_option_or_filter(spark, folder):
    tree.register(spark)
    assert sorted(r["file_path"] for r in spark.read.format("tree").option("repo_id", "r").load(f"{folder}/two").collect()) == ["main.go", "ü ñ/z.txt"]
    reader = tree.TreeReader(folder, None)
    other = tree.EqualTo(("file_path",), "main.go")
    assert list(reader.pushFilters([tree.EqualTo(("repo_id",), "two"), other])) == [other]
    assert {p.repo_id for p in reader.partitions()} == {"two"}
    assert {r["repo_id"] for r in spark.read.format("tree").load(folder).where("repo_id = 'two'").collect()} == {"two"}


def test_parts_cover_a_tree_once(folder):
    parts = tree.TreeReader(folder, None).partitions()
    paths = [p for part in parts for p in tree.walk(part)]
    assert len(paths) == len(set(paths)) == 10 and [(p.repo_id, p.top) for p in parts] == [("one", ""), ("one", "img"), ("one", "src"), ("two", ""), ("two", "ü ñ")]


def test_files_elsewhere_and_files_that_went_are_told_apart(folder, tmp_path):
    assert tree.row("r", f"{folder}/two/main.go", f"{folder}/one") == ("r", tree.OUTSIDE, None, None, "outside_root")
    assert tree.row("r", f"{folder}/one/gone.py", f"{folder}/one") == ("r", "gone.py", None, None, "stat_error")
    assert tree.row("r", f"{folder}/one/src", f"{folder}/one")[4] == "read_error"


def test_a_scan_keeps_what_the_source_tells(spark, folder):
    tree.register(spark)
    found, walked = whole.scan(spark.read.format("tree").load(folder))
    totals = {r["repo_id"]: r for r in whole.totals(walked).collect()}
    assert (totals["one"]["total_files_scanned"], totals["one"]["total_skipped_files"], totals["two"]["total_files_scanned"]) == (6, 2, 2)
    assert [r["file_path"] for r in found.where("rule_id like 'I004%'").collect()] == ["src/b.py"]
