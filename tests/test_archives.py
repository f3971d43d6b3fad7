"""Archives that are refused before they are read, or while."""

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from quaylight import vocabulary as V
from quaylight.sources import files as S


def tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def rows(spark, *archives):
    return spark.createDataFrame([(str(i), bytearray(a)) for i, a in enumerate(archives)], "repo_id string, content binary")


def test_reading_ends_where_a_limit_is_broken(spark, monkeypatch):
    many = [(f"f{i:05d}", b"x") for i in range(V.MAX_FILES + 500)]
    for archive in (tar(many), packed(many)):
        got = S.archive_members(rows(spark, archive)).collect()
        assert len(got) == V.MAX_FILES + 1
        assert [r["breach"] for r in S.admitted(S.archive_members(rows(spark, archive))).where("breach is not null").collect()] == ["file_count"]
    large = packed([("a", b"x" * (V.MAX_FILE_BYTES + 5)), ("b", b"y")])  # small when packed
    assert len(large) < 1 << 20
    got = S.admitted(S.archive_members(rows(spark, large))).select("name", "size", "breach").collect()
    assert [tuple(r) for r in got] == [("a", V.MAX_FILE_BYTES + 1, "file_size")]
    sum_ = packed([(f"f{i}", b"z" * V.MAX_FILE_BYTES) for i in range(12)])
    assert [r["breach"] for r in S.admitted(S.archive_members(rows(spark, sum_)).drop("content")).orderBy("member_no").collect()] == [None] * 8 + ["total_size"]


def test_uploads_are_refused_by_name_kind_and_size(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_ARCHIVE_BYTES", 2000)
    z, t = packed([("a", b"x")]), tar([("a", b"x")])
    cases = [("a.zip", z, None), (" A.ZIP ", z, None), ("a.tgz", t, None), ("a.tar.gz", t, None), ("a.zip", t, "magic"), ("a.tar.gz", z, "magic"), ("a.rar", z, "suffix"), ("", z, "name"), (None, z, "name"), ("a.zip", b"PK", "magic"), ("a.zip", z + b"0" * 2000, "archive_size"), ("a.zip", None, "magic")]
    data = spark.createDataFrame([(i, n, None if c is None else bytearray(c)) for i, (n, c, _) in enumerate(cases)], "i int, name string, content binary")
    assert [r["why"] for r in data.select("i", S.upload_refused("name", F.col("content")).alias("why")).orderBy("i").collect()] == [w for _, _, w in cases]
