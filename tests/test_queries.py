"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: v for k, v in entry.oracle_sql().items() if k.startswith("q_")}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(OWN[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(repr([plain(dict(zip(columns, r))[c]) for c in order]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in got.collect()) == want


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["repo_id", "score_before_caps", "score", "verdict", "coverage_status", "coverage_reasons"]
    assert out.count() == 20
