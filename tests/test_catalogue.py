"""Every query with SQL equals DuckDB's result at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from tallyspark.plans import catalogue, files, service, surface  # noqa: F401  (the others add their queries to the catalogue)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in a) else all(
            x == pytest.approx(y, abs=2e-5) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)
        )


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
