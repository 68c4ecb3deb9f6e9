"""Rounding follows the SQL where a value lies half-way between two multiples of 1e-6."""

import duckdb
import pytest

from tallyspark.plans import catalogue


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """32 cells with 93 counts; the largest share of the one gene is 1/2, so its signals are 93/32 * j/20."""
    folder = str(tmp_path_factory.mktemp("halves"))
    sizes = [(1, 2), (1, 3), (1, 4), (0, 1), (0, 1), (1, 5), (1, 6), (0, 2)] + [(1, 3)] * 22 + [(0, 1), (1, 2)]
    sizes[9] = (1, 3 + 93 - sum(n for _, n in sizes))
    orders, lines = [], []
    for cell, (k, n) in enumerate(sizes, 1):
        orders.append((cell, cell))
        lines += [(cell, 1 if i < k else 2) for i in range(n)]
    assert len(sizes) == 32 and len(lines) == 93
    tables = {
        "customer": ([(c, "A") for c in range(1, 33)], "c_custkey long, c_mktsegment string"), "orders": (orders, "o_orderkey long, o_custkey long"),
        "part": ([(1, "Brand#11"), (2, "Brand#12")], "p_partkey long, p_brand string"), "lineitem": (lines, "l_orderkey long, l_partkey long"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_signals_half_way_round_as_in_sql(spark, halves):
    """map_signal differs from its SQL."""
    con = duckdb.connect()
    for name in ("customer", "orders", "part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{halves}/{name}.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(catalogue.ORACLE_SQL["map_signal"]).fetchall()}
    got = {tuple(r) for r in catalogue.QUERIES["map_signal"](spark, halves).collect()}
    assert any(r[2] == 1.017187 for r in want) and got == want
