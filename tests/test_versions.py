"""Tables that are replaced together, and the coordinate data source."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import coordinate, versions


def test_readers_see_one_write_or_the_other(spark, tmp_path):
    path = str(tmp_path / "m")

    def writes(n, fail=False):
        def write(folder):
            spark.range(n).write.parquet(f"{folder}/counts")
            if fail:
                raise RuntimeError("lost between two tables")
            spark.range(n).write.parquet(f"{folder}/obs")

        return write

    sizes = lambda: tuple(spark.read.parquet(f"{versions.current(spark, path)}/{t}").count() for t in ("counts", "obs"))
    assert versions.current(spark, path) == path
    first = versions.commit(spark, path, writes(3))
    assert sizes() == (3, 3)
    with pytest.raises(RuntimeError, match="lost"):
        versions.commit(spark, path, writes(5, fail=True))
    assert sizes() == (3, 3) and len(list((tmp_path / "m").glob("version-*"))) == 1
    versions.commit(spark, path, writes(5))
    assert sizes() == (5, 5) and spark.read.parquet(f"{first}/obs").count() == 3  # a reader that began earlier
    versions.commit(spark, path, writes(7))
    assert sizes() == (7, 7) and len(list((tmp_path / "m").glob("version-*"))) == 2


def test_the_second_of_two_writes_at_once_raises(spark, tmp_path):
    path = str(tmp_path / "m")

    def slow(folder):
        spark.range(1).write.parquet(f"{folder}/counts")
        versions.commit(spark, path, lambda f: spark.range(2).write.parquet(f"{f}/counts"))

    with pytest.raises(RuntimeError, match="came first"):
        versions.commit(spark, path, slow)
    assert spark.read.parquet(f"{versions.current(spark, path)}/counts").count() == 2
    with pytest.raises(ValueError):
        versions.commit(spark, path, slow, keep=0)


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(3)
    return sorted({(rng.randrange(40), rng.randrange(900)): round(rng.random(), 3) for _ in range(3000)}.items())


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
def test_coordinate_source(spark, tmp_path, entries, size):
    lines = ["%%MatrixMarket matrix coordinate real general", "% note", "", f"40 900 {len(entries)}"] + [f"{g + 1} {c + 1} {v}" for (g, c), v in entries]
    (tmp_path / "m.mtx").write_text("\n".join(lines) + ("\n" if size > 97 else ""))
    coordinate.register(spark)
    read = spark.read.format("coordinate").option("rangeBytes", size).load(str(tmp_path / "m.mtx"))
    assert sorted(((r["gene"], r["cell"]), r["value"]) for r in read.collect()) == entries
    some = read.filter((F.col("gene") == 7) & (F.col("cell") >= 100) & (F.col("value") > 0.5))
    assert sorted(((r["gene"], r["cell"]), r["value"]) for r in some.collect()) == [x for x in entries if x[0][0] == 7 and x[0][1] >= 100 and x[1] > 0.5]
    assert read.filter(F.col("gene").isin(1, 2)).count() == sum(g in (1, 2) for (g, _), _ in entries)
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.split("\n") if "Filter" in line]
    assert left and not any("= 7" in line or ">= 100" in line for line in left) and any("0.5" in line for line in left)


def test_coordinate_folder_and_faults(spark, tmp_path):
    coordinate.register(spark)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0").write_text("%%M\n2 2 3\n1 1 1\n")
    (tmp_path / "d" / "part-1").write_text("2 1 4\n2 2 5")
    assert spark.read.format("coordinate").load(str(tmp_path / "d")).agg(F.sum("value")).first()[0] == 10
    (tmp_path / "none.mtx").write_text("%%M\n2 2 0\n")
    assert spark.read.format("coordinate").load(str(tmp_path / "none.mtx")).count() == 0
    (tmp_path / "bad.mtx").write_text("%%M\n2 2 1\n1 1\n")
    for path in ("bad.mtx", "missing.mtx"):
        with pytest.raises(Exception):
            spark.read.format("coordinate").load(str(tmp_path / path)).collect()
