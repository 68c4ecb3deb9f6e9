import pytest
from pyspark.sql import functions as F

from tallyspark.operators import lists as L


def gene_lists(spark, *lists):
    rows = [(i, p, g) for i, x in enumerate(lists) for p, g in enumerate(x)]
    return spark.createDataFrame(rows, "list_no int, pos long, gene_id string")


def names(spark, *xs):
    return spark.createDataFrame([*enumerate(xs)], "pos long, gene_id string")


def order(df):
    return [r["gene_id"] for r in df.orderBy("pos").collect()]


def test_rank_sum(spark):
    assert order(L.rank_sum(gene_lists(spark, ["g1", "g2", "g3"], ["g2", "g3", "g4"]))) == ["g2", "g1", "g3", "g4"]


def test_slice_after_intersecting_and_excluding(spark):
    out = L.sliced(names(spark, "g1", "g2", "g3", "g4"), start=1, top=2, only=names(spark, "g2", "g3", "g4"), but=names(spark, "g4"))
    assert order(out) == ["g3"]
    with pytest.raises(ValueError):
        L.sliced(names(spark, "g1"), start=2, end=1)


def test_filter_that_removes_all_raises(spark):
    with pytest.raises(ValueError, match="removed all genes"):
        L.filtered(names(spark, "MALAT1"), L.RULES["human"])


def test_strict_subset(spark):
    with pytest.raises(ValueError):
        L.subset_strict(names(spark, "a", "x"), names(spark, "a"))
    assert order(L.subset_strict(names(spark, "a", "x"), names(spark, "a"), strict=False)) == ["a"]


def test_search_orders_by_total(spark):
    totals = spark.createDataFrame([("GeneA", 5), ("GeneB", 10), ("other", 1)], "gene_id string, total long")
    assert [r[0] for r in L.search(totals, "gene", 2).collect()] == ["GeneB", "GeneA"]


def test_universe_modes(spark):
    x = gene_lists(spark, ["a", "b"], ["b", "c"])
    assert order(L.universe(x, "intersection")) == ["b"] and order(L.universe(x, "union")) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        L.universe(x, "exact")


def test_page_clamps(spark):
    rows = spark.range(7).select(F.col("id").cast("string").alias("gene_id"))
    assert [r["gene_id"] for r in L.page(rows, [F.asc("gene_id")], 9, 3).collect()] == ["6"]
