import pytest

from tallyspark.sources import matrices as D
from tallyspark.operators.model import FitConfig
from tallyspark.streaming.scoring import score_stream

SF = "/root/testdata/sf0.001"


def test_list_keeps_first_and_order(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" b \n\na\nb\n")
    assert [r["value"] for r in D.read_list(spark, str(tmp_path / "l.txt")).orderBy("pos").collect()] == ["b", "a"]


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n% c\n2 3 2\n1 3 4\n2 1 5\n")
    assert sorted(map(tuple, D.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [(0, 1, 5.0), (2, 0, 4.0)]


def test_melt_drops_zeros(spark):
    wide = spark.createDataFrame([("c1", 0, 2), ("c2", 3, 0)], "cell string, g1 int, g2 int")
    assert sorted(map(tuple, D.melt(wide, "cell").collect())) == [("c1", "g2", 2.0), ("c2", "g1", 3.0)]


def test_label_grid_rejects_blanks(spark):
    grid = spark.createDataFrame([("ctrl", "", "control")], "label string, batch string, perturbation string")
    with pytest.raises(ValueError, match="blank 'batch' value"):
        D.label_grid(grid)


def test_stream_scores(spark, tmp_path):
    rows = spark.createDataFrame([("g", 2, 10)], "gene_id string, k long, n_ref long")
    rows.write.parquet(str(tmp_path / "in"))
    priors = spark.createDataFrame([("g", 10.0, [0.1, 0.2, 0.5], [0.3, 0.3, 0.4])], "gene_id string, scale double, support array<double>, prob array<double>")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, priors, 10.0, FitConfig()).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert [r["signal"] for r in spark.table("scored").collect()] == [2.0]


def test_spread_grows_with_files(spark, tmp_path, monkeypatch):
    """A table of more files' bytes is dealt over more tasks, whatever the session's number of shuffle partitions, and the
    retail matrix stays the same."""
    whole = D.read(spark, SF, "lineitem")
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert D.spread(whole, whole, "l_orderkey").rdd.getNumPartitions() == whole.rdd.getNumPartitions()
    plain = {tuple(r) for r in D.retail(spark, SF).counts.collect()}
    monkeypatch.setattr(D, "TASK_BYTES", D.expected_bytes(whole) // (4 * before) + 1)
    assert D.spread(whole, whole, "l_orderkey").rdd.getNumPartitions() > before
    D.SHARED.forget(spark, ("retail", SF))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not D.broadcasts(D.read(spark, SF, "part"))
        counts = D.retail(spark, SF).counts
        assert {tuple(r) for r in counts.collect()} == plain
        assert counts.rdd.getNumPartitions() > before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        D.SHARED.forget(spark, ("retail", SF))
