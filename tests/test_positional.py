"""Numbering in an order over many partitions, and files told by position."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import order as O
from tallyspark.operators import sampling as S
from tallyspark.sources import positional as N
from tallyspark.sources.matrices import Matrix


def counts_of(m):
    return {(r["cell_id"], r["gene_id"]): r["value"] for r in m.counts.collect()}


def test_numbers_by_group_and_order(spark):
    rng = random.Random(1)
    rows = [("a" if i % 10 else None, rng.randrange(500), i) for i in range(1000)]  # a hot group, a null one, ties
    frame = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    got = O.numbered(frame, ["g"], ["v", "i"]).collect()
    for g in ("a", None):
        want = sorted((v, i) for h, v, i in rows if h == g)
        assert [(r["v"], r["i"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["pos"])] == want
        assert sorted(r["pos"] for r in got if r["g"] == g) == list(range(len(want)))
    assert sorted(r["pos"] for r in O.numbered(frame, [], [F.desc("v")]).collect()) == list(range(1000))
    assert O.numbered(frame.limit(0), [], ["v"]).count() == 0


def test_lines_keep_their_order_over_many_splits(spark, tmp_path):
    (tmp_path / "x").mkdir()
    lines = [f"line {i} " + "x" * (i % 97) for i in range(3000)]
    for k in range(3):
        (tmp_path / "x" / f"part-{k}.txt").write_text("\n".join(lines[1000 * k : 1000 * (k + 1)]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = O.numbered_lines(spark, str(tmp_path / "x"))
        assert read.rdd.getNumPartitions() > 1 and {r["pos"]: r["value"] for r in read.collect()} == dict(enumerate(lines))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def bundle(tmp_path, matrix):
    (tmp_path / "matrix.mtx").write_text(matrix)
    (tmp_path / "barcodes.tsv").write_text("AAC-1\nAAG-1\n\nAAT-2\n")
    (tmp_path / "genes.tsv").write_text("G1\talpha\nG1\tagain\nG2\tbeta\n")
    return [str(tmp_path / f) for f in ("matrix.mtx", "barcodes.tsv", "genes.tsv")]


def test_matrix_bundle(spark, tmp_path):
    text = "%%MatrixMarket matrix coordinate integer general\n% note\n3 3 4\n1 3 4\n2 1 5\n3 2 1\n3 2 2\n"
    m = N.read_matrix_bundle(spark, *bundle(tmp_path, text))
    assert counts_of(m) == {("AAT-2", "G1"): 4.0, ("AAC-1", "G1-1"): 5.0, ("AAG-1", "G2"): 3.0}
    assert [(r["gene_id"], r["gene_name"]) for r in m.var.orderBy("pos").collect()] == [("G1", "alpha"), ("G1-1", "again"), ("G2", "beta")]
    assert [r["cell_id"] for r in m.obs.orderBy("pos").collect()] == ["AAC-1", "AAG-1", "AAT-2"]
    N.write_matrix_bundle(m, str(tmp_path / "out"))
    assert counts_of(N.read_matrix_bundle(spark, *[str(tmp_path / "out" / f) for f in ("matrix", "barcodes", "genes")])) == counts_of(m)


@pytest.mark.parametrize("text", ["%%M\n3 3 2\n1 1 1\n", "%%M\n3 2 1\n1 1 1\n", "%%M\n3 3 1\n4 1 1\n", "%%M\n3 3 1\n0 1 1\n", "%%M\n"])
def test_faulty_bundles(spark, tmp_path, text):
    with pytest.raises(ValueError):
        N.read_matrix_bundle(spark, *bundle(tmp_path, text))


def test_dense_tables(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\tc1\t'c2'\tc3\ng1\t0\t2\t\n\ng2\t1.5\t0\t0\r\n'g3'\t0\t0\t0\n")
    m = N.read_genes_by_cells(spark, str(tmp_path / "g.txt"))
    assert counts_of(m) == {("c2", "g1"): 2.0, ("c1", "g2"): 1.5}
    assert [r["gene_id"] for r in m.var.orderBy("pos").collect()] == ["g1", "g2", "g3"] and m.obs.count() == 3
    (tmp_path / "c.csv").write_text("cell,g1,g2\nc1,0,7\nc2,3,0\n")
    m = N.read_cells_by_genes(spark, str(tmp_path / "c.csv"))
    assert counts_of(m) == {("c1", "g2"): 7.0, ("c2", "g1"): 3.0}
    for first, delimiter, read in ((True, "\t", N.read_genes_by_cells), (False, ",", N.read_cells_by_genes)):
        N.write_dense(m, str(tmp_path / f"w{first}"), delimiter, genes_first=first)
        assert counts_of(read(spark, str(tmp_path / f"w{first}"), delimiter)) == counts_of(m)
    (tmp_path / "bad.csv").write_text("cell,g1,g2\nc1,0\n")
    with pytest.raises(ValueError, match="fields"):
        N.read_cells_by_genes(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        N.read_cells_by_genes(spark, str(tmp_path / "none.csv"))


def test_species(spark, tmp_path):
    (tmp_path / "e.csv").write_text("gA,gB,gC\n1,0,2\n0,3,4\n5,6,7\n")
    (tmp_path / "c.csv").write_text("cell_index,identity,batch\n0,ecoli,x\n1,bsub,y\n2,ecoli,z\n")
    (tmp_path / "g.csv").write_text("gene_index,chr,Geneid,Name\n0,ecoli,b1,gA\n1,bsub,b2,gB\n2,plasmid,b3,gC\n")
    paths = [str(tmp_path / f) for f in ("e.csv", "c.csv", "g.csv")]
    m = N.read_species(spark, *paths, "ecoli", ["ecoli", "plasmid"])
    assert counts_of(m) == {("0", "b1"): 1.0, ("0", "b3"): 2.0, ("2", "b1"): 5.0, ("2", "b3"): 7.0}
    assert {(r["cell_id"], r["batch"]) for r in m.obs.collect()} == {("0", "x"), ("2", "z")} and m.var.count() == 2
    assert counts_of(N.read_species(spark, *paths, "bsub")) == {("1", "b2"): 3.0}
    with pytest.raises(ValueError, match="no cells"):
        N.read_species(spark, *paths, "yeast")
    (tmp_path / "g.csv").write_text("gene_index,chr,Geneid,Name\n0,ecoli,b1,gB\n")
    with pytest.raises(ValueError, match="not where"):
        N.read_species(spark, *paths, "ecoli")


def test_drawn_ranks_are_different_and_even(spark):
    n, k = 6, 3
    rows = spark.range(4000).select(S.drawn_ranks(F.lit(n), k, F.col("id")).alias("r")).collect()
    assert all(len(set(r["r"])) == k and min(r["r"]) >= 1 and max(r["r"]) <= n for r in rows)
    sets = {}
    for r in rows:
        sets[tuple(sorted(r["r"]))] = sets.get(tuple(sorted(r["r"])), 0) + 1
    assert len(sets) == 20 and all(130 < c < 280 for c in sets.values())


def test_draws_of_a_hot_class(spark):
    obs = spark.createDataFrame([(i, "a" if i < 900 else "b") for i in range(1000)], "cell_id long, label string")
    got = S.combinations(obs, S.plan(obs.withColumn("n_ref", F.lit(1)), 4, 50, False), 4, 1).groupBy("label", "sample_id").agg(F.collect_set("cell_id").alias("c")).collect()
    assert len(got) == 100 and all(len(r["c"]) == 4 and all((c < 900) == (r["label"] == "a") for c in r["c"]) for r in got)
    assert isinstance(Matrix(obs, obs, obs), Matrix)


def test_wide_tables_are_written_and_read_in_chunks(spark, tmp_path):
    """Chunks of columns that are full, empty, single and cut off, both ways round; lines without any value."""
    values = {("c00", "g1"): 1.5, ("c02", "g1"): 2.0, ("c03", "g1"): 3.0, ("c09", "g1"): 4.0, ("c10", "g1"): 5.0, ("c06", "g3"): 6.0}
    counts = spark.createDataFrame([(*k, v) for k, v in values.items()], "cell_id string, gene_id string, value double")
    obs = spark.createDataFrame([(f"c{i:02d}", None) for i in range(11)], "cell_id string, label string")
    m = Matrix(counts, obs, spark.createDataFrame([("g1",), ("g2",), ("g3",)], "gene_id string"))
    for chunk in (3, 100):
        by_gene, by_cell = str(tmp_path / f"g{chunk}"), str(tmp_path / f"c{chunk}")
        N.write_dense(m, by_gene, "\t", genes_first=True, chunk=chunk)
        N.write_dense(m, by_cell, chunk=chunk)
        assert [r["value"].split("\t") for r in O.numbered_lines(spark, by_gene).orderBy("pos").collect()] == [
            ["gene_id", *(f"c{i:02d}" for i in range(11))], *[[g, *(str(values.get((f"c{i:02d}", g), 0)) for i in range(11))] for g in ("g1", "g2", "g3")],
        ]
        for back in (N.read_genes_by_cells(spark, by_gene), N.read_cells_by_genes(spark, by_cell)):
            assert counts_of(back) == values and back.obs.count() == 11 and back.var.count() == 3
    rows, found, header = N._wide(spark, str(tmp_path / "g100"), "\t", fields=4)
    assert {(r["name"], r["at"]): r["value"] for r in found.collect()} == {(g, int(c[1:])): v for (c, g), v in values.items()}
    assert rows.count() == 3 and [r["at"] for r in header.orderBy("at").collect()] == list(range(11))
