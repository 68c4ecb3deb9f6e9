from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import checkpoints as P
from tallyspark.operators import curves as C
from tallyspark.operators import mixture as G
from tallyspark.operators import model as M
from tallyspark.operators import sampling as S
from tallyspark.operators import stats as T
from tallyspark.sources.matrices import Matrix


def matrix(spark, counts, labels=None):
    cells = [(i, (labels or ["a"] * len(counts))[i]) for i in range(len(counts))]
    rows = [(i, f"g{j + 1}", v) for i, r in enumerate(counts) for j, v in enumerate(r) if v]
    return Matrix(
        spark.createDataFrame(rows, "cell_id long, gene_id string, value long"),
        spark.createDataFrame(cells, "cell_id long, label string"),
        spark.createDataFrame([(f"g{j + 1}",) for j in range(len(counts[0]))], "gene_id string"),
    )


def test_implicit_zeros_count(spark):
    m = matrix(spark, [[1, 0, 2], [0, 0, 3]])
    assert {r["gene_id"]: (r["total"], r["detected"]) for r in T.gene_totals(m).collect()} == {"g1": (1, 1), "g2": (0, 0), "g3": (5, 2)}
    assert sorted(r["zero_fraction"] for r in T.zero_fractions(m).collect()) == pytest.approx([1 / 3, 2 / 3])
    assert {r["weight"] for r in M.compressed(m).filter("gene_id = 'g2'").collect()} == {2}


def test_compressed_equals_the_dense_rows(spark):
    m = matrix(spark, [[1, 0], [2, 1], [3, 1], [0, 2]])
    dense = M.observations(m).groupBy("gene_id", "k", "n_ref").count()
    got = M.compressed(m).select("gene_id", "k", "n_ref", "weight")
    assert sorted(map(tuple, dense.collect())) == sorted(map(tuple, got.collect()))


def test_binomial_guard(spark):
    rows = spark.createDataFrame([("global", "g1", 5, 2, 2.0, 1)], "scope string, gene_id string, k long, n_ref long, n_mean double, weight long")
    with pytest.raises(ValueError, match="effective_exposure"):
        M.check_binomial(rows, F.lit(2.0))


def test_fit_converges_and_unrolled_steps_agree(spark):
    m = matrix(spark, [[1, 3], [2, 1], [3, 1], [1, 2], [4, 6]])
    rows, scale = M.compressed(m), F.lit(M.scale_of(m))
    config = M.FitConfig(points=8, max_iterations=2, tolerance=1e-300)
    start = M.initial_priors(M.support_tops(rows, scale, config), config)
    two = {r["gene_id"]: r["prob"] for r in M.em_step(rows, M.em_step(rows, start, config), config).collect()}
    fitted = {r["gene_id"]: r["prob"] for r in M.fit_priors(rows, scale, config).collect()}
    for g in two:
        assert fitted[g] == pytest.approx(two[g], abs=1e-9)
    C.check_priors(start)


def test_adaptive_top():
    config = M.FitConfig(adaptive_scale=2, adaptive_quantile=0.75)
    assert M.refined_top(config, np.arange(5) * 0.15, np.array([0.6, 0.2, 0.1, 0.1, 0])) == pytest.approx(0.3)
    config = M.FitConfig(adaptive_scale=1.5, adaptive_quantile=0.995)
    assert M.refined_top(config, np.arange(5) * 0.05, np.array([0.01, 0.01, 0.03, 0.05, 0.9])) == pytest.approx(0.3)


def test_zero_cells_and_unknown_config(spark):
    with pytest.raises(ValueError):
        M.FitConfig(likelihood="other")


def test_stratified_sizes_and_missing_labels(spark):
    obs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "cell_id long, label string")
    got = {r["label"]: r["count"] for r in S.stratified(obs, 0.5, 1, 1).groupBy("label").count().collect()}
    assert got == {"a": 1, "b": 1}
    with pytest.raises(ValueError):
        S.stratified(spark.createDataFrame([(1, None)], "cell_id long, label string"), 0.5, 1, 1)


def test_kbulk_mean(spark):
    m = matrix(spark, [[1, 2], [3, 4], [5, 6], [7, 8]], ["a", "a", "b", "b"])
    ref = T.reference_counts(m)
    chosen = S.combinations(m.obs, S.plan(ref, 2, 1, False), 2, 0)
    got = {(r["label"], r["gene_id"]): r["mean"] for r in S.aggregate(m.counts, ref, chosen, m.var, 2).collect()}
    assert got == {("a", "g1"): 2.0, ("a", "g2"): 3.0, ("b", "g1"): 6.0, ("b", "g2"): 7.0}


def test_unique_combinations_are_all_of_them(spark):
    m = matrix(spark, [[1], [1], [1], [1]])
    plan = S.plan(T.reference_counts(m), 2, 100, False)
    got = S.unique_combinations(m.obs, plan, 2, 0).groupBy("sample_id").agg(F.array_sort(F.collect_list("cell_id")).alias("c")).collect()
    assert len({tuple(r["c"]) for r in got}) == 6


def test_plateau_peak(spark):
    assert G.peaks_of(np.array([0, 0.3, 0.3, 0.3, 0.1]), G.StageConfig()).tolist() == [2]
    c = G.peak_indices(F.array(*[F.lit(x) for x in (0.0, 0.3, 0.3, 0.3, 0.1)]))
    assert spark.range(1).select(c).first()[0] == [2]


def test_checkpoint_round_trip_and_merge(spark, tmp_path):
    rows = [("global", g, 2.0, [0.1, 0.2], [0.5, 0.5]) for g in ("a", "b")]
    p = spark.createDataFrame(rows, "scope string, gene_id string, scale double, support array<double>, prob array<double>")
    C.save_checkpoint(p, str(tmp_path / "c"), {"likelihood": "binomial"})
    back, meta = C.load_checkpoint(spark, str(tmp_path / "c"))
    assert back.count() == 2 and meta["likelihood"] == "binomial"
    assert meta["fit_mode"] == "global"
    with pytest.raises(ValueError):
        P.merged([(p, {}), (p, {})])
    with pytest.raises(ValueError, match="differ"):
        P.merged([(p.filter("gene_id = 'a'"), {}), (p.filter("gene_id = 'b'").withColumn("scale", F.lit(3.0)), {})])
    halves = [p.filter(f"gene_id = '{g}'") for g in "ab"]
    with pytest.raises(ValueError, match="mean reference"):
        P.merged([(halves[0], {"mean_reference": 5.0}), (halves[1], {"mean_reference": 5.1})])
    assert P.merged([(halves[0], {"mean_reference": 5.0}), (halves[1], {"mean_reference": 5.0})]).count() == 2


@pytest.mark.parametrize("likelihood", ["binomial", "negative_binomial", "poisson"])
def test_blocks_and_parts_give_the_same_priors(spark, likelihood):
    rng = np.random.default_rng(4)
    m = matrix(spark, rng.poisson(3, (40, 3)).tolist())
    rows = M.compressed(m).cache()
    config = M.FitConfig(points=24, max_iterations=3, likelihood=likelihood)
    key = lambda df: {r["gene_id"]: (r["n_iter"], r["final_objective"], r["prob"]) for r in df.collect()}
    want = key(M.fit_priors(rows, F.col("n_mean"), config))
    for got in (
        key(M.fit_priors(rows, F.col("n_mean"), replace(config, block=7))),
        key(M.fit_priors(rows, F.col("n_mean"), replace(config, block=7, kept=0))),
        key(M.fit_large(rows, F.col("n_mean"), replace(config, block=7), part=10)),
    ):
        assert got.keys() == want.keys()
        for gene, (n, objective, prob) in got.items():
            assert n == want[gene][0] and objective == pytest.approx(want[gene][1], abs=1e-9) and prob == pytest.approx(want[gene][2], abs=1e-9)


def test_large_fits_of_several_scopes_and_of_nothing(spark):
    rng = np.random.default_rng(5)
    m = matrix(spark, rng.poisson(2, (30, 2)).tolist())
    rows = M.compressed(m, True)
    config = M.FitConfig(points=12, max_iterations=200, tolerance=0.02)
    key = lambda df: {(r["scope"], r["gene_id"]): (r["n_iter"], r["prob"]) for r in df.collect()}
    want, got = key(M.fit_priors(rows, F.col("n_mean"), config)), key(M.fit_large(rows, F.col("n_mean"), config, part=5))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert M.fit_large(rows.limit(0), F.col("n_mean"), config).count() == 0
    with pytest.raises(ValueError, match="adapt"):
        M.fit_large(rows, F.col("n_mean"), replace(config, adaptive=True))


def _counted(df, seen):
    def passed(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    return df.mapInPandas(passed, df.schema)


def test_assembled_fits_run_once(spark):
    rows = [("global", g, 2.0, [0.1, 0.2], [0.5, 0.5]) for g in ("a", "b")]
    p = spark.createDataFrame(rows, "scope string, gene_id string, scale double, support array<double>, prob array<double>")
    seen = spark.sparkContext.accumulator(0)
    both = P.assembled(_counted(p, seen), p.withColumn("scope", F.lit("label:x")))
    P.check_same_genes(both)
    assert both.count() == 4 and seen.value == 2


def test_unique_combinations_plan_once(spark):
    m = matrix(spark, [[1]] * 12)
    plan = S.plan(T.reference_counts(m), 2, 5, False)
    seen = spark.sparkContext.accumulator(0)
    got = S.unique_combinations(m.obs, _counted(plan, seen), 2, 0).collect()
    assert len(got) == 10 and seen.value == 1


def test_compressed_of_some_genes(spark):
    m = matrix(spark, [[1, 0, 2], [0, 0, 3], [1, 4, 2], [0, 0, 0]], ["a", "b", "a", "b"])
    for by_label in (False, True):
        some = M.compressed(m, by_label, m.var.filter("gene_id <> 'g1'"))
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, M.compressed(m, by_label).filter("gene_id <> 'g1'").collect()))
    assert {(r["gene_id"], r["k"], r["n_ref"]): r["weight"] for r in some.collect()} == {
        ("g2", 0, 3): 1, ("g2", 4, 7): 1, ("g3", 2, 3): 1, ("g3", 2, 7): 1, ("g3", 3, 3): 1, ("g2", 0, 3): 1,
    }
