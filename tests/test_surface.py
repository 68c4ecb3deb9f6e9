"""Rules, texts, checks, checkpoints, facades and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark import cli
from tallyspark.functions import expr as X
from tallyspark.functions import text as W
from tallyspark.operators import checkpoints as P
from tallyspark.operators import checks as K
from tallyspark.operators import curves as C
from tallyspark.operators import lists as L
from tallyspark.operators import model as M
from tallyspark.operators import sampling as S
from tallyspark.operators import stats as T
from tallyspark.plans import facades
from tallyspark.sources.matrices import Matrix


@pytest.fixture(scope="module")
def m(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(rng.gamma(1.5, 2.0, size=8), size=(60, 8))
    counts = [(i, f"g{j}", int(x[i, j])) for i in range(60) for j in range(8) if x[i, j]]
    out = Matrix(
        spark.createDataFrame(counts, "cell_id long, gene_id string, value long"),
        spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "cell_id long, label string"),
        spark.createDataFrame([(f"g{j}",) for j in range(8)], "gene_id string"),
    )
    out_x = x
    return out, out_x


@pytest.mark.parametrize(
    ("species", "gone", "stay"),
    [
        ("human", ["FTH1", "HBC1", "HBB", "JUNB", "DUSP1", "HSPA8", "EGR4", "IER5L", "FOSB", "DNAJA1", "MT-X"], ["HSPG2", "HBEGF", "EGR5", "FOSL1", "JUNBX", "DUSP111"]),
        ("mouse", ["Ftl1", "Hbb-bs", "Hspa8", "Jund", "mt-Co1"], ["FTL", "Hspg2", "MT-CO1"]),
        ("ecoli", ["rrsA", "tufA", "groEL", "dnaKx", "cspA", "infA"], ["cspZ", "rrnA", "gltA"]),
        ("bsub", ["rrnA", "sigA", "hbsU", "cspZ", "clpC"], ["clpB", "rrsA", "gltA"]),
    ],
)
def test_built_in_rules(spark, species, gone, stay):
    names = spark.createDataFrame([(n,) for n in gone + stay], "gene_id string")
    assert [r["gene_id"] for r in L.filtered(names, L.RULES[species]).collect()] == stay


def test_texts(spark):
    rows = [("'A b'", "young_MPP_7", "x-12", "yes"), (None, "old_MPP_", "x-", "F"), (" '", "mid_MPP_1", "x", "2")]
    got = spark.createDataFrame(rows, "a string, b string, c string, d string").select(
        W.cleaned(F.col("a")).alias("a"), W.cell_parts(F.col("b"))["number"].alias("b"), W.suffix_number(F.col("c")).alias("c"), W.truth(F.col("d")).alias("d")
    )
    assert [tuple(r) for r in got.collect()] == [("A b", 7, 12, True), ("", None, None, False), ("'", None, None, None)]
    guides = ["A_B__x", "NegCtrl0_B__y", "A_NegCtrl1", "NegCtrl0_NegCtrl0__z", "", None, "C19orf26__q"]
    frame = spark.createDataFrame([(g,) for g in guides], "g string")
    out = [tuple(r["t"])[::4] for r in frame.select(W.guide_targets(F.col("g"), {"C19orf26": "CBARP"}, ["NegCtrl0_NegCtrl0"], "NegCtrl").alias("t")).collect()]
    assert out == [(2, "A_B"), (2, "B"), (2, "A"), (2, "control"), (0, ""), (0, ""), (1, "CBARP")]


def test_checks_raise(spark, m, tmp_path):
    m, _ = m
    K.check_counts(m, T.reference_counts(m))
    for value, gene in ((-1, "g0"), (1, "unknown")):
        bad = m.layer(m.counts.union(spark.createDataFrame([(0, gene, value)], m.counts.schema)))
        with pytest.raises(ValueError):
            K.check_counts(bad)
    for names in (["a", "a"], ["a", " "], ["a", None]):
        with pytest.raises(ValueError):
            K.check_names(spark.createDataFrame([(n,) for n in names], "gene_id string"))
    (tmp_path / "v").write_text("c\n\n a \n")
    assert K.option_values(["a,b", " b "], str(tmp_path / "v")) == ["a", "b", "c"]
    assert K.obs_filter(m.obs, "label", [" a "]).count() == 30
    with pytest.raises(ValueError):
        K.obs_filter(m.obs, "label", ["z"])
    guides = spark.createDataFrame([(0, 1, "x")], "cell_id long, gem_group int, guide string")
    with pytest.raises(ValueError):
        K.with_guides(m.obs.withColumn("gem_group", F.lit(2)), guides)


def test_sparse_statistics_equal_dense_ones(m):
    m, x = m
    got = {r["gene_id"]: r for r in T.gene_summary(m).collect()}
    for j in range(8):
        r, v = got[f"g{j}"], x[:, j]
        assert (r["total"], r["detected"], r["max"]) == (v.sum(), (v > 0).sum(), v.max())
        assert [r["median"], r["p90"], r["p99"]] == pytest.approx(np.quantile(v, [0.5, 0.9, 0.99]).tolist())
        assert r["total_corr"] == pytest.approx(np.corrcoef(v, x.sum(axis=1))[0, 1])
    key = lambda rows: sorted(tuple(round(y, 9) if isinstance(y, float) else y for y in r) for r in rows.collect())
    assert key(T.mann_whitney_sparse(m, "a", "b")) == key(T.mann_whitney(m.dense(), "a", "b"))


def test_variances_of_seurat_v3(m):
    m, x = m
    got = {r["gene_id"]: r["score"] for r in T.hvg(m, "seurat_v3").collect()}
    n, mean, var = len(x), x.mean(axis=0), x.var(axis=0, ddof=1)
    sd = np.sqrt(10 ** T._smooth(np.log10(mean), np.log10(var)))
    clipped = np.minimum(x, mean + sd * np.sqrt(n))
    want = ((clipped - mean) ** 2).sum(axis=0) / ((n - 1) * sd**2)
    assert [got[f"g{j}"] for j in range(8)] == pytest.approx(want.tolist())
    line = np.linspace(0, 5, 40)
    assert T._smooth(line, 2 + 3 * line - line**2) == pytest.approx(2 + 3 * line - line**2)
    with pytest.raises(ValueError):
        T.hvg(m, "none")


def test_warm_start_covers_whole_batches(spark):
    new = spark.createDataFrame([("label:a", g, 1.0, [0.0, 1.0], [0.5, 0.5]) for g in "xyz"] + [("label:b", "x", 1.0, [0.0, 1.0], [0.5, 0.5])], "scope string, gene_id string, scale double, support array<double>, prob array<double>")
    old = spark.createDataFrame([("label:a", "x", [0.25, 0.75]), ("label:a", "z", [0.125, 0.875]), ("global", "x", [1.0, 3.0])], "scope string, gene_id string, prob array<double>")
    batches = spark.createDataFrame([("label:a", "x", 0), ("label:a", "y", 0), ("label:a", "z", 1), ("label:b", "x", 0)], "scope string, gene_id string, b long")
    got = {(r["scope"], r["gene_id"]): (r["prob"], r["support"]) for r in P.warm_start(new, old, batches).collect()}
    half, grid = [0.5, 0.5], [0.0, 1.0]
    assert got == {("label:a", "x"): (half, grid), ("label:a", "y"): (half, grid), ("label:a", "z"): ([0.125, 0.875], grid), ("label:b", "x"): ([0.25, 0.75], grid)}
    assert {tuple(r["prob"]) for r in P.warm_start(new, old, batches, False).collect()} == {(0.5, 0.5)}


def test_invalid_priors(spark):
    kind = "scope string, gene_id string, scale double, support array<double>, prob array<double>"
    good = spark.createDataFrame([("global", "x", 1.0, [0.0, 1.0], [0.5, 0.5])], kind)
    C.check_priors(good)
    wide = spark.createDataFrame([("global", "x", 1.0, [0.0, 2.0], [0.5, 0.5])], kind)
    C.check_priors(wide, rate=True)
    for bad in (wide, good.union(spark.createDataFrame([("label:a", "y", 1.0, [0.0, 1.0], [0.5, 0.5])], kind))):
        with pytest.raises(ValueError):
            C.check_priors(bad)
    with pytest.raises(ValueError):
        P.merged([(good, {"layer": "a"}), (good.limit(0), {"layer": "b"})])
    with pytest.raises(ValueError):
        P.merged([(good, {})], spark.createDataFrame([("y",)], "gene_id string"))
    with pytest.raises(KeyError):
        P.get_prior(good, "a")
    rows = spark.createDataFrame([("label:a", 5.0), ("global", 5.0)], "scope string, n_mean double")
    both = good.union(spark.createDataFrame([("label:a", "x", 3.0, [0.0, 1.0], [0.5, 0.5])], kind))
    scales = lambda *given: [r["fit_scale"] for r in P.with_fit_scale(rows, *given).orderBy("scope").collect()]
    assert scales() == [5.0, 5.0] and scales(2.0, both) == [2.0, 2.0] and scales(None, good) == [1.0, 1.0] and scales(None, both) == [1.0, 3.0]
    obs = spark.createDataFrame([("a", "q"), ("b", "a"), ("c", "b")], "one string, two string")
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    assert P.suggested_label(labels, obs, ["two", "one"]) == "one" and P.suggested_label(labels.limit(0), obs, ["one"]) is None
    assert P.likelihood_of({"fit_config": {"likelihood": "poisson"}, "posterior_distribution": "binomial"}) == "poisson"
    with pytest.raises(ValueError):
        P.check_distribution({"posterior_distribution": "poisson"}, "binomial")


def test_engine_fits_what_is_missing(m):
    m, _ = m
    engine = M.PriorEngine(m, M.FitConfig(points=8, max_iterations=2))
    some = m.var.filter("gene_id < 'g3'")
    assert engine.fit(some).first()["genes"] == 3 and engine.is_all_fitted(some) and not engine.is_fitted("g5")
    assert engine.fit(m.var).first()["genes"] == 5 and engine.is_all_fitted(m.var)
    with pytest.raises(KeyError):
        engine.get_prior("none")


def test_command_line(spark, m, tmp_path):
    m, _ = m
    at = lambda name: str(tmp_path / name)
    cli.write_matrix(m, at("m"))
    cli.main(["fit-priors", at("m"), "--output", at("c"), "--mode", "both", "--points", "8", "--spacing", "sqrt", "--max-iterations", "20", "--summary", at("fit.json")], spark)
    told = json.loads((tmp_path / "fit.json").read_text())
    assert {r["scope"] for r in told["scopes"]} >= {"global"} and told["mean_reference"] > 0 and told["fit_config"]["spacing"] == "sqrt"
    cli.main(["fit-priors", at("m"), "--output", at("w"), "--points", "8", "--warm-start", at("c"), "--shard", "0", "--shards", "2"], spark)
    cli.main(["fit-priors", at("m"), "--output", at("v"), "--points", "8", "--shard", "1", "--shards", "2"], spark)
    cli.main(["merge-checkpoints", at("w"), at("v"), "--output", at("all")], spark)
    assert C.load_checkpoint(spark, at("all"))[0].count() == 8
    cli.main(["extract-signals", at("m"), "--checkpoint", at("c"), "--output", at("s"), "--by-label"], spark)
    signals = spark.read.parquet(at("s"))
    assert signals.count() == 480 and signals.filter("signal < 0 OR scope = 'global'").count() == 0
    cli.main(["extract-kbulk", at("m"), "--checkpoint", at("c"), "--output", at("k"), "--k", "3", "--samples", "2", "--layers"], spark)
    assert {"map_mu", "map_p", "raw_counts", "prior_entropy"} <= set(spark.read.parquet(at("k")).columns)
    with pytest.raises(ValueError):
        cli.main(["extract-signals", at("m"), "--checkpoint", at("c"), "--output", at("x"), "--distribution", "poisson"], spark)
    assert spark.read.parquet(at("k")).select("label", "sample_id").distinct().count() == 4
    cli.main(["rank-genes", at("m"), "--output", at("r"), "--method", "total", "--top", "3"], spark)
    assert spark.read.option("header", True).csv(at("r")).count() == 3
    cli.main(["curves", "--checkpoint", at("c"), "--gene", "g1,g2", "--output", at("p")], spark)
    assert spark.read.option("header", True).csv(at("p")).count() == 2 * 3 * 8
    (tmp_path / "names").write_text("FTL\nCD3E\nQ1\n")
    (tmp_path / "rules.json").write_text(json.dumps({"prefixes": ["Q"]}))
    cli.main(["filter-genes", at("names"), "--species", "human", "--rules", at("rules.json"), "--output", at("f")], spark)
    assert [r[0] for r in spark.read.text(at("f")).collect()] == ["CD3E"]
    cli.write_summary({"kept": 1}, at("s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"kept": 1}


def test_label_without_priors(m):
    m, _ = m
    priors = facades.fit_checkpoint(m, "global", M.FitConfig(points=8, max_iterations=1))
    assert facades.extract_signals(m, priors, M.FitConfig(points=8), by_label=True).count() == 480
    with pytest.raises(ValueError):
        facades.extract_signals(m, priors, M.FitConfig(points=8), by_label=True, missing="error")


def test_unique_samples_of_small_and_large_classes(spark):
    obs = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(60)], "cell_id long, label string")
    plan = S.plan(obs.withColumn("n_ref", F.lit(1)), 3, 12, False)
    got = S.unique_combinations(obs, plan, 3, 4).groupBy("label", "sample_id").agg(F.array_sort(F.collect_list("cell_id")).alias("c")).collect()
    for label, many in (("a", 10), ("b", 12)):
        sets = [tuple(r["c"]) for r in got if r["label"] == label]
        assert len(sets) == len(set(sets)) == many and all(len(set(c)) == 3 for c in sets)


def test_running_sums_of_long_arrays(spark):
    values = np.random.default_rng(1).random(100)
    rows = [(values[:n].tolist(),) for n in (1, 31, 32, 33, 64, 100)] + [([],)]
    got = spark.createDataFrame(rows, "p array<double>").select(X.cumulative(F.col("p")).alias("c")).collect()
    assert all(r["c"] == pytest.approx(np.cumsum(v[0]).tolist()) for r, v in zip(got, rows, strict=True))


def test_sorted_blocks_smooth_as_the_whole_does(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=300), 2)  # with ties
    y = 2 + 3 * x - x**2 + rng.normal(size=300)
    points = spark.createDataFrame([(f"g{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id string, x double, y double").repartition(5)
    got = {r["id"]: r["fit"] for r in T.smoothed(points, block=17).collect()}
    assert [got[f"g{i:03d}"] for i in range(300)] == pytest.approx(T._smooth(x, y).tolist(), abs=1e-9)


def test_sketches_of_quantiles_are_within_their_error(spark):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_linenumber", F.col("l_extendedprice").cast("double").alias("v"))
    by, shares = ["l_linenumber"], (0.1, 0.5, 0.9)
    sketch = {r["l_linenumber"]: r["q"] for r in K.quantiles_of(lines, by, "v", shares, "sketch").collect()}
    ranks = lines.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("v") <= F.element_at(F.create_map(*[F.lit(x) for k, q in sketch.items() for x in (k, q[i])]), F.col("l_linenumber"))).alias(f"r{i}") for i in range(3)]).collect()
    assert len(ranks) == 7 and all(abs(r[f"r{i}"] / r["n"] - s) < 2.3 / K.SKETCH**0.9 * 1.5 for r in ranks for i, s in enumerate(shares))
    parts = K.sketched(lines.withColumn("part", F.rand(1) < 0.3), ["part", *by], "v")
    whole = K.merged_sketches(parts, by).select(*by, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("q")).collect()
    exact = {r["l_linenumber"]: r["q"][0] for r in K.quantiles_of(lines, by, "v", (0.5,), "auto").collect()}
    assert all(r["q"] == pytest.approx(exact[r["l_linenumber"]], rel=0.05) for r in whole)
    summary = K.value_summary(lines, by, "v", "sketch").collect()
    assert all(r["median"] == pytest.approx(exact[r["l_linenumber"]], rel=0.05) and r["max"] >= r["p90"] >= r["median"] for r in summary)
    with pytest.raises(ValueError, match="unknown method"):
        K.quantiles_of(lines, by, "v", shares, "x")


def test_cells_without_counts_leave_signals_alone(spark):
    """The mean reference is that of cells with counts, in all cells' signals as in the fit."""
    counts = spark.createDataFrame([(c, g, 1 + (c + i) % 4) for c in range(6) for i, g in enumerate("xyz")], "cell_id long, gene_id string, value long")
    var = spark.createDataFrame([(g,) for g in "xyz"], "gene_id string")
    few, many = (Matrix(counts, spark.createDataFrame([(i, "a") for i in range(n)], "cell_id long, label string"), var) for n in (6, 9))
    config = M.FitConfig(points=8)
    priors = M.initial_priors(M.support_tops(M.compressed(few), F.col("n_mean"), config), config).localCheckpoint()
    for run in (lambda m: facades.extract_signals(m, priors, config), lambda m: facades.gene_analysis(m, "x", "checkpoint", config, priors)):
        a, b = (sorted((r["cell_id"], r["gene_id"], r["signal"], r["posterior_entropy"]) for r in run(m).collect()) for m in (few, many))
        assert a == b and len(a) > 0


def test_equally_likely_points_tie(spark):
    """Points p and 1 - p are equally likely for half of an exposure; the first counts, whatever the mean reference."""
    keys = [("global", "g", k, 2 * k, n) for k in range(1, 40) for n in (40.002666844456296, 39.9, 7.3, 13.7, 3.1)]
    rows = spark.createDataFrame(keys, "scope string, gene_id string, k long, n_ref long, n_mean double")
    priors = rows.select("scope", "gene_id", F.col("n_mean").alias("scale"), X.linear_grid(F.lit(1.0), 16).alias("support"), X.uniform(16).alias("prob")).distinct()
    for n in {k[4] for k in keys}:
        got = M.infer(rows.filter(F.col("n_mean") == n), priors.filter(F.col("scale") == n), M.FitConfig(points=16)).collect()
        assert len(got) == 39 and {r["map_support"] for r in got} == {7 / 15}


def test_gene_fit_keeps_cells_beyond_their_reference(spark):
    """A cell with more of the gene than of all others is told without a signal, and the others as if it were not there."""
    rows = [(c, g, 1 + (c + i) % 3) for c in range(8) for i, g in enumerate("xyz")]
    var = spark.createDataFrame([(g,) for g in "xyz"], "gene_id string")
    config = M.FitConfig(points=8, max_iterations=3)
    counts = spark.createDataFrame([*rows, (8, "x", 5), (8, "y", 2)], "cell_id long, gene_id string, value long")
    obs = spark.createDataFrame([(i, "a") for i in range(9)], "cell_id long, label string")
    got = {r["cell_id"]: r for r in facades.gene_analysis(Matrix(counts, obs, var), "x", "fit", config).collect()}
    assert len(got) == 9 and got[8]["k"] == 5 and got[8]["signal"] is None and got[8]["posterior_entropy"] is None
    assert all(got[i]["signal"] is not None for i in range(8))



def test_percentile_bins_come_from_one_evaluation(spark):
    """Percentiles that are a row's own mean leave it in the bin below, though means are not the same when made again."""
    made = F.udf(lambda i: i + np.random.default_rng().uniform(-0.4, 0.4), "double").asNondeterministic()
    rows = spark.range(21).select(F.col("id").alias("gene_id"), made("id").alias("mean"))
    assert {r["gene_id"]: r["bin"] for r in T._with_bins(rows, [0.0, 0.25, 0.5, 0.75, 1.0]).collect()} == {i: -(-i // 5) for i in range(21)}


def test_rows_meet_their_posteriors_though_exposures_change_when_summed_again(spark):
    """kbulk_server differs from its SQL. Sums of doubles, evaluated twice, differ in the last digit, and such rows were lost."""
    summed = F.udf(lambda i: 40.0 + i + np.random.default_rng().uniform(0, 1e-9), "double").asNondeterministic()
    rows = spark.range(50).select(F.lit("global").alias("scope"), F.lit("g").alias("gene_id"), (F.col("id") % 5).alias("k"), summed("id").alias("n_ref"), F.col("id").alias("sample_id"))
    priors = spark.range(1).select(F.lit("global").alias("scope"), F.lit("g").alias("gene_id"), F.lit(40.0).alias("scale"), X.linear_grid(F.lit(0.2), 16).alias("support"), X.uniform(16).alias("prob"))
    got = M.infer(rows, priors, M.FitConfig(points=16), raw_exposure=True)
    assert got.columns[:5] == ["scope", "gene_id", "k", "n_ref", "sample_id"]
    assert sorted(r["sample_id"] for r in got.collect()) == [*range(50)]
    whole = rows.withColumn("n_ref", F.round("n_ref").cast("long"))
    want = {r["sample_id"]: (r["k"], r["signal"]) for r in M.infer(whole, priors, M.FitConfig(points=16), raw_exposure=True).collect()}
    assert {r["sample_id"]: (r["k"], r["signal"]) for r in got.collect()} == want
