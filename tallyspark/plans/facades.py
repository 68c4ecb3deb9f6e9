"""Whole jobs of the command surface, composed of operators. Each takes and returns tables; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import expr as X
from tallyspark.functions.order import cut
from tallyspark.operators import checkpoints as P
from tallyspark.operators import curves as C
from tallyspark.operators import lists as L
from tallyspark.operators import model as M
from tallyspark.operators import sampling as S
from tallyspark.operators import stats as T
from tallyspark.sources.matrices import Matrix

RANKINGS = ("total", "variance", "dispersion", "hvg", "signal-hvg", "prior-entropy")
MODES = ("global", "by-label", "both")


def rank_genes(
    m: Matrix, method: str = "variance", flavour: str = "seurat", priors: DataFrame | None = None, signals: DataFrame | None = None, top: int | None = None, wanted: DataFrame | None = None
) -> DataFrame:
    """gene_id, score, rank by one of RANKINGS, restricted to wanted genes and cut to the first `top`."""
    if method == "total":
        scores = T.gene_totals(m).select("gene_id", F.col("total").cast("double").alias("score"))
    elif method in ("variance", "dispersion"):
        scores = T.moments(m, T.normalized(m)).select("gene_id", F.col(method).alias("score"))
    elif method == "hvg":
        scores = T.hvg(m, flavour)
    elif method == "signal-hvg" and signals is not None:
        scores = T.signal_hvg(m, signals).select("gene_id", F.col("dispersions_norm").alias("score"))
    elif method == "prior-entropy" and priors is not None:
        scores = priors.select("gene_id", X.entropy(F.col("prob")).alias("score"))
    else:
        raise ValueError(f"cannot rank by {method!r} from what is given")
    if wanted is not None:
        scores = scores.join(wanted.select("gene_id"), "gene_id", "left_semi")
    out = L.ranked(scores)
    return out if top is None else out.filter(F.col("rank") <= top)


def fit_checkpoint(
    m: Matrix, mode: str = "global", config: M.FitConfig = M.FitConfig(), scale: float | None = None, genes: DataFrame | None = None, sample: tuple[int, int] | None = None,
    warm: DataFrame | None = None, shard: tuple[int, int] | None = None, batch: int = 1,
) -> DataFrame:
    """Priors of all scopes of a mode. genes: which are fitted (pos, gene_id; all cells' totals stay the reference);
    sample: number of cells and seed; scale: of all scopes, else that of the warm priors, else the mean reference; shard: this one of so many, by place in the list of genes."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    used = m if sample is None else Matrix(m.counts.join(S.subsample(m.obs, *sample).select("cell_id"), "cell_id", "left_semi"), S.subsample(m.obs, *sample), m.var)
    listed = m.var.withColumn("pos", F.col("gene_id")) if genes is None else L.subset_strict(genes, m.var)
    if shard is not None:
        listed = L.shards(listed, shard[1], batch).filter(F.col("shard") == shard[0])
    fits = []
    for by_label in {"global": [False], "by-label": [True], "both": [False, True]}[mode]:
        rows = cut(M.compressed(used, by_label, listed))  # read for supports and for the fit; it grows with the spread of counts
        fits.append(M.fit_priors(P.with_fit_scale(rows, scale, warm), F.col("fit_scale"), config, batch, warm))
    return P.assembled(*fits)


def extract_signals(m: Matrix, priors: DataFrame, config: M.FitConfig, by_label: bool = False, channels: tuple[str, ...] = (), missing: str = "global") -> DataFrame:
    """Posterior signals of every cell and gene that has a prior. With by_label each cell takes its label's priors; a
    label without any takes the global ones (missing="global") or raises (missing="error")."""
    rows = M.observations(m, by_label=by_label, positive=True).join(priors.select("gene_id").distinct(), "gene_id", "left_semi")
    have = priors.select(F.col("scope").alias("s_")).distinct()
    if by_label:
        own = rows.join(F.broadcast(have), F.col("scope") == F.col("s_"), "left")
        if missing == "error" and (lost := own.filter("s_ IS NULL").select("scope").limit(1).collect()):
            raise ValueError(f"no priors for {lost[0]['scope']}")
        mean = T.reference_counts(m).filter("n_ref > 0").agg(F.avg("n_ref").alias("all_mean"))
        rows = own.crossJoin(F.broadcast(mean)).withColumns({"scope": F.coalesce("s_", F.lit("global")), "n_mean": F.when(F.col("s_").isNull(), F.col("all_mean")).otherwise(F.col("n_mean"))})
        rows = rows.drop("s_", "all_mean")
    return M.infer(rows, priors, config, channels=channels)


def extract_kbulk(m: Matrix, priors: DataFrame, config: M.FitConfig, k: int, n: int, seed: int, balance: bool = True, unique: bool = False, by_label: bool = False, layers: bool = False) -> DataFrame:
    """Signals of aggregates of k cells of a class: label, sample_id, gene_id, k_sum, mean, zero_fraction, signal and
    entropies. by_label: under the label's priors, which all labels must have. layers: all layers of an output file, with
    their other names (map_mu, map_p, raw_counts)."""
    reference = T.reference_counts(m)
    plan = S.plan(reference, k, n, balance)
    chosen = (S.unique_combinations if unique else S.combinations)(m.obs, plan, k, seed)
    rows = S.aggregate(m.counts, reference, chosen, m.var, k).join(priors.select("gene_id").distinct(), "gene_id", "left_semi")
    scope = F.concat(F.lit("label:"), F.col("label").cast("string")) if by_label else F.lit("global")
    rows = rows.withColumns({"scope": scope, "k": F.col("k_sum"), "n_ref": F.col("exposure_sum")})
    if by_label and (lost := rows.select("scope").distinct().join(priors.select("scope").distinct(), "scope", "left_anti").limit(1).collect()):
        raise ValueError(f"no priors for {lost[0]['scope']}")
    out = M.infer(rows, priors, config, raw_exposure=True)
    few = ["label", "sample_id", "gene_id", "k_sum", "mean", "zero_fraction", "signal", "posterior_entropy", "mutual_information"]
    if not layers:
        return out.select(few)
    rate = F.col("map_support") if config.likelihood == "poisson" else F.lit(None).cast("double")
    others = {"map_mu": F.col("signal"), "map_p": F.col("map_probability"), "map_rate": rate, "raw_counts": F.col("k_sum")}
    return out.select(*few, "map_probability", "map_support", "prior_entropy", *[c.alias(name) for name, c in others.items()])


def gene_analysis(m: Matrix, gene: str, mode: str, config: M.FitConfig = M.FitConfig(), priors: DataFrame | None = None) -> DataFrame:
    """Signals of one gene in all cells: raw (counts by relative exposure), checkpoint (under given priors) or fit (under
    a prior fitted here, with the other genes as reference where there are any counts of them). A cell that has more of
    the gene than of all others has no likelihood under a fitted binomial: it takes no part in the fit, and its signal
    and entropies are null."""
    one = Matrix(m.counts.filter(F.col("gene_id") == gene), m.obs, m.var.filter(F.col("gene_id") == gene))
    others = m.var.filter(F.col("gene_id") != gene)
    reference = T.reference_counts(m, others)
    if mode != "fit" or not reference.filter("n_ref > 0").limit(1).count():
        reference = T.reference_counts(m)
    rows = M.observations(one, reference, positive=mode != "raw").filter("n_ref > 0")
    if mode == "raw":
        return rows.select("cell_id", "gene_id", "k", (F.col("k") / F.col("n_ref") * F.col("n_mean")).alias("signal"))
    if mode == "fit":
        same = rows.groupBy("scope", "gene_id", "k", "n_ref", "n_mean").agg(F.count(F.lit(1)).alias("weight"))
        ok = same.filter(F.col("k") <= F.col("n_ref")) if config.likelihood == "binomial" else same
        priors = M.fit_priors(ok, F.col("n_mean"), config)
    elif mode != "checkpoint" or priors is None:
        raise ValueError(f"cannot analyse by {mode!r} from what is given")
    out = ["cell_id", "gene_id", "k", "signal", "posterior_entropy", "mutual_information"]
    own = priors.filter(F.col("gene_id") == gene)
    if mode != "fit" or config.likelihood != "binomial":
        return M.infer(rows, own, config).select(out)
    beyond = rows.filter(F.col("k") > F.col("n_ref")).select("cell_id", "gene_id", "k", *[F.lit(None).cast("double").alias(c) for c in out[3:]])
    return M.infer(rows.filter(F.col("k") <= F.col("n_ref")), own, config).select(out).unionByName(beyond)


def ranked_curves(priors: DataFrame, top: int, axis: str = "scaled") -> DataFrame:
    """Curves of the genes whose priors have the largest entropy."""
    best = rank_genes_by_entropy(priors, top)
    return C.curve_points(priors.join(best.select("gene_id"), "gene_id", "left_semi"), axis)


def rank_genes_by_entropy(priors: DataFrame, top: int) -> DataFrame:
    scores = priors.groupBy("gene_id").agg(F.max(X.entropy(F.col("prob"))).alias("score"))
    return L.ranked(scores).filter(F.col("rank") <= top)


def full_layers(signals: DataFrame, m: Matrix, *layers: str) -> DataFrame:
    """cell_id, gene_id and layers for all cells and genes, missing ones as 0."""
    grid = m.obs.select("cell_id").crossJoin(F.broadcast(m.var.select("gene_id")))
    fill: dict[str, Column] = {c: F.coalesce(c, F.lit(0.0)) for c in layers}
    return grid.join(signals.select("cell_id", "gene_id", *layers), ["cell_id", "gene_id"], "left").withColumns(fill)
