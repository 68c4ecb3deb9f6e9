"""Discrete priors by EM, and posteriors from them.

Observations (scope, gene_id, k, n_ref) repeat a lot, so both fitting and inference work on distinct (gene, k, n_ref)
with multiplicities; zeros are one such key for each reference count, never rows of their own in the fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import expr as X
from tallyspark.functions.order import cut
from tallyspark.functions.ship import ship
from tallyspark.operators.checkpoints import warm_start
from tallyspark.operators.stats import reference_counts
from tallyspark.sources.matrices import Matrix

LIKELIHOODS = ("binomial", "negative_binomial", "poisson")


@dataclass(frozen=True)
class FitConfig:
    """How priors are fitted; names follow the command surface."""

    points: int = 512
    max_iterations: int | None = 100
    tolerance: float = 1e-6
    support_from: str = "observed_max"
    spacing: str = "linear"
    support_scale: float = 1.5
    likelihood: str = "binomial"
    overdispersion: float = 0.01
    adaptive: bool = False
    adaptive_scale: float = 1.5
    adaptive_quantile: float = 0.99
    #: Observations whose likelihoods are computed at once, and likelihoods (observations x points) that a task keeps; of
    #: more it computes them anew in each iteration.
    block: int = 1 << 14
    kept: int = 1 << 24

    def __post_init__(self):
        if self.points < 2 or self.likelihood not in LIKELIHOODS or self.support_from not in ("observed_max", "quantile"):
            raise ValueError("invalid fit configuration")
        if self.spacing not in ("linear", "sqrt") or self.tolerance <= 0 or self.support_scale <= 0 or self.overdispersion <= 0 or self.block < 1:
            raise ValueError("invalid fit configuration")


def observations(m: Matrix, reference: DataFrame | None = None, by_label: bool = False, positive: bool = False) -> DataFrame:
    """cell_id, scope, gene_id, k, n_ref, n_mean (mean reference of the scope), zeros included. With `positive` only cells
    of positive reference, whose mean n_mean is then, as in compressed()."""
    ref = reference_counts(m) if reference is None else reference
    ref = ref.filter("n_ref > 0") if positive else ref
    scope = F.concat(F.lit("label:"), F.coalesce(F.col("label").cast("string"), F.lit("nan"))) if by_label else F.lit("global")
    ref = ref.withColumn("scope", scope)
    # A row for each scope, so no task gets all cells of one.
    ref = ref.join(F.broadcast(ref.groupBy("scope").agg(F.avg("n_ref").alias("n_mean"))), "scope")
    grid = ref.select("cell_id", "scope", "n_ref", "n_mean").crossJoin(F.broadcast(m.var.select("gene_id")))
    return grid.join(m.counts, ["cell_id", "gene_id"], "left").select("cell_id", "scope", "gene_id", F.coalesce("value", F.lit(0)).alias("k"), "n_ref", "n_mean")


def compressed(m: Matrix, by_label: bool = False, genes: DataFrame | None = None) -> DataFrame:
    """scope, gene_id, k, n_ref, n_mean, weight: observations with multiplicities, of all genes or of those given (the
    reference is that of all). Zeros are what is left of the cells of each reference count, so the dense grid is never
    made; non-zero counts are read once, and the counts seen of a gene at a reference count stand in one array until
    zeros join them."""
    ref = reference_counts(m)
    scope = F.concat(F.lit("label:"), F.coalesce(F.col("label").cast("string"), F.lit("nan"))) if by_label else F.lit("global")
    ref = ref.withColumn("scope", scope).filter("n_ref > 0").select("cell_id", "scope", "n_ref")
    cells = ref.groupBy("scope", "n_ref").agg(F.count(F.lit(1)).alias("cells"))
    own = m if genes is None else m.with_genes(genes.select("gene_id").join(m.var, "gene_id", "left_semi").distinct())
    hits = own.counts.filter("value <> 0").join(ref, "cell_id").groupBy("scope", "gene_id", F.col("value").alias("k"), "n_ref").agg(F.count(F.lit(1)).alias("weight"))
    seen = hits.groupBy("scope", "gene_id", "n_ref").agg(F.collect_list(F.struct("k", "weight")).alias("ks"), F.sum("weight").alias("seen"))
    kind = dict(m.counts.dtypes)["value"]
    none = F.array(F.struct(F.lit(0).cast(kind).alias("k"), (F.col("cells") - F.coalesce("seen", F.lit(0))).alias("weight")))
    rows = cells.crossJoin(F.broadcast(own.var.select("gene_id"))).join(seen, ["scope", "gene_id", "n_ref"], "left")
    rows = rows.select("scope", "gene_id", "n_ref", F.explode(F.when(F.col("ks").isNull(), none).otherwise(F.concat("ks", none))).alias("x"))
    rows = rows.select("scope", "gene_id", "x.k", "n_ref", "x.weight").filter("weight > 0")
    mean = ref.groupBy("scope").agg(F.avg("n_ref").alias("n_mean"))
    return rows.join(F.broadcast(mean), "scope")


def effective(scale: Column | str = "scale", mean: Column | str = "n_mean") -> Column:
    """n_ref by the scale over the mean. The scale is divided first: where it is the mean, exposures are n_ref exactly, and
    support points that are equally likely stay so."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return F.col("n_ref") * (of(scale) / of(mean))


def check_binomial(rows: DataFrame, scale: Column) -> None:
    """Raises, naming a row, where a count exceeds its effective exposure."""
    bad = rows.filter(F.col("k") > effective(scale) + 1e-9).limit(1).collect()
    if bad:
        raise ValueError(f"counts <= effective_exposure does not hold: {bad[0].asDict()}")


def support_tops(rows: DataFrame, scale: Column, config: FitConfig = FitConfig()) -> DataFrame:
    """scope, gene_id, scale, top: the largest relative expression seen (or its 95th percentile), in [EPS, 1]; for
    rates the largest count. rows are compressed observations."""
    eff = effective(scale)
    if config.likelihood == "poisson":
        top = F.greatest(F.max("k").cast("double"), F.lit(X.EPS))
    elif config.support_from == "quantile":
        top = F.least(F.greatest(F.percentile(F.col("k") / eff, F.lit(0.95), F.col("weight")), F.lit(X.EPS)), F.lit(1.0))
    else:
        top = F.greatest(F.max(F.col("k") / eff * scale), F.max("k").cast("double")) / F.max(scale)
        top = F.least(F.greatest(top, F.lit(X.EPS)), F.lit(1.0))
    return rows.groupBy("scope", "gene_id").agg(F.max(scale).alias("scale"), top.alias("top"))


def initial_priors(tops: DataFrame, config: FitConfig) -> DataFrame:
    """scope, gene_id, scale, support, prob: a uniform prior over the grid up to the scaled top."""
    top = F.col("top") * config.support_scale
    if config.likelihood == "poisson":
        top = F.greatest(top, F.lit(X.EPS))
    else:
        top = F.least(F.greatest(top, F.lit(X.EPS)), F.lit(1.0))
    grid = X.let(top, lambda t: X.linear_grid(t, config.points, config.spacing == "sqrt"))
    return tops.select("scope", "gene_id", "scale", grid.alias("support"), X.uniform(config.points).alias("prob"))


def log_likelihood(config: FitConfig, k: Column, n: Column, support: Column) -> Column:
    if config.likelihood == "poisson":
        return X.log_poisson(k, support)
    if config.likelihood == "negative_binomial":
        return X.log_negative_binomial(k, n, support, config.overdispersion)
    return X.log_binomial(k, n, support)


def constant_term(config: FitConfig, k: Column, n: Column) -> Column:
    """What log_likelihood leaves out because it is the same for all support points."""
    if config.likelihood == "poisson":
        return F.lit(0.0)
    if config.likelihood == "negative_binomial":
        r = 1.0 / config.overdispersion
        return X.lgamma(k + r) - X.lgamma(k + 1) - F.lit(math.lgamma(r)) + r * math.log(r)
    return X.log_choose(k, n)


def em_step(rows: DataFrame, priors: DataFrame, config: FitConfig) -> DataFrame:
    """priors after one EM step: the weighted mean of posteriors, clamped and normalised."""
    n = effective()
    k = F.col("k").cast("double")
    met = rows.join(priors, ["scope", "gene_id"])
    post = met.select("scope", "gene_id", "weight", F.posexplode(X.posterior(log_likelihood(config, k, n, F.col("support")), F.col("prob"))).alias("j", "p"))
    sums = post.groupBy("scope", "gene_id", "j").agg(F.sum(F.col("p") * F.col("weight")).alias("w"))
    new = sums.groupBy("scope", "gene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda x: x["w"]).alias("w"))
    return priors.drop("prob").join(new, ["scope", "gene_id"]).select("scope", "gene_id", "scale", "support", X.normalised(F.col("w")).alias("prob"))


#: What a posterior is told by, whatever the channels.
SUMMARY = ("signal", "posterior_entropy", "prior_entropy", "mutual_information", "map_probability", "map_support")


def summarised(keys: DataFrame, priors: DataFrame, config: FitConfig, raw_exposure: bool = False, channels: tuple[str, ...] = ()) -> DataFrame:
    """keys (scope, gene_id, k, n_ref, n_mean unless raw_exposure) with the posterior's SUMMARY and channels."""
    n = F.col("n_ref").cast("double") if raw_exposure else effective()
    met = keys.join(priors, ["scope", "gene_id"])
    post = X.posterior(log_likelihood(config, F.col("k").cast("double"), n, F.col("support")), F.col("prob"))
    rate = config.likelihood == "poisson"

    def summary(p: Column) -> Column:
        return F.struct(p.alias("posterior"), X.argmax(p).alias("i"), X.entropy(p).alias("h"))

    met = met.withColumn("s", X.let(post, summary)).withColumn("prior_entropy", X.entropy(F.col("prob")))
    at = F.get("support", F.col("s.i"))
    extra = {
        "posterior": F.col("s.posterior"), "support": F.col("support"), "prior": F.col("prob"), "map_scaled_support": at * F.col("scale"),
        "map_rate": at if rate else F.lit(None).cast("double"), "scaled_support": F.transform("support", lambda x: x * F.col("scale")),
    }
    return met.select(
        *keys.columns,
        (at if rate else at * F.col("scale")).alias("signal"),
        F.col("s.h").alias("posterior_entropy"),
        "prior_entropy",
        F.greatest(F.col("prior_entropy") - F.col("s.h"), F.lit(0.0)).alias("mutual_information"),
        (F.lit(None).cast("double") if rate else at).alias("map_probability"),
        at.alias("map_support"),
        *[extra[c].alias(c) for c in channels],
    )


def infer(rows: DataFrame, priors: DataFrame, config: FitConfig, raw_exposure: bool = False, channels: tuple[str, ...] = ()) -> DataFrame:
    """rows (scope, gene_id, k, n_ref, n_mean and others) with signal, posterior_entropy, prior_entropy,
    mutual_information, map_probability (null for rates), map_support; further channels: posterior, support, prior,
    scaled_support, map_scaled_support, map_rate (null for probabilities).

    Posteriors are computed once for each distinct (scope, gene, k, n_ref) and joined back, or for each row where k or
    n_ref is a double: a sum of doubles may come out with another last digit when it is evaluated a second time, and rows
    would not meet their posteriors. raw_exposure takes n_ref as it is, as aggregates of several cells do. For the cells
    of a matrix see signals(), which makes no rows of zeros.
    """
    keys = ["scope", "gene_id", "k", "n_ref"] if raw_exposure else ["scope", "gene_id", "k", "n_ref", "n_mean"]
    kinds = dict(rows.dtypes)
    if not {kinds["k"], kinds["n_ref"]} & {"float", "double"}:
        return rows.join(summarised(rows.select(*keys).distinct(), priors, config, raw_exposure, channels), keys)
    others = [c for c in rows.columns if c not in keys]
    known = rows.filter(F.col("k").isNotNull() & F.col("n_ref").isNotNull())
    told = summarised(known.select(*keys, F.struct(*others, F.lit(0).alias("__none")).alias("__others")), priors, config, raw_exposure, channels)
    return told.select(*keys, *[F.col("__others")[c].alias(c) for c in others], *SUMMARY, *channels)


@dataclass(frozen=True)
class Signals:
    """Posteriors of a matrix, factored: rows of non-zero counts (cell_id, gene_id, k and values), and what a count of zero
    comes to (scope, gene_id, n_ref, n_mean and values), a row for each gene and reference count, whatever the cells.

    cells: cell_id, label, scope, n_ref, n_mean of the cells of positive reference. genes: the matrix's gene_id.
    """

    hits: DataFrame
    zeros: DataFrame
    cells: DataFrame
    genes: DataFrame
    values: tuple[str, ...]

    def expanded(self, most: int = 1024) -> DataFrame:
        """cell_id, scope, gene_id, k, n_ref, n_mean and values of all cells and genes with a prior. Zeros are laid out for
        each reference count once, in chunks of about `most` genes; cells meet them there, and their own rows go in
        between, so that what is shuffled is sparse and the full grid is written where it is made."""
        n = self.genes.agg(F.ceil(F.count(F.lit(1)) / most).alias("chunks"))
        chunk = F.pmod(F.xxhash64("gene_id"), F.greatest(F.col("chunks"), F.lit(1)))
        fields = F.struct("gene_id", "k", *self.values)
        hits = self.hits.crossJoin(F.broadcast(n)).groupBy("cell_id", chunk.alias("chunk")).agg(F.collect_list(fields).alias("own"))
        zeros = self.zeros.withColumn("k", F.lit(0).cast(dict(self.hits.dtypes)["k"])).crossJoin(F.broadcast(n))
        zeros = zeros.groupBy("scope", "n_ref", chunk.alias("chunk")).agg(F.collect_list(fields).alias("none"))
        cells = self.cells.crossJoin(F.broadcast(n)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("chunks"), F.lit(1)) - 1)))
        met = cells.join(hits, ["cell_id", "chunk"], "left").join(zeros, ["scope", "n_ref", "chunk"])
        taken = F.transform("own", lambda x: x["gene_id"])
        rest = F.when(F.col("own").isNull(), F.col("none")).otherwise(F.concat("own", F.filter("none", lambda z: ~F.array_contains(taken, z["gene_id"]))))
        rows = met.select("cell_id", "scope", "n_ref", "n_mean", F.explode(rest).alias("x"))
        return rows.select("cell_id", "scope", "x.gene_id", "x.k", "n_ref", "n_mean", *[f"x.{c}" for c in self.values])


def signals(m: Matrix, priors: DataFrame, config: FitConfig, reference: DataFrame | None = None, by_label: bool = False, channels: tuple[str, ...] = (), cells: DataFrame | None = None) -> Signals:
    """Posteriors of all cells of positive reference and of all genes with a prior, see Signals and infer(). cells: the
    cells with their scope and n_mean, where scopes are not the labels or one for all."""
    if cells is None:
        ref = reference_counts(m) if reference is None else reference
        scope = F.concat(F.lit("label:"), F.coalesce(F.col("label").cast("string"), F.lit("nan"))) if by_label else F.lit("global")
        ref = ref.withColumn("scope", scope).filter("n_ref > 0")
        cells = ref.join(F.broadcast(ref.groupBy("scope").agg(F.avg("n_ref").alias("n_mean"))), "scope")  # a row for each scope
    cells = cells.select("cell_id", "label", "scope", "n_ref", "n_mean")
    keys = ["scope", "gene_id", "k", "n_ref", "n_mean"]
    values = (*SUMMARY, *channels)
    seen = m.counts.filter("value <> 0").select("cell_id", "gene_id", F.col("value").alias("k")).join(cells.drop("label"), "cell_id")
    hits = seen.join(summarised(seen.select(*keys).distinct(), priors, config, channels=channels), keys)
    kind = dict(m.counts.dtypes)["value"]
    each = cells.select("scope", "n_ref", "n_mean").distinct().join(priors.select("scope", "gene_id"), "scope")
    zeros = summarised(each.select("scope", "gene_id", F.lit(0).cast(kind).alias("k"), "n_ref", "n_mean"), priors, config, channels=channels).drop("k")
    return Signals(hits.select("cell_id", "gene_id", "k", *values), zeros, cells, m.var.select("gene_id"), values)


def gene_nll(rows: DataFrame, priors: DataFrame, config: FitConfig) -> DataFrame:
    """scope, gene_id, nll: minus the mean log evidence over cells."""
    n = effective()
    k = F.col("k").cast("double")
    z = X.log_evidence(log_likelihood(config, k, n, F.col("support")), F.col("prob")) + constant_term(config, k, n)
    met = rows.join(priors, ["scope", "gene_id"]).select("scope", "gene_id", "weight", z.alias("z"))
    return met.groupBy("scope", "gene_id").agg((-F.sum(F.col("z") * F.col("weight")) / F.sum("weight")).alias("nll"))


def diagnostics(priors: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Where a prior's mass lies: quantile_index, map_index, edge_mass, tail_mass (the last 2 %, at least 2 points),
    and whether the support should grow."""
    p = F.col("prob")
    m = F.size(p)
    tail = F.greatest(F.lit(2), F.ceil(m * 0.02).cast("int"))
    rows = priors.select(
        "scope", "gene_id", X.quantile_index(p, quantile).alias("quantile_index"), X.argmax(p).alias("map_index"),
        F.element_at(p, -1).alias("edge_mass"), X.total(F.slice(p, m - tail + 1, tail)).alias("tail_mass"), m.alias("m"), tail.alias("tail"),
    )
    at_edge = (F.col("quantile_index") >= F.col("m") - 1) | (F.col("map_index") >= F.col("m") - 1)
    near = (F.col("quantile_index") >= F.col("m") - F.col("tail")) | (F.col("map_index") >= F.col("m") - F.col("tail"))
    grow = at_edge | (F.col("edge_mass") >= 0.01) | (near & (F.col("tail_mass") >= 0.05))
    return rows.select("scope", "gene_id", "quantile_index", "map_index", "edge_mass", "tail_mass", grow.alias("expand"))


# The converged fit: one group of genes at a time, in numpy.


def _likelihoods(config: FitConfig, k: np.ndarray, n: np.ndarray, support: np.ndarray) -> np.ndarray:
    gamma = np.vectorize(math.lgamma, otypes=[float])
    if config.likelihood == "poisson":
        rate = np.maximum(support, X.EPS)
        return k[:, None] * np.log(rate) - rate
    p = np.clip(support, X.EPS, 1 - X.EPS)
    if config.likelihood == "negative_binomial":
        r = 1 / config.overdispersion
        mean = n[:, None] * p
        return (gamma(k + r) - gamma(k + 1) - math.lgamma(r) + r * math.log(r))[:, None] + k[:, None] * np.log(mean + X.EPS) - (k + r)[:, None] * np.log(r + mean)
    if (k > n + 1e-9).any():
        raise ValueError("counts <= effective_exposure does not hold")
    choose = gamma(n + 1) - gamma(k + 1) - gamma(np.maximum(n - k, 0) + 1)
    return choose[:, None] + k[:, None] * np.log(p) + (n - k)[:, None] * np.log1p(-p)


class _Blocks:
    """Likelihoods of genes' observations, a block of observations at a time."""

    def __init__(self, config: FitConfig, genes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], supports: list[np.ndarray]):
        self.config, self.genes, self.supports = config, genes, supports
        size = sum(len(k) * len(s) for (k, _, _), s in zip(genes, supports, strict=True))
        self.known = [[*self._made(i)] for i in range(len(genes))] if size <= config.kept else None

    def _made(self, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k, n, w = self.genes[i]
        for at in range(0, len(k), self.config.block):
            part = slice(at, at + self.config.block)
            yield w[part], _likelihoods(self.config, k[part], n[part], self.supports[i])

    def of(self, i: int):
        """(weights, likelihoods) of the blocks of a gene."""
        return self._made(i) if self.known is None else self.known[i]


def _expected(blocks, prior: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Summed posteriors, log evidence and weight of a gene's observations under a prior."""
    total, z_sum, w_sum = np.zeros(len(prior)), 0.0, 0.0
    known = np.log(np.maximum(prior, X.EPS))
    for w, ll in blocks:
        joint = ll + known
        top = joint.max(axis=1)
        e = np.exp(joint - top[:, None])
        s = e.sum(axis=1)
        z = top + np.log(s)
        if not np.isfinite(z).all():
            raise ValueError("observation with zero likelihood under every support point")
        total += (w / s) @ e
        z_sum, w_sum = z_sum + float(w @ z), w_sum + float(w.sum())
    return total, z_sum, w_sum


def _climb(config: FitConfig, genes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], supports: list[np.ndarray], priors: list[np.ndarray]):
    """EM for a batch of genes, which stop together. genes: k, n, weight of each."""
    blocks = _Blocks(config, genes, supports)
    history: list[float] = []
    for _ in range(10_000 if config.max_iterations is None else config.max_iterations):
        moved, z_sum, w_sum, new = 0.0, 0.0, 0.0, []
        for i, prior in enumerate(priors):
            total, z, w = _expected(blocks.of(i), prior)
            p = np.maximum(total, X.EPS)
            p /= p.sum()
            moved = max(moved, float(np.abs(p - prior).max()))
            z_sum, w_sum = z_sum + z, w_sum + w
            new.append(p)
        priors = new
        history.append(-z_sum / w_sum)
        if moved < config.tolerance:
            break
    return priors, history


def refined_top(config: FitConfig, support: np.ndarray, prob: np.ndarray) -> float:
    """The top of a better support: wider if mass piles up at its right end, else narrowed to a quantile."""
    m = len(prob)
    tail = max(2, math.ceil(0.02 * m))
    q = min(int(np.searchsorted(np.cumsum(prob), config.adaptive_quantile)), m - 1)
    best = int(prob.argmax())
    edge = q >= m - 1 or best >= m - 1 or prob[-1] >= 0.01
    near = (q >= m - tail or best >= m - tail) and prob[-tail:].sum() >= 0.05
    if edge or near:
        top = support[-1] * config.adaptive_scale
        return top if config.likelihood == "poisson" else min(top, 1.0)
    return min(max(support[q] * config.adaptive_scale, support[-1] / (m - 1)), support[-1])


def _carried(support: np.ndarray, prob: np.ndarray, grid: np.ndarray) -> np.ndarray:
    p = np.maximum(np.interp(grid, support, prob, left=0.0, right=0.0), X.EPS)
    return p / p.sum()


FIT_SCHEMA = "scope string, gene_id string, scale double, support array<double>, prob array<double>, final_objective double, n_iter int, rounds int"


def _fitted(config: FitConfig):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [*pdf.groupby("gene_id", sort=True)]
        genes = []
        for _, g in parts:
            n = g["n_ref"].to_numpy(float) * (g["scale"].to_numpy(float) / g["n_mean"].to_numpy(float))
            genes.append((g["k"].to_numpy(float), n, g["weight"].to_numpy(float)))
        supports = [np.array(g["support"].iloc[0], float) for _, g in parts]
        priors = [np.array(g["prob"].iloc[0], float) for _, g in parts]
        priors, history = _climb(config, genes, supports, priors)
        rounds = 0
        while config.adaptive and rounds < 2:
            tops = [refined_top(config, s, p) for s, p in zip(supports, priors, strict=True)]
            if all(abs(t - s[-1]) <= 1e-12 for t, s in zip(tops, supports, strict=True)):
                break
            grids = [np.linspace(0, t, len(s)) for t, s in zip(tops, supports, strict=True)]
            priors = [_carried(s, p, g) for s, p, g in zip(supports, priors, grids, strict=True)]
            supports = grids
            priors, history = _climb(config, genes, supports, priors)
            rounds += 1
        return pd.DataFrame({
            "scope": pdf["scope"].iloc[0], "gene_id": [name for name, _ in parts], "scale": pdf["scale"].iloc[0], "support": supports,
            "prob": priors, "final_objective": history[-1] if history else math.nan, "n_iter": len(history), "rounds": rounds,
        })

    return fit


def fit_priors(rows: DataFrame, scale: Column, config: FitConfig = FitConfig(), batch: int = 1, warm: DataFrame | None = None, same_likelihood: bool = True) -> DataFrame:
    """Priors fitted to convergence from compressed observations: FIT_SCHEMA.

    Genes of a batch stop together; batch 1 stops each gene by itself. warm: priors to start from (scope, gene_id,
    prob), used where they cover a whole batch, see checkpoints.warm_start(). Raises where a count exceeds its effective
    exposure under a binomial. A group holds the distinct (k, n_ref) of a batch's genes, which grows with the spread of
    counts, not with cells.
    """
    ship(rows.sparkSession)
    priors = initial_priors(support_tops(rows, scale, config), config)
    place = priors.select("scope", "gene_id").withColumn("b", F.floor((F.row_number().over(Window.partitionBy("scope").orderBy("gene_id")) - 1) / batch))
    if warm is not None:
        priors = warm_start(priors, warm, place, same_likelihood)
    met = rows.join(priors, ["scope", "gene_id"]).withColumn("k", F.col("k").cast("double"))
    met = met.join(place, ["scope", "gene_id"])
    return met.groupBy("scope", "b").applyInPandas(_fitted(config), FIT_SCHEMA)


def _partial(config: FitConfig):
    """Summed posteriors of a part's observations (k, n, weight) under its prior, with log evidence and weight."""

    def sums(rows: pa.Table, prior: pa.Table) -> pa.Table:
        k, n, w = (rows.column(c).to_numpy() for c in ("k", "n", "weight"))
        support, p = (np.array(prior.column(c)[0].as_py(), float) for c in ("support", "prob"))
        if len(k):
            total, z, weight = _expected(_Blocks(replace(config, kept=0), [(k, n, w)], [support]).of(0), p)
        else:
            total, z, weight = np.zeros(len(p)), 0.0, 0.0
        return pa.table({"scope": prior.column("s_"), "gene_id": prior.column("g_"), "u": [total.tolist()], "z": [z], "w": [weight]})

    return sums


def fit_large(rows: DataFrame, scale: Column, config: FitConfig = FitConfig(), part: int = 1 << 18) -> DataFrame:
    """fit_priors() of genes whose observations are too many for one task, each gene stopping by itself: FIT_SCHEMA.

    Observations are dealt by hash into parts of about `part`; in each iteration every part sums its posteriors, a block
    at a time, and the parts' sums are added up point by point. What is held at once are a block's likelihoods; priors, a
    row for each gene, go to the checkpoint folder after each iteration, so a lost executor costs tasks. Supports that
    adapt are left to fit_priors().
    """
    if config.adaptive:
        raise ValueError("large fits do not adapt supports")
    ship(rows.sparkSession)
    priors = cut(initial_priors(support_tops(rows, scale, config), config))
    sizes = cut(rows.groupBy("scope", "gene_id").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts")))
    n = effective(scale).alias("n")
    dealt = rows.join(sizes, ["scope", "gene_id"]).withColumn("part", F.pmod(F.xxhash64("k", "n_ref", "weight"), F.col("parts")))
    dealt = cut(dealt.select("scope", "gene_id", "part", F.col("k").cast("double").alias("k"), n, F.col("weight").cast("double").alias("weight")))
    done, t = None, 0
    most = 10_000 if config.max_iterations is None else config.max_iterations
    priors = priors.withColumns({"final_objective": F.lit(None).cast("double"), "n_iter": F.lit(0)})
    while t < most and priors.limit(1).count():
        t += 1
        told = priors.select("scope", "gene_id", "support", "prob").join(sizes, ["scope", "gene_id"])
        told = told.select(F.col("scope").alias("s_"), F.col("gene_id").alias("g_"), "support", "prob", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p_"))
        open_ = dealt.join(priors.select("scope", "gene_id"), ["scope", "gene_id"], "left_semi")
        sums = open_.groupBy("scope", "gene_id", "part").cogroup(told.groupBy("s_", "g_", "p_")).applyInArrow(_partial(config), "scope string, gene_id string, u array<double>, z double, w double")
        each = sums.select("scope", "gene_id", "z", "w", F.posexplode("u").alias("j", "u"))
        points = each.groupBy("scope", "gene_id", "j").agg(F.sum("u").alias("u"), F.sum("z").alias("z"), F.sum("w").alias("w"))
        new = points.groupBy("scope", "gene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "u"))), lambda x: x["u"]).alias("u"), (-F.max("z") / F.max("w")).alias("objective"))
        now = priors.drop("final_objective", "n_iter").withColumnRenamed("prob", "old").join(new, ["scope", "gene_id"]).withColumn("prob", X.normalised(F.col("u")))
        moved = F.array_max(F.zip_with("prob", "old", lambda a, b: F.abs(a - b)))
        now = cut(now.select("scope", "gene_id", "scale", "support", "prob", F.col("objective").alias("final_objective"), F.lit(t).alias("n_iter"), (moved < config.tolerance).alias("settled")))
        still = now.filter("NOT settled") if t < most else now.limit(0)
        ready = (now.filter("settled") if t < most else now).drop("settled")
        done = ready if done is None else done.unionByName(ready)
        priors = still.drop("settled")
    return (priors if done is None else done).withColumn("rounds", F.lit(0))


def scale_of(m: Matrix) -> float:
    """The default scale: the mean of positive reference counts."""
    return float(reference_counts(m).filter("n_ref > 0").agg(F.avg("n_ref")).first()[0])




class PriorEngine:
    """Priors of a matrix, fitted gene by gene as they are asked for. A fit covers the genes that have none yet; priors
    are tables, so get_prior() is lazy."""

    def __init__(self, m: Matrix, config: FitConfig = FitConfig(), scale: float | None = None, by_label: bool = False):
        self.matrix, self.config, self.by_label = m, config, by_label
        self.scale = F.col("n_mean") if scale is None else F.lit(float(scale))
        self.priors: DataFrame | None = None

    def missing(self, genes: DataFrame) -> DataFrame:
        return genes if self.priors is None else genes.join(self.priors.select("gene_id").distinct(), "gene_id", "left_anti")

    def is_fitted(self, gene: str) -> bool:
        return self.priors is not None and self.priors.filter(F.col("gene_id") == gene).limit(1).count() > 0

    def is_all_fitted(self, genes: DataFrame) -> bool:
        return self.missing(genes.select("gene_id")).limit(1).count() == 0

    def fit(self, genes: DataFrame, batch: int = 1) -> DataFrame:
        """Fit the genes that have no prior yet; returns the report of this fit."""
        todo = self.missing(genes.select("gene_id"))
        rows = compressed(self.matrix, self.by_label).join(todo, "gene_id", "left_semi")
        new = fit_priors(rows, self.scale, self.config, batch)
        self.priors = new if self.priors is None else self.priors.unionByName(new)
        return report(new)

    def get_prior(self, gene: str) -> DataFrame:
        if not self.is_fitted(gene):
            raise KeyError(gene)
        return self.priors.filter(F.col("gene_id") == gene)


def report(fitted: DataFrame) -> DataFrame:
    """scope, genes, iterations (most of any batch), adaptive rounds, mean final objective, and the mean entropy of priors."""
    h = X.entropy(F.col("prob"))
    return fitted.groupBy("scope").agg(
        F.count(F.lit(1)).alias("genes"), F.max("n_iter").alias("iterations"), F.max("rounds").alias("rounds"), F.avg("final_objective").alias("objective"), F.avg(h).alias("prior_entropy")
    )
