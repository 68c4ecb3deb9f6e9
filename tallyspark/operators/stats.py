"""Totals, summaries and per-gene statistics of sparse matrices; zeros are accounted for without being written out,
except where quantiles need them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.order import cut, numbered
from tallyspark.functions.ship import ship
from tallyspark.sources.matrices import Matrix


def reference_counts(m: Matrix, genes: DataFrame | None = None) -> DataFrame:
    """cell_id, label, n_ref: each cell's sum over the reference genes (all by default); 0 for cells without counts."""
    counts = m.counts if genes is None else m.counts.join(genes.select("gene_id"), "gene_id", "left_semi")
    sums = counts.groupBy("cell_id").agg(F.sum("value").alias("n_ref"))
    return m.obs.join(sums, "cell_id", "left").select("cell_id", "label", F.coalesce("n_ref", F.lit(0)).alias("n_ref"))


def exposure(reference: DataFrame, scale: float | None = None, by: list[str] | None = None) -> DataFrame:
    """reference with n_eff = n_ref / mean(n_ref) * scale, the mean over the cells of a scope; scale defaults to it."""
    # One row of means for each scope is broadcast; a window would bring all cells of a scope into one task.
    keys = by or []
    means = reference.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.avg("n_ref").alias("__mean"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = reference.join(F.broadcast(means), same) if keys else reference.crossJoin(F.broadcast(means))
    n_eff = F.col("n_ref") / F.col("__mean") * (F.col("__mean") if scale is None else F.lit(float(scale)))
    return both.withColumn("n_eff", n_eff).select(*reference.columns, "n_eff")


def positive_reference(reference: DataFrame) -> DataFrame:
    return reference.filter("n_ref > 0")


def gene_totals(m: Matrix) -> DataFrame:
    """gene_id, total, detected (cells with a non-zero value); zeros for genes without counts."""
    sums = m.counts.groupBy("gene_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") != 0).alias("detected"))
    zero = F.lit(0)
    return m.var.join(sums, "gene_id", "left").select("gene_id", F.coalesce("total", zero).alias("total"), F.coalesce("detected", zero).alias("detected"))


def zero_fractions(m: Matrix) -> DataFrame:
    """cell_id, zero_fraction: the share of genes without a count."""
    hits = m.counts.filter("value <> 0").groupBy("cell_id").agg(F.count(F.lit(1)).alias("nnz"))
    genes = m.var.agg(F.count(F.lit(1)).alias("genes"))
    rows = m.obs.join(hits, "cell_id", "left").crossJoin(F.broadcast(genes))
    return rows.select("cell_id", (1 - F.coalesce("nnz", F.lit(0)) / F.col("genes")).alias("zero_fraction"))


def safe_corr(x: str, y: str) -> Column:
    """Correlation; 0 where either side is constant or there are fewer than two rows."""
    flat = (F.count(F.lit(1)) < 2) | (F.stddev_pop(x) <= 1e-12) | (F.stddev_pop(y) <= 1e-12)
    cov = F.covar_pop(x, y)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y)))


def frequencies(m: Matrix) -> DataFrame:
    """gene_id, value, n: how many cells have each value, zeros among them, without writing zeros out."""
    seen = m.counts.filter("value <> 0").groupBy("gene_id", F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    hits = seen.groupBy("gene_id").agg(F.sum("n").alias("hits"))
    cells = m.obs.agg(F.count(F.lit(1)).alias("cells"))
    zeros = m.var.join(hits, "gene_id", "left").crossJoin(F.broadcast(cells))
    zeros = zeros.select("gene_id", F.lit(0.0).alias("value"), (F.col("cells") - F.coalesce("hits", F.lit(0))).alias("n")).filter("n > 0")
    return seen.unionByName(zeros)


def gene_summary(m: Matrix) -> DataFrame:
    """Per gene over all cells: total, mean, median, p90, p99, max, detected share, and correlation with cell totals (0
    where either is constant). Quantiles come from the frequencies of values, the rest from sums over non-zeros."""
    totals = reference_counts(m).select("cell_id", F.col("n_ref").cast("double").alias("y"))
    whole = totals.agg(F.count(F.lit(1)).alias("cells"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    x = F.col("value").cast("double")
    sums = m.counts.join(totals, "cell_id").groupBy("gene_id").agg(
        F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * F.col("y")).alias("sxy"), F.count_if(x != 0).alias("detected")
    )
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("n"))
    spread = frequencies(m).groupBy("gene_id").agg(q.alias("q"), F.max("value").alias("max"))
    rows = spread.join(sums, "gene_id", "left").na.fill(0, ["sx", "sxx", "sxy", "detected"]).crossJoin(F.broadcast(whole))
    n = F.col("cells")
    var_x, var_y = F.col("sxx") / n - F.pow(F.col("sx") / n, F.lit(2)), F.col("syy") / n - F.pow(F.col("sy") / n, F.lit(2))
    cov = F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n
    corr = F.when((n < 2) | (var_x <= 1e-12) | (var_y <= 1e-12), F.lit(0.0)).otherwise(cov / F.sqrt(F.greatest(var_x, F.lit(0.0)) * F.greatest(var_y, F.lit(0.0))))
    share = F.col("detected") / n
    return rows.select(
        "gene_id", F.col("sx").alias("total"), (F.col("sx") / n).alias("mean"), F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"),
        F.col("q")[2].alias("p99"), "max", "detected", share.alias("detected_fraction"), (1 - share).alias("zero_fraction"), corr.alias("total_corr"),
    )


def dataset_summary(m: Matrix) -> DataFrame:
    totals = reference_counts(m)
    q = F.percentile("n_ref", F.array(F.lit(0.5), F.lit(0.99)))
    one = totals.agg(F.count(F.lit(1)).alias("cells"), F.avg("n_ref").alias("mean_total"), q.alias("q"), F.countDistinct("label").alias("labels"))
    genes = m.var.agg(F.count(F.lit(1)).alias("genes"))
    return one.crossJoin(genes).select("cells", "genes", "labels", "mean_total", F.col("q")[0].alias("median_total"), F.col("q")[1].alias("p99_total"))


def scale_diagnostics(reference: DataFrame) -> DataFrame:
    """Mean and 0.9 quantile of the positive references; the mean is the suggested scale."""
    rows = positive_reference(reference)
    return rows.agg(
        F.count(F.lit(1)).alias("positive_cells"), F.avg("n_ref").alias("mean_reference"), F.avg("n_ref").alias("suggested_scale"),
        F.percentile("n_ref", F.lit(0.9)).alias("q90_reference"),
    )


def class_means(reference: DataFrame) -> DataFrame:
    """label, class_mean, mean_of_means (unweighted over classes)."""
    means = reference.groupBy("label").agg(F.avg("n_ref").alias("class_mean"))
    return means.crossJoin(F.broadcast(means.agg(F.avg("class_mean").alias("mean_of_means"))))


def normalized(m: Matrix, target: float | None = None, floor: float = 1.0, log: bool = True) -> DataFrame:
    """counts scaled to a common total (by default the median of totals) per cell, and log1p of it. Zeros stay zeros."""
    totals = reference_counts(m)
    goal = totals.agg(F.percentile("n_ref", F.lit(0.5)).alias("goal")) if target is None else totals.agg(F.lit(float(target)).alias("goal"))
    rows = m.counts.join(totals.select("cell_id", "n_ref"), "cell_id").crossJoin(F.broadcast(goal))
    value = F.col("value") / F.greatest(F.col("n_ref"), F.lit(floor)) * F.col("goal")
    return rows.select("cell_id", "gene_id", (F.log1p(value) if log else value).alias("value"))


def moments(m: Matrix, values: DataFrame) -> DataFrame:
    """gene_id, mean, variance (population), dispersion (variance / mean), with the zeros of values counted in."""
    n = m.obs.agg(F.count(F.lit(1)).alias("n"))
    sums = values.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    rows = m.var.join(sums, "gene_id", "left").crossJoin(F.broadcast(n)).na.fill(0.0, ["s", "ss"])
    mean = F.col("s") / F.col("n")
    rows = rows.select("gene_id", mean.alias("mean"), F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"))
    return rows.withColumn("dispersion", F.col("variance") / F.greatest("mean", F.lit(1e-12)))


def fano(m: Matrix) -> DataFrame:
    """gene_id, mean, std, cv, fano; null where the mean is zero."""
    rows = moments(m, m.counts)
    mean = F.nullif(F.col("mean"), F.lit(0.0))
    return rows.select("gene_id", "mean", F.sqrt("variance").alias("std"), (F.sqrt("variance") / mean).alias("cv"), (F.col("variance") / mean).alias("fano"))


def log_signal(value: Column) -> Column:
    """log1p of a signal, with missing and negative values as 0."""
    return F.log1p(F.greatest(F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(0.0)), F.lit(0.0)))


def group_zscore(m: Matrix, genes: list[str]) -> DataFrame:
    """cell_id, score, z: sum of log2(x + 1) over genes, then z-scores with the sample deviation; null if that is zero."""
    rows = m.counts.filter(F.col("gene_id").isin(genes)).groupBy("cell_id").agg(F.sum(F.log2(F.col("value") + 1.0)).alias("score"))
    rows = m.obs.select("cell_id").join(rows, "cell_id", "left").na.fill(0.0, ["score"])
    whole = rows.agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"))
    z = (F.col("score") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))
    return rows.crossJoin(F.broadcast(whole)).select("cell_id", "score", z.alias("z"))


def marker_correlation(m: Matrix, genes: list[str], least: float) -> DataFrame:
    """gene_id, corr, kept: correlation of each gene of a set with the set's mean in a cell (itself included)."""
    rows = m.dense().filter(F.col("gene_id").isin(genes)).withColumn("value", F.col("value").cast("double"))
    mean = rows.groupBy("cell_id").agg(F.avg("value").alias("set_mean"))
    out = rows.join(mean, "cell_id").groupBy("gene_id").agg(safe_corr("value", "set_mean").alias("corr"))
    return out.withColumn("kept", F.col("corr") >= least)


def class_alignment(m: Matrix, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """label, gene_id, factor: what carries a class's gene mean to that of the most frequent class, within bounds."""
    cells = m.obs.groupBy("label").agg(F.count(F.lit(1)).alias("cells"))
    sums = m.counts.join(m.obs, "cell_id").groupBy("label", "gene_id").agg(F.sum("value").alias("s"))
    means = cells.crossJoin(m.var).join(sums, ["label", "gene_id"], "left").select("label", "gene_id", "cells", (F.coalesce("s", F.lit(0)) / F.col("cells")).alias("mean"))
    first = cells.orderBy(F.desc("cells"), "label").limit(1).select(F.col("label").alias("ref_label"))
    ref = means.join(F.broadcast(first), F.col("label") == F.col("ref_label")).select("gene_id", F.col("mean").alias("ref_mean"))
    ratio = F.least(F.greatest(F.col("ref_mean") / F.nullif("mean", F.lit(0.0)), F.lit(low)), F.lit(high))
    return means.join(F.broadcast(ref), "gene_id").select("label", "gene_id", F.coalesce(ratio, F.lit(1.0)).alias("factor"))


def label_columns(obs: DataFrame, columns: list[str], preferred: list[str], most: int = 64) -> DataFrame:
    """column, distinct_values of those with 2 to `most` distinct values (and no more than rows); preferred names first,
    then by name. position gives the order."""
    wide = obs.agg(F.count(F.lit(1)).alias("n"), *[F.countDistinct(c).alias(c) for c in columns])
    long = wide.unpivot(["n"], columns, "column", "distinct_values")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("column")), F.lit(0))
    keep = long.filter((F.col("distinct_values") >= 2) & (F.col("distinct_values") <= F.least(F.lit(most), F.col("n"))))
    keep = keep.withColumn("r", F.when(rank == 0, F.lit(1 << 30)).otherwise(rank))
    return keep.select("column", "distinct_values", F.row_number().over(Window.orderBy("r", "column")).alias("position"))


def label_counts(obs: DataFrame, most: int, least: int) -> DataFrame:
    """The most frequent labels with at least `least` cells: label, cells."""
    rows = obs.groupBy("label").agg(F.count(F.lit(1)).alias("cells")).filter(F.col("cells") >= least)
    return rows.orderBy(F.desc("cells"), "label").limit(most)


def histogram(values: DataFrame, bins: int, by: list[str]) -> DataFrame:
    """Counts of equal-width bins between the least and largest value of each group; the last bin is closed."""
    rows = values.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    ends = rows.groupBy(*by).agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    at = F.least(F.coalesce(F.floor((F.col("value") - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.join(ends, by).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mann_whitney(values: DataFrame, target: str, reference: str) -> DataFrame:
    """Per gene, ranks of target against reference cells (columns gene_id, label, value, zeros included): u, z (tie and
    continuity corrected) and log2 fold change. Values repeat, so ranks come from counts by value."""
    both = values.filter(F.col("label").isin(target, reference))
    return _rank_test(both.groupBy("gene_id", "value").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("label") == target).alias("t1")))


def mann_whitney_sparse(m: Matrix, target: str, reference: str) -> DataFrame:
    """mann_whitney() of a matrix's counts; zeros are what is left of the cells of either label."""
    cells = m.obs.filter(F.col("label").isin(target, reference))
    sizes = cells.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == target).alias("n1"))
    hits = m.counts.filter("value <> 0").join(cells.select("cell_id", "label"), "cell_id")
    tied = hits.groupBy("gene_id", "value").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("label") == target).alias("t1"))
    seen = tied.groupBy("gene_id").agg(F.sum("t").alias("s"), F.sum("t1").alias("s1"))
    zeros = m.var.join(seen, "gene_id", "left").crossJoin(F.broadcast(sizes))
    kind = dict(m.counts.dtypes)["value"]
    zeros = zeros.select("gene_id", F.lit(0).cast(kind).alias("value"), (F.col("n") - F.coalesce("s", F.lit(0))).alias("t"), (F.col("n1") - F.coalesce("s1", F.lit(0))).alias("t1"))
    return _rank_test(tied.unionByName(zeros.filter("t > 0")))


def _rank_test(tied: DataFrame) -> DataFrame:
    """The test from gene_id, value, t (cells that have the value) and t1 (those of the target among them)."""
    before = Window.partitionBy("gene_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tied.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    ranked = ranked.groupBy("gene_id").agg(
        F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum("t1").cast("double").alias("n1"), (F.sum("t") - F.sum("t1")).cast("double").alias("n2"),
        F.sum((F.pow("t", F.lit(3)) - F.col("t"))).alias("ties"),
        (F.sum(F.col("value") * F.col("t1")) / F.nullif(F.sum("t1"), F.lit(0))).alias("m1"),
        (F.sum(F.col("value") * (F.col("t") - F.col("t1"))) / F.nullif(F.sum("t") - F.sum("t1"), F.lit(0))).alias("m2"),
    )
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5) / F.nullif(sd, F.lit(0.0))
    fold = F.log2((F.col("m1") + 1e-9) / (F.col("m2") + 1e-9))
    return ranked.withColumn("u", u).select("gene_id", "u", z.alias("z"), fold.alias("log2_fold_change"))


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests with fdr: the least p * n / rank among p-values at least as large."""
    n = tests.agg(F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy(p)
    rows = tests.crossJoin(F.broadcast(n)).withColumn("__r", F.row_number().over(order))
    rows = rows.withColumn("__q", F.col(p) * F.col("__n") / F.col("__r"))
    return rows.withColumn("fdr", F.least(F.min("__q").over(Window.orderBy(F.desc(p), F.desc("__r"))), F.lit(1.0))).drop("__n", "__r", "__q")


def hvg_seurat(m: Matrix, bins: int = 20) -> DataFrame:
    """gene_id, dispersions_norm: log dispersion of exp(x) - 1, z-scored within equal-width bins of log mean (published
    formula; a bin of one gene gives 1)."""
    return _seurat(m, normalized(m, 1e4).withColumn("value", F.expm1("value")), bins)


def _seurat(m: Matrix, values: DataFrame, bins: int = 20) -> DataFrame:
    n = F.col("n")
    rows = moments(m, values).crossJoin(F.broadcast(m.obs.agg(F.count(F.lit(1)).alias("n"))))
    mean = F.greatest("mean", F.lit(1e-12))
    rows = cut(rows.select("gene_id", F.log1p("mean").alias("x"), F.ln(F.greatest(F.col("variance") * n / (n - 1) / mean, F.lit(1e-12))).alias("d")))  # ends are told by the same values
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.coalesce(F.floor((F.col("x") - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1)))
    w = Window.partitionBy("bin")
    z = (F.col("d") - F.avg("d").over(w)) / F.nullif(F.stddev_samp("d").over(w), F.lit(0.0))
    return rows.select("gene_id", F.coalesce(z, F.lit(1.0)).alias("dispersions_norm"))


def _with_bins(rows: DataFrame, edges: list[float]) -> DataFrame:
    """rows (gene_id, mean) with the number of percentiles of the mean that lie below it. A percentile may be a row's own
    mean, so both come from one evaluation: sums of doubles differ from one to the next."""
    rows = cut(rows)
    cuts = rows.agg(F.percentile("mean", F.array(*[F.lit(e) for e in edges])).alias("cuts"))
    below = F.size(F.filter("cuts", lambda c: c < F.col("mean")))
    return rows.crossJoin(F.broadcast(cuts)).withColumn("bin", below).drop("cuts")


def hvg_cell_ranger(m: Matrix) -> DataFrame:
    """gene_id, dispersions_norm: dispersion of exp(x) - 1 less the median of its bin of means, by the bin's median
    absolute deviation (times 1 / 0.6745); bins end at the 10th, 15th ... 100th percentile. Published formula."""
    values = normalized(m, 1e4).withColumn("value", F.expm1("value"))
    n = F.col("n")
    rows = moments(m, values).crossJoin(F.broadcast(m.obs.agg(F.count(F.lit(1)).alias("n"))))
    mean = F.greatest("mean", F.lit(1e-12))
    rows = _with_bins(rows.select("gene_id", mean.alias("mean"), (F.col("variance") * n / (n - 1) / mean).alias("d")), [p / 100 for p in range(10, 101, 5)])
    middle = rows.groupBy("bin").agg(F.median("d").alias("m"))
    off = rows.join(F.broadcast(middle), "bin").withColumn("off", F.abs(F.col("d") - F.col("m")))
    mad = off.groupBy("bin").agg((F.median("off") / 0.6744897501960817).alias("mad"))
    out = off.join(F.broadcast(mad), "bin")
    return out.select("gene_id", F.coalesce((F.col("d") - F.col("m")) / F.nullif("mad", F.lit(0.0)), F.lit(0.0)).alias("dispersions_norm"))


def _smooth(x: np.ndarray, y: np.ndarray, at: np.ndarray | None = None, k: int | None = None, block: int = 256) -> np.ndarray:
    """Local regression of degree 2 with tricube weights over the k nearest points (0.3 of all), at each x or those of at."""
    k = min(len(x), max(3, math.ceil(0.3 * len(x)))) if k is None else k
    centres = x if at is None else x[at]
    n = len(centres)
    out = np.empty(n)
    for a in range(0, n, block):
        d = np.abs(centres[a : a + block, None] - x)
        reach = np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1 : k], 1e-12)
        w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3
        off = x - centres[a : a + block, None]
        moments_ = np.stack([(w * off**p).sum(axis=1) for p in range(5)], axis=1)
        left = moments_[:, np.arange(3)[:, None] + np.arange(3)] + 1e-12 * np.eye(3)
        right = np.stack([(w * off**p * y).sum(axis=1) for p in range(3)], axis=1)
        out[a : a + block] = np.linalg.solve(left, right[..., None])[:, 0, 0]
    return out


def smoothed(points: DataFrame, span: float = 0.3, block: int = 512) -> DataFrame:
    """points (id, x, y) with fit: local regression of degree 2 with tricube weights over the nearest share `span` of all
    points. Points are numbered by x, and a block of them is fitted by one task, which gets the points that can be among
    their nearest: as many places to either side as a neighbourhood has points."""
    ship(points.sparkSession)
    n = points.count()
    k = min(n, max(3, math.ceil(span * n)))
    placed = numbered(points.select("id", "x", "y"), [], ["x", "id"])
    last = max(n - 1, 0) // block
    first = F.greatest(F.floor((F.col("pos") - k) / block), F.lit(0))
    reach = F.sequence(first.cast("int"), F.least(F.floor((F.col("pos") + k) / block), F.lit(last)).cast("int"))
    dealt = placed.withColumn("block", F.explode(reach))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        own = (pdf["pos"] // block == pdf["block"]).to_numpy()
        return pd.DataFrame({"id": pdf["id"][own], "fit": _smooth(pdf["x"].to_numpy(), pdf["y"].to_numpy(), own, k)})

    return dealt.groupBy("block").applyInPandas(fit, points.select("id").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", fit double")


def hvg_seurat_v3(m: Matrix) -> DataFrame:
    """gene_id, variances_norm: variance of counts standardised by what the mean leads to expect (a local regression of
    log variance on log mean, over sorted blocks of genes), values clipped at sqrt(cells) deviations."""
    cells = m.obs.agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    stats = cut(moments(m, m.counts).crossJoin(F.broadcast(cells)).select("gene_id", "mean", (F.col("variance") * n / (n - 1)).alias("variance")))
    some = stats.filter("variance > 0").select(F.col("gene_id").alias("id"), F.log10("mean").alias("x"), F.log10("variance").alias("y"))
    fits = smoothed(some) if some.limit(4).count() > 3 else some.select("id", F.col("y").alias("fit"))
    fitted = stats.join(fits, F.col("gene_id") == F.col("id"), "left").select("gene_id", "mean", F.coalesce(F.sqrt(F.pow(F.lit(10.0), F.col("fit"))), F.lit(0.0)).alias("sd"))
    rows = m.counts.join(fitted, "gene_id").crossJoin(F.broadcast(cells))
    clip = F.least(F.col("value").cast("double"), F.col("mean") + F.col("sd") * F.sqrt(n))
    sums = rows.groupBy("gene_id").agg(F.sum(clip).alias("s"), F.sum(clip * clip).alias("ss"))
    out = fitted.join(sums, "gene_id", "left").na.fill(0.0, ["s", "ss"]).crossJoin(F.broadcast(cells))
    v = (n * F.col("mean") * F.col("mean") + F.col("ss") - 2 * F.col("s") * F.col("mean")) / ((n - 1) * F.col("sd") * F.col("sd"))
    return out.select("gene_id", F.when(F.col("sd") > 0, v).otherwise(F.lit(0.0)).alias("variances_norm"))


def signal_hvg(m: Matrix, signals: DataFrame) -> DataFrame:
    """gene_id, dispersions_norm of a layer of signals: missing and negative ones as 0, log1p, then the seurat flavour."""
    layer = signals.select("cell_id", "gene_id", log_signal(F.col("signal")).alias("value")).filter("value <> 0")
    return _seurat(m, layer.withColumn("value", F.expm1("value")))


FLAVOURS = {
    "seurat": hvg_seurat, "cell_ranger": hvg_cell_ranger, "seurat_v3": hvg_seurat_v3, "seurat_v3_paper": hvg_seurat_v3,
}


def hvg(m: Matrix, flavour: str = "seurat") -> DataFrame:
    """gene_id, score: highly variable genes by one of FLAVOURS."""
    if flavour not in FLAVOURS:
        raise ValueError(f"unknown flavour {flavour!r}")
    out = FLAVOURS[flavour](m)
    return out.select("gene_id", F.col(out.columns[1]).alias("score"))
