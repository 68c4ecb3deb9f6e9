"""Reports on priors: curves, summaries, similarity of labels, and checkpoints as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import expr as X
from tallyspark.functions.order import cut
from tallyspark.functions.text import display_source
from tallyspark.operators.checkpoints import check_same_genes
from tallyspark.sources.versions import commit, current

#: Version that a checkpoint must bear.
SCHEMA_VERSION = "1"


def x_axis(axis: str) -> Column:
    """The curve's x: support as it is, or scaled."""
    return F.col("support") if axis == "support" else F.transform("support", lambda x: x * F.col("scale"))


def curve_points(priors: DataFrame, axis: str = "scaled") -> DataFrame:
    """scope, gene_id, j, x, prob, cdf of every support point."""
    rows = priors.select("scope", "gene_id", F.arrays_zip(x_axis(axis).alias("x"), F.col("prob").alias("p"), X.cumulative(F.col("prob")).alias("c")).alias("z"))
    return rows.select("scope", "gene_id", F.posexplode("z").alias("j", "z")).select("scope", "gene_id", "j", "z.x", F.col("z.p").alias("prob"), F.col("z.c").alias("cdf"))


def curve_summaries(priors: DataFrame, axis: str = "scaled") -> DataFrame:
    """scope, gene_id, mean, map, entropy of every prior."""
    rows = priors.withColumn("x", x_axis(axis))
    mean = X.total(F.zip_with("x", "prob", lambda a, b: a * b))
    return rows.select("scope", "gene_id", mean.alias("mean"), F.get("x", X.argmax(F.col("prob"))).alias("map"), X.entropy(F.col("prob")).alias("entropy"))


def display_cutoff(priors: DataFrame, q: float, axis: str = "scaled") -> DataFrame:
    """scope, gene_id, cutoff: the first x whose cumulated probability reaches q."""
    return priors.withColumn("x", x_axis(axis)).select("scope", "gene_id", F.get("x", X.quantile_index(F.col("prob"), q)).alias("cutoff"))


def label_similarity(priors: DataFrame, metric: str = "jsd", most: int = 50) -> DataFrame:
    """label_a, label_b, value: mean JSD or overlap over the first `most` genes (by name) that all labels have, with
    the two supports laid over each other (points that one lacks have probability 0 there)."""
    priors = cut(priors)  # they are read four times
    scopes = priors.select("scope").distinct().count()
    if scopes < 2:
        raise ValueError("at least two labels are needed")
    genes = priors.groupBy("gene_id").agg(F.countDistinct("scope").alias("n")).filter(F.col("n") == scopes).orderBy("gene_id").limit(most).select("gene_id")
    points = priors.join(F.broadcast(genes), "gene_id").select("scope", "gene_id", F.explode(F.arrays_zip(x_axis("scaled").alias("x"), F.col("prob").alias("p"))).alias("z"))
    points = points.select("scope", "gene_id", "z.x", "z.p")
    pairs = priors.select(F.col("scope").alias("a")).distinct().crossJoin(priors.select(F.col("scope").alias("b")).distinct())
    left = points.join(F.broadcast(pairs), F.col("scope") == F.col("a")).select("a", "b", "gene_id", "x", F.col("p"), F.lit(0.0).alias("q"))
    right = points.join(F.broadcast(pairs), F.col("scope") == F.col("b")).select("a", "b", "gene_id", "x", F.lit(0.0).alias("p"), F.col("p").alias("q"))
    both = left.union(right).groupBy("a", "b", "gene_id", "x").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    side = lambda c: F.col(c) * F.ln(F.greatest(F.col(c), F.lit(X.EPS)) / F.greatest(m, F.lit(X.EPS)))
    each = F.sum(0.5 * side("p") + 0.5 * side("q")) if metric == "jsd" else F.sum(F.least("p", "q"))
    per_gene = both.groupBy("a", "b", "gene_id").agg(each.alias("v"))
    return per_gene.groupBy(F.col("a").alias("label_a"), F.col("b").alias("label_b")).agg(F.avg("v").alias("value"))


def save_checkpoint(priors: DataFrame, path: str, meta: dict) -> None:
    """Tables priors (partitioned by scope) and meta, which together replace what was there once both are written. meta
    gets the defaults that readers rely on: a likelihood, and the mode that the scopes show."""
    spark = priors.sparkSession
    kinds = {r["k"] for r in priors.select((F.col("scope") == "global").alias("k")).distinct().collect()}
    mode = {frozenset({True}): "global", frozenset({False}): "by-label"}.get(frozenset(kinds), "both")
    text = json.dumps({"likelihood": "binomial", "fit_mode": mode, "fit_config": {}} | meta | {"schema_version": SCHEMA_VERSION}, sort_keys=True)

    def tables(folder: str) -> None:
        priors.write.partitionBy("scope").parquet(f"{folder}/priors")
        spark.createDataFrame([(text,)], "meta string").coalesce(1).write.parquet(f"{folder}/meta")

    commit(spark, path, tables)


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(priors, meta); raises on another version."""
    path = current(spark, path)
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    if meta.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"checkpoint version {meta.get('schema_version')!r}; {SCHEMA_VERSION!r} is needed")
    return spark.read.parquet(f"{path}/priors"), meta


def inspect(priors: DataFrame) -> DataFrame:
    """scope, genes, points, least and largest scale."""
    return priors.groupBy("scope").agg(F.countDistinct("gene_id").alias("genes"), F.max(F.size("support")).alias("points"), F.min("scale").alias("scale_min"), F.max("scale").alias("scale_max"))


def check_priors(priors: DataFrame, rate: bool = False) -> None:
    """Raises on probabilities that are negative or do not sum to 1, on supports out of their domain (0 to 1, and for
    rates from 0), and on scopes that do not hold the same genes."""
    low = F.exists("support", lambda x: (x < 0) | x.isNull() | F.isnan(x))
    high = F.lit(False) if rate else F.exists("support", lambda x: x > 1)
    bad = F.exists("prob", lambda p: p < 0) | (F.abs(X.total(F.col("prob")) - 1) > 1e-6) | low | high
    if priors.filter(bad).limit(1).count():
        raise ValueError("invalid prior")
    check_same_genes(priors)


def full_matrix(signals: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """cell_id, gene_id, signal for all cells and genes; null where nothing was extracted."""
    return obs.select("cell_id").crossJoin(F.broadcast(var.select("gene_id"))).join(signals.select("cell_id", "gene_id", "signal"), ["cell_id", "gene_id"], "left")


def curve_rows(checkpoints: dict[str, DataFrame], genes: DataFrame, axis: str = "auto", missing: str = "error", rate: bool | None = None) -> DataFrame:
    """Points of the curves of genes (pos, gene_id) in several checkpoints, one row each: source, checkpoint, scope,
    label, gene_id, gene_pos, j, support, scaled_support, x, prob, cdf, scale. missing: "error" raises on a gene that no
    source has, "skip" leaves it out. axis auto: support for rates, else scaled; rate, if it is not given: whether any
    support goes beyond 1."""
    if missing not in ("error", "skip"):
        raise ValueError(f"unknown policy {missing!r}")
    all_ = None
    for name, priors in checkpoints.items():
        one = priors.select(F.lit(name).alias("checkpoint"), "scope", "gene_id", "scale", "support", "prob")
        all_ = one if all_ is None else all_.unionByName(one)
    if all_ is None:
        raise ValueError("at least one checkpoint is needed")
    if missing == "error" and (lost := genes.join(all_.select("gene_id").distinct(), "gene_id", "left_anti").limit(1).collect()):
        raise ValueError(f"no source has the gene {lost[0]['gene_id']}")
    if axis == "auto" and rate is None:
        rate = bool(all_.filter(F.exists("support", lambda p: p > 1)).limit(1).count())
    source = display_source(F.col("scope"), F.col("checkpoint") if len(checkpoints) > 1 else None)
    label = F.when(F.col("scope") != "global", F.expr("substring(scope, 7)"))
    scaled = F.transform("support", lambda x: x * F.col("scale"))
    x = F.col("support") if axis in ("support", "rate") or (axis == "auto" and rate) else scaled
    points = F.arrays_zip(F.col("support").alias("s"), scaled.alias("t"), x.alias("x"), F.col("prob").alias("p"), X.cumulative(F.col("prob")).alias("c"))
    rows = all_.join(genes.select("gene_id", F.col("pos").alias("gene_pos")), "gene_id")
    rows = rows.select(source.alias("source"), "checkpoint", "scope", label.alias("label"), "gene_id", "gene_pos", "scale", F.posexplode(points).alias("j", "z"))
    return rows.select(
        "source", "checkpoint", "scope", "label", "gene_id", "gene_pos", "j", F.col("z.s").alias("support"), F.col("z.t").alias("scaled_support"),
        F.col("z.x").alias("x"), F.col("z.p").alias("prob"), F.col("z.c").alias("cdf"), "scale",
    )


def grid_curves(priors: DataFrame, genes: DataFrame, grid: DataFrame) -> DataFrame:
    """batch, perturbation, gene_id, scale, support, prob of label priors laid out on a grid of labels (see
    sources.matrices.label_grid); raises on labels without priors and on genes that no label of the grid has."""
    own = priors.withColumn("label", F.expr("substring(scope, 7)")).filter(F.startswith("scope", F.lit("label:")))
    if lost := grid.join(own.select("label").distinct(), "label", "left_anti").limit(1).collect():
        raise ValueError(f"unknown label {lost[0]['label']}")
    rows = own.join(grid.select("label", "batch", "perturbation"), "label").join(genes.select("gene_id"), "gene_id", "left_semi")
    if lost := genes.join(rows.select("gene_id").distinct(), "gene_id", "left_anti").limit(1).collect():
        raise ValueError(f"no label of the grid has the gene {lost[0]['gene_id']}")
    return rows.select("batch", "perturbation", "gene_id", "scale", "support", "prob")


def distribution_rows(values: DataFrame, by: list[str]) -> DataFrame:
    """Groups of finite values (gene_id, layer and others in by): n, mean, median, p10, p90, min and max."""
    v = F.col("value").cast("double")
    rows = values.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    q = F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), q.alias("q"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(*by, "n", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("p10"), F.col("q")[2].alias("p90"), "min", "max")
