"""Checkpoints: priors of several scopes as one table (scope, gene_id, scale, support, prob), and what describes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import expr as X
from tallyspark.functions.order import cut
from tallyspark.operators.lists import missing

#: What shards of one fit must agree in.
SHARED = ("source", "layer", "reference_genes", "requested_genes", "fit_mode", "label_key", "likelihood", "support_domain", "fit_config")
DISTRIBUTIONS = ("binomial", "negative_binomial", "poisson")


def assembled(*fits: DataFrame) -> DataFrame:
    """Priors of fits of different scopes in one table; raises on a gene that a scope has twice. The table, a row for each
    scope and gene, is written to the checkpoint folder, so that fits run once, whatever is read of it."""
    columns = ["scope", "gene_id", "scale", "support", "prob"]
    out = cut(reduce(DataFrame.unionByName, [f.select(*columns) for f in fits]))
    if twice := out.groupBy("scope", "gene_id").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"two priors of {twice[0]['gene_id']} in {twice[0]['scope']}")
    return out


def labels(priors: DataFrame) -> DataFrame:
    """Labels that have priors."""
    return priors.filter(F.startswith("scope", F.lit("label:"))).select(F.expr("substring(scope, 7)").alias("label")).distinct()


def get_prior(priors: DataFrame, label: str | None = None) -> DataFrame:
    """Priors of a label, or the global ones; raises if there are none."""
    scope = "global" if label is None else f"label:{label}"
    out = priors.filter(F.col("scope") == scope)
    if not out.limit(1).count():
        raise KeyError(scope)
    return out


def scale_metadata(priors: DataFrame) -> DataFrame:
    """scope, scale and how many genes have it."""
    return priors.groupBy("scope", "scale").agg(F.count(F.lit(1)).alias("genes"))


def select_genes(priors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Priors of the wanted genes (pos, gene_id) with their pos; raises on a gene that a scope lacks."""
    if lost := missing(wanted, priors.select("gene_id").distinct()).limit(1).collect():
        raise KeyError(lost[0]["gene_id"])
    return priors.join(wanted.select("pos", "gene_id"), "gene_id")


def check_same_genes(priors: DataFrame) -> None:
    """Raises, naming a gene, where a scope lacks a gene that another one has."""
    scopes, genes = priors.select("scope").distinct(), priors.select("gene_id").distinct()
    lost = genes.crossJoin(F.broadcast(scopes)).join(priors.select("scope", "gene_id"), ["scope", "gene_id"], "left_anti")
    if bad := lost.limit(1).collect():
        raise ValueError(f"{bad[0]['scope']} lacks {bad[0]['gene_id']}")


def check_meta(metas: list[dict]) -> None:
    """Raises where shards' descriptions differ in what they must share."""
    if not metas:
        raise ValueError("at least one checkpoint is needed")
    for i, m in enumerate(metas[1:], 1):
        for key in SHARED:
            if m.get(key) != metas[0].get(key):
                raise ValueError(f"checkpoint {i} differs in {key!r}")
        means = [x.get("mean_reference") for x in (metas[0], m)]
        if None not in means and abs(means[0] - means[1]) > 1e-9 * max(1.0, abs(means[0])):
            raise ValueError(f"checkpoint {i} was fitted for another mean reference count: {means[1]}, not {means[0]}")


def merged(shards: list[tuple[DataFrame, dict]], wanted: DataFrame | None = None, allow_partial: bool = False) -> DataFrame:
    """One table of the priors of shards (priors and description of each), restricted to the wanted genes. Raises on
    differing descriptions or scales, on a gene that two shards hold, and on wanted genes that none holds unless
    allow_partial."""
    check_meta([m for _, m in shards])
    out = assembled(*[p for p, _ in shards])
    if out.groupBy("scope").agg((F.max("scale") - F.min("scale")).alias("d")).filter("d > 1e-12").limit(1).count():
        raise ValueError("scales of shards differ")
    if wanted is None:
        return out
    scopes = out.select("scope").distinct()
    lost = wanted.select("gene_id").crossJoin(F.broadcast(scopes)).join(out.select("scope", "gene_id"), ["scope", "gene_id"], "left_anti")
    if not allow_partial and (bad := lost.limit(5).collect()):
        raise ValueError(f"genes without a prior: {[r['gene_id'] for r in bad]}")
    return out.join(wanted.select("gene_id"), "gene_id", "left_semi")


def likelihood_of(meta: dict) -> str:
    """The distribution of posteriors: from the fit's configuration, else from the description, else binomial."""
    config = meta.get("fit_config") or {}
    value = str(config.get("likelihood", meta.get("posterior_distribution", meta.get("fit_distribution", "binomial")))).strip()
    if value not in DISTRIBUTIONS:
        raise ValueError(f"unsupported distribution {value!r}")
    return value


def overdispersion_of(meta: dict, default: float = 0.01) -> float:
    config = meta.get("fit_config") or {}
    try:
        return float(str(config.get("nb_overdispersion", meta.get("nb_overdispersion", default))))
    except ValueError:
        return default


def check_distribution(meta: dict, likelihood: str) -> None:
    """Raises where posteriors are asked for under another likelihood than the priors' domain allows."""
    fitted = likelihood_of(meta)
    if (fitted == "poisson") != (likelihood == "poisson"):
        raise ValueError(f"priors fitted for {fitted} do not go with {likelihood}")


def with_fit_scale(rows: DataFrame, explicit: float | None = None, priors: DataFrame | None = None) -> DataFrame:
    """rows (scope, n_mean and others) with fit_scale: as given, else that of the scope's priors, else of the global ones,
    else the mean reference count. Scales are a row for each scope."""
    if explicit is not None:
        return rows.withColumn("fit_scale", F.lit(float(explicit)))
    if priors is None:
        return rows.withColumn("fit_scale", F.col("n_mean").cast("double"))
    own = priors.groupBy(F.col("scope").alias("s_")).agg(F.max("scale").alias("own_scale"))
    all_ = priors.filter("scope = 'global'").agg(F.max("scale").alias("all_scale"))
    met = rows.join(F.broadcast(own), F.col("scope") == F.col("s_"), "left").crossJoin(F.broadcast(all_))
    return met.withColumn("fit_scale", F.coalesce("own_scale", "all_scale", F.col("n_mean").cast("double"))).drop("s_", "own_scale", "all_scale")


def check_overlap(reference_genes: DataFrame, var: DataFrame) -> DataFrame:
    """genes: how many reference genes a dataset has; raises if none."""
    out = reference_genes.join(var.select("gene_id"), "gene_id", "left_semi").agg(F.count(F.lit(1)).alias("genes"))
    if not out.first()["genes"]:
        raise ValueError("the dataset has none of the reference genes")
    return out


def suggested_label(labels: DataFrame, obs: DataFrame, columns: list[str]) -> str | None:
    """The column of obs in which the most of a checkpoint's labels (column label) occur, the first of equal ones; None if
    none has any."""
    each = [obs.select(F.col(c).cast("string").alias("label")).distinct().join(labels.select("label").distinct(), "label", "left_semi").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.lit(i)) for i, c in enumerate(columns)]
    if not each:
        return None
    out = each[0]
    for one in each[1:]:
        out = out.unionByName(one)
    best = out.orderBy(F.desc("n"), "c").first()
    return columns[best["c"]] if best["n"] else None


def warm_start(priors: DataFrame, old: DataFrame, batches: DataFrame, same_likelihood: bool = True) -> DataFrame:
    """priors (scope, gene_id, scale, support, prob) with the probabilities of old ones on the new supports. A batch of a
    scope (scope, gene_id, b) starts warm as a whole or not at all: its label's priors count if there are any, else the
    global ones, and must cover all its genes with as many points."""
    if not same_likelihood:
        return priors
    own = old.select(F.col("scope").alias("from"), F.col("gene_id").alias("g"), F.col("prob").alias("p_"))
    have = old.select(F.col("scope").alias("s_")).distinct()
    source = priors.select("scope").distinct().join(F.broadcast(have), F.col("scope") == F.col("s_"), "left")
    source = source.select(F.col("scope").alias("to"), F.coalesce("s_", F.lit("global")).alias("source"))
    rows = priors.join(batches.select("scope", "gene_id", "b"), ["scope", "gene_id"]).join(F.broadcast(source), F.col("scope") == F.col("to"))
    rows = rows.join(own, (F.col("source") == F.col("from")) & (F.col("gene_id") == F.col("g")), "left")
    fits = F.coalesce(F.size("p_") == F.size("prob"), F.lit(False))
    ok = rows.groupBy("scope", "b").agg(F.bool_and(fits).alias("ok"))
    warm = F.when(F.col("ok"), X.normalised(F.col("p_"))).otherwise(F.col("prob"))
    return rows.join(ok, ["scope", "b"]).select("scope", "gene_id", "scale", "support", warm.alias("prob"))
