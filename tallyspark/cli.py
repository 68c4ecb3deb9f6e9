"""Command line: fit, extract, genes, checkpoint and plot data. Matrices are folders with counts, obs and var tables."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import checkpoints as P
from tallyspark.operators import curves as C
from tallyspark.operators import lists as L
from tallyspark.operators.checks import check_counts, check_names, obs_filter, option_values
from tallyspark.operators.model import FitConfig
from tallyspark.operators.stats import reference_counts, scale_diagnostics
from tallyspark.plans import facades
from tallyspark.sources.matrices import Matrix, read_list
from tallyspark.sources.versions import commit, current


def read_matrix(spark: SparkSession, path: str) -> Matrix:
    """A matrix written by write_matrix(), checked."""
    folder = current(spark, path)
    m = Matrix(*[spark.read.parquet(f"{folder}/{t}") for t in ("counts", "obs", "var")])
    check_names(m.var)
    check_counts(m)
    return m


def write_matrix(m: Matrix, path: str) -> None:
    """Three tables, which together replace what was there once all are written."""

    def tables(folder: str) -> None:
        for name, rows in (("counts", m.counts), ("obs", m.obs), ("var", m.var)):
            rows.write.parquet(f"{folder}/{name}")

    commit(m.counts.sparkSession, path, tables)


def read_rules(path: str) -> tuple:
    """Nuisance rules (exact, prefixes, patterns) of a JSON file, or of a YAML file where PyYAML is installed."""
    text = Path(path).read_text()
    if Path(path).suffix.lower() in (".yaml", ".yml"):
        import yaml

        given = yaml.safe_load(text)
    else:
        given = json.loads(text)
    if not isinstance(given, dict):
        raise ValueError(f"{path} holds no table of rules")
    return tuple(tuple(given.get(k) or ()) for k in ("exact", "prefixes", "patterns"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_summary(summary: dict, path: str) -> None:
    Path(path).write_text(json.dumps(summary, indent=2, sort_keys=True, ensure_ascii=False))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyspark", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *arguments: tuple[str, dict]) -> None:
        p = jobs.add_parser(name)
        for flag, options in arguments:
            p.add_argument(flag, **options)

    matrix, out, store = ("matrix", {}), ("--output", {"required": True}), ("--checkpoint", {"required": True})
    seed = ("--seed", {"type": int, "default": 0})
    job(
        "fit-priors", matrix, out, seed, ("--mode", {"choices": facades.MODES, "default": "global"}), ("--points", {"type": int, "default": 512}),
        ("--likelihood", {"default": "binomial"}), ("--scale", {"type": float}), ("--genes", {"help": "file of names"}), ("--cells", {"type": int}), ("--warm-start", {}),
        ("--shard", {"type": int}), ("--shards", {"type": int, "default": 1}), ("--support-from", {"choices": ("observed_max", "quantile"), "default": "observed_max"}),
        ("--spacing", {"choices": ("linear", "sqrt"), "default": "linear"}), ("--support-scale", {"type": float, "default": 1.5}), ("--overdispersion", {"type": float, "default": 0.01}),
        ("--max-iterations", {"type": int, "default": 100}), ("--tolerance", {"type": float, "default": 1e-6}), ("--adaptive", {"action": "store_true"}),
        ("--obs-key", {"help": "column of obs to filter by"}), ("--obs-value", {"action": "append", "default": [], "help": "values kept, repeated or by commas"}), ("--summary", {"help": "file of a JSON summary"}),
    )
    shape = ("--distribution", {"choices": P.DISTRIBUTIONS, "help": "of posteriors; the checkpoint's if not given"})
    job("extract-signals", matrix, store, out, shape, ("--by-label", {"action": "store_true"}))
    job("extract-kbulk", matrix, store, out, seed, shape, ("--k", {"type": int, "default": 8}), ("--samples", {"type": int, "default": 24}), ("--by-label", {"action": "store_true"}), ("--unique", {"action": "store_true"}), ("--unbalanced", {"action": "store_true"}), ("--layers", {"action": "store_true"}))
    job("rank-genes", matrix, out, ("--method", {"choices": facades.RANKINGS, "default": "variance"}), ("--flavour", {"default": "seurat"}), ("--top", {"type": int}), ("--checkpoint", {}))
    job("filter-genes", ("names", {}), out, ("--species", {"choices": sorted([*L.RULES, "none"]), "default": "none"}), ("--rules", {}))
    job("merge-checkpoints", ("checkpoints", {"nargs": "+"}), out)
    job("inspect-checkpoint", store)
    job("curves", store, out, ("--gene", {"action": "append", "required": True}), ("--x-axis", {"default": "auto"}))
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tallyspark").getOrCreate()
    if a.job == "fit-priors":
        config = FitConfig(
            points=a.points, likelihood=a.likelihood, support_from=a.support_from, spacing=a.spacing, support_scale=a.support_scale, overdispersion=a.overdispersion,
            max_iterations=a.max_iterations, tolerance=a.tolerance, adaptive=a.adaptive,
        )
        m = read_matrix(spark, a.matrix)
        if a.obs_key is not None or a.obs_value:
            kept = obs_filter(m.obs, a.obs_key, option_values(a.obs_value))
            m = Matrix(m.counts.join(kept.select("cell_id"), "cell_id", "left_semi"), kept, m.var)
        genes = None if a.genes is None else read_list(spark, a.genes).withColumnRenamed("value", "gene_id")
        warm, old = (None, {}) if a.warm_start is None else C.load_checkpoint(spark, a.warm_start)
        if old and P.likelihood_of(old) != a.likelihood:
            warm = None
        sample = None if a.cells is None else (a.cells, a.seed)
        shard = None if a.shard is None else (a.shard, a.shards)
        priors = facades.fit_checkpoint(m, a.mode, config, a.scale, genes, sample, warm, shard)
        meta = {"source": a.matrix, "fit_mode": a.mode, "likelihood": a.likelihood, "fit_config": {"likelihood": a.likelihood, "points": a.points, "nb_overdispersion": a.overdispersion, "support_from": a.support_from, "spacing": a.spacing}}
        mean = scale_diagnostics(reference_counts(m)).first()["mean_reference"]
        C.save_checkpoint(priors, a.output, meta | {"mean_reference": mean})
        if a.summary is not None:
            told = C.inspect(C.load_checkpoint(spark, a.output)[0]).orderBy("scope").collect()
            write_summary(meta | {"mean_reference": mean, "scopes": [r.asDict() for r in told]}, a.summary)
    elif a.job in ("extract-signals", "extract-kbulk"):
        priors, meta = C.load_checkpoint(spark, a.checkpoint)
        likelihood = a.distribution or P.likelihood_of(meta)
        P.check_distribution(meta, likelihood)
        config, m = FitConfig(likelihood=likelihood, overdispersion=P.overdispersion_of(meta)), read_matrix(spark, a.matrix)
        if a.job == "extract-signals":
            rows = facades.extract_signals(m, priors, config, a.by_label)
        else:
            rows = facades.extract_kbulk(m, priors, config, a.k, a.samples, a.seed, not a.unbalanced, a.unique, a.by_label, a.layers)
        rows.write.mode("overwrite").parquet(a.output)
    elif a.job == "rank-genes":
        priors = None if a.checkpoint is None else P.get_prior(C.load_checkpoint(spark, a.checkpoint)[0])
        write_csv(facades.rank_genes(read_matrix(spark, a.matrix), a.method, a.flavour, priors, top=a.top).coalesce(1), a.output)
    elif a.job == "filter-genes":
        rules = [L.RULES[a.species]] if a.species != "none" else []
        rules += [read_rules(a.rules)] if a.rules else []
        names = read_list(spark, a.names).withColumnRenamed("value", "gene_id")
        kept = L.filtered(names, *rules)
        kept.orderBy("pos").select("gene_id").coalesce(1).write.mode("overwrite").text(a.output)
    elif a.job == "merge-checkpoints":
        shards = [C.load_checkpoint(spark, c) for c in a.checkpoints]
        C.save_checkpoint(P.merged(shards), a.output, shards[0][1])
    elif a.job == "inspect-checkpoint":
        C.inspect(C.load_checkpoint(spark, a.checkpoint)[0]).show(truncate=False)
    elif a.job == "curves":
        priors, meta = C.load_checkpoint(spark, a.checkpoint)
        names = option_values(a.gene)
        genes = spark.createDataFrame([*enumerate(names)], "pos long, gene_id string")
        write_csv(C.curve_rows({Path(a.checkpoint).stem: priors}, genes, a.x_axis, rate=P.likelihood_of(meta) == "poisson").orderBy(F.col("gene_pos"), "source", "j"), a.output)


if __name__ == "__main__":
    main()
