"""Answers about a dataset as JSON, made by Spark: one row with a column `body` for each, in an envelope of ok, data, error
and meta. Field names are those that clients of such a service read."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import checkpoints as P
from tallyspark.operators import lists as L
from tallyspark.operators import model as M
from tallyspark.operators import stats as T
from tallyspark.plans import facades
from tallyspark.sources.matrices import Matrix

# Statuses and codes of failures.
NOT_FOUND, BAD_REQUEST, CONFLICT, INTERNAL = 404, 400, 409, 500


class DatasetNotLoaded(RuntimeError):
    """No dataset to answer from."""


def named(**fields: Column) -> Column:
    """A struct whose fields have these names."""
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def enveloped(rows: DataFrame, data: Column, **meta: Column) -> DataFrame:
    """body: a successful answer for each row, nulls written out."""
    notes = named(**meta) if meta else F.create_map().cast("map<string,string>")
    whole = named(ok=F.lit(True), data=data, error=F.lit(None).cast("string"), meta=notes)
    return rows.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("body"))


def failure(error: Exception) -> tuple[int, str]:
    """Status and body of an answer to a request that failed."""
    text = str(error) or type(error).__name__
    if isinstance(error, DatasetNotLoaded):
        status, code = CONFLICT, "dataset_not_loaded"
    elif isinstance(error, KeyError):
        status, code, text = NOT_FOUND, "gene_not_found", str(error.args[0]) if error.args else text
    elif isinstance(error, FileNotFoundError):
        status, code = BAD_REQUEST, "file_not_found"
    elif isinstance(error, ValueError):
        known = (("kbulk", "invalid_kbulk_request"), ("checkpoint", "invalid_checkpoint_request"), ("label", "invalid_label_request"))
        status, code = BAD_REQUEST, next((c for word, c in known if word in text.replace("kBulk", "kbulk")), "invalid_request")
    elif isinstance(error, RuntimeError):
        status, code = BAD_REQUEST, "runtime_error"
    else:
        status, code = INTERNAL, "internal_error"
    return status, json.dumps({"ok": False, "data": None, "error": {"code": code, "message": text, "details": {}}, "meta": {}})


def answered(ask: Callable[[], DataFrame]) -> tuple[int, str]:
    """Status and body of a request: the one row of its answer, or what its failure comes to."""
    try:
        return 200, ask().first()["body"]
    except Exception as error:  # noqa: BLE001  (every failure is an answer)
        return failure(error)


def dataset(m: Matrix, path: str = "", layer: str | None = None, preferred: tuple[str, ...] = ("label",)) -> DataFrame:
    """What a dataset holds: cells, genes, columns that can serve as labels, and how counts per cell are spread."""
    columns = [c for c in m.obs.columns if c != "cell_id"]
    keys = T.label_columns(m.obs, columns, list(preferred)).agg(F.array_sort(F.collect_list(F.struct("position", "column"))).alias("x"))
    listed = keys.select(F.col("x.column").alias("keys"))
    return enveloped(
        T.dataset_summary(m).crossJoin(listed),
        named(
            nCells=F.col("cells"), nGenes=F.col("genes"), layer=F.lit(layer or "(X)"), path=F.lit(path), labelKeys=F.col("keys"),
            totalCountMean=F.col("mean_total"), totalCountMedian=F.col("median_total"), totalCountP99=F.col("p99_total"),
        ),
    )


def checkpoint(priors: DataFrame, meta: dict, m: Matrix, path: str = "") -> DataFrame:
    """What a checkpoint holds, and how it goes with a dataset."""
    names = P.labels(priors).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    whole = priors.agg(F.count_distinct("gene_id").alias("genes"), F.bool_or(F.col("scope") == "global").alias("all"), F.max(F.when(F.col("scope") == "global", F.col("scale"))).alias("scale"))
    both = priors.select("gene_id").distinct().join(m.var.select("gene_id"), "gene_id", "left_semi").agg(F.count(F.lit(1)).alias("both"))
    suggested = P.suggested_label(P.labels(priors), m.obs, [c for c in m.obs.columns if c != "cell_id"])
    likelihood = P.likelihood_of(meta)
    return enveloped(
        whole.crossJoin(names).crossJoin(both),
        named(
            ckptPath=F.lit(path), geneCount=F.col("genes"), hasGlobalPrior=F.col("all"), nLabelPriors=F.size("labels"), labelPreview=F.slice("labels", 1, 8),
            distribution=F.lit(likelihood), supportDomain=F.lit("rate" if likelihood == "poisson" else "probability"), scale=F.col("scale"),
            meanReferenceCount=F.lit(meta.get("mean_reference")).cast("double"), nReferenceGenes=F.col("genes"), nOverlapReferenceGenes=F.col("both"),
            suggestedLabelKey=F.lit(suggested).cast("string"),
        ),
    )


def genes(m: Matrix, query: str = "", page: int = 1, size: int = 20) -> DataFrame:
    """A page of the genes whose names hold the query, by falling total. Pages count from 1."""
    if page < 1 or size < 1:
        raise ValueError("pages and their sizes count from 1")
    found = T.gene_totals(m).filter(F.contains(F.lower("gene_id"), F.lit(query.strip().lower())))
    cells = m.obs.agg(F.count(F.lit(1)).alias("cells"))
    rows = L.ranked(found.select("gene_id", F.col("total").cast("double").alias("score"))).filter((F.col("rank") > (page - 1) * size) & (F.col("rank") <= page * size))
    item = named(geneName=F.col("gene_id"), totalCount=F.col("total"), detectedCells=F.col("detected"), detectedFraction=F.col("detected") / F.col("cells"))
    items = rows.join(found, "gene_id").crossJoin(F.broadcast(cells)).agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("x")))).alias("items"))
    count = found.agg(F.count(F.lit(1)).alias("n"))
    return enveloped(
        items.crossJoin(count),
        named(
            query=F.lit(query), scope=F.lit("all"), sortBy=F.lit("total"), descending=F.lit(True), page=F.lit(page), pageSize=F.lit(size),
            totalItems=F.col("n"), totalPages=F.ceil(F.col("n") / size), items=F.col("items.x"),
        ),
    )


def _summary(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """One row with a struct of mean, median, p90 and max for each value; zeros where there are none."""
    def one(c: str) -> Column:
        zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
        q = F.percentile(c, F.array(F.lit(0.5), F.lit(0.9)))
        return named(mean=zero(F.avg(c)), median=zero(q[0]), p90=zero(q[1]), max=zero(F.max(c)))

    return rows.agg(*[one(c).alias(name) for name, c in values.items()])


def gene(m: Matrix, name: str, mode: str = "raw", priors: DataFrame | None = None, config: M.FitConfig = M.FitConfig()) -> DataFrame:
    """Counts of a gene, and by mode its posterior under a checkpoint's prior or one fitted here; raises KeyError on a gene
    that the matrix lacks."""
    if not m.var.filter(F.col("gene_id") == name).limit(1).count():
        raise KeyError(f"gene {name!r} is not in the dataset")
    raw = T.gene_summary(m).filter(F.col("gene_id") == name)
    rename = {"totalCount": "total", "meanCount": "mean", "medianCount": "median", "p90Count": "p90", "p99Count": "p99", "maxCount": "max", "detectedCells": "detected", "detectedFraction": "detected_fraction", "zeroFraction": "zero_fraction", "countTotalCorrelation": "total_corr"}
    rows = raw.select(named(**{k: F.col(v) for k, v in rename.items()}).alias("raw"))
    posterior = F.lit(None).cast("string")
    if mode != "raw":
        signals = facades.gene_analysis(m, name, mode, config, priors)
        told = {"mapSignal": "signal", "posteriorEntropy": "posterior_entropy", "mutualInformation": "mutual_information"}
        rows = rows.crossJoin(_summary(signals, told))
        posterior = named(supportDomain=F.lit("rate" if config.likelihood == "poisson" else "probability"), summary=named(**{k: F.col(k) for k in told}))
    prior = F.lit(None).cast("string")
    if mode == "checkpoint" and priors is not None:
        own = priors.filter((F.col("gene_id") == name) & (F.col("scope") == "global"))
        rows = rows.join(own.select("scale", "support", "prob"), F.lit(True), "left")
        prior = named(scale=F.col("scale"), support=F.transform("support", lambda x: x * F.col("scale")), probabilities=F.col("prob"))
    cells = m.obs.agg(F.count(F.lit(1)).alias("cells"))
    return enveloped(rows.crossJoin(cells), named(geneName=F.lit(name), mode=F.lit(mode), nCells=F.col("cells"), rawSummary=F.col("raw"), prior=prior, posterior=posterior))


def kbulk(m: Matrix, name: str, priors: DataFrame, config: M.FitConfig, k: int, n: int, seed: int) -> DataFrame:
    """Signals of aggregates of k cells of each class, of one gene."""
    if k < 1 or n < 1:
        raise ValueError("kbulk samples need at least one cell")
    rows = facades.extract_kbulk(m, priors.filter(F.col("gene_id") == name), config, k, n, seed, balance=False)
    sizes = m.obs.groupBy("label").agg(F.count(F.lit(1)).alias("cells"))
    each = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("signal").alias("ms"), F.stddev_pop("signal").alias("ss"), F.avg("posterior_entropy").alias("me"), F.stddev_pop("posterior_entropy").alias("se")
    )
    group = named(label=F.col("label"), nCells=F.col("cells"), realizedSamples=F.col("n"), meanSignal=F.col("ms"), stdSignal=F.col("ss"), meanEntropy=F.col("me"), stdEntropy=F.col("se"))
    groups = each.join(sizes, "label").agg(F.array_sort(F.collect_list(group)).alias("groups"))
    return enveloped(groups, named(geneName=F.lit(name), k=F.lit(k), nSamples=F.lit(n), sampleSeed=F.lit(seed), groups=F.col("groups")))
