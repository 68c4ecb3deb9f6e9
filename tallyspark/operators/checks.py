"""Checks of matrices, and small joins and filters of the command surface."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import expr as X
from tallyspark.functions.text import truth
from tallyspark.sources.matrices import Matrix


def check_names(names: DataFrame, column: str = "gene_id") -> None:
    """Raises on names that are null, empty or there twice; names one of them."""
    if names.filter(F.coalesce(F.trim(column), F.lit("")) == "").limit(1).count():
        raise ValueError(f"empty name in {column!r}")
    if twice := names.groupBy(column).count().filter("count > 1").limit(1).collect():
        raise ValueError(f"name occurs twice in {column!r}: {twice[0][0]}")


def check_counts(m: Matrix, reference: DataFrame | None = None) -> None:
    """Raises on counts that are negative or not finite, on counts of cells or genes that the matrix does not list, and
    on references that are not positive. One pass over the counts and two anti-joins."""
    v = F.col("value").cast("double")
    if m.counts.filter(v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))).limit(1).count():
        raise ValueError("counts must be finite and not negative")
    for rows, key in ((m.obs, "cell_id"), (m.var, "gene_id")):
        if lost := m.counts.join(rows.select(key), key, "left_anti").select(key).limit(1).collect():
            raise ValueError(f"counts of an unknown {key}: {lost[0][0]}")
    if reference is not None and reference.filter(~(F.col("n_ref") > 0) | F.col("n_ref").isNull()).limit(1).count():
        raise ValueError("reference counts must be positive")


def matrix_faults(m: Matrix) -> DataFrame:
    """One row: how many counts are bad (null, not finite, negative), and how many names repeat."""
    v = F.col("value").cast("double")
    bad = m.counts.agg(F.count_if(v.isNull() | F.isnan(v) | (v < 0) | (F.abs(v) == float("inf"))).alias("bad_counts"))
    genes = m.var.agg((F.count(F.lit(1)) - F.countDistinct("gene_id")).alias("repeated_genes"))
    cells = m.obs.agg((F.count(F.lit(1)) - F.countDistinct("cell_id")).alias("repeated_cells"))
    return bad.crossJoin(genes).crossJoin(cells)  # one row each


def option_values(given: list[str] | None = None, path: str | None = None) -> list[str]:
    """Values of a repeatable option: each split at commas, then those of a file's lines; trimmed, blanks dropped, the
    first of equal ones kept."""
    lines = Path(path).read_text().splitlines() if path else []
    parts = [p.strip() for g in given or [] for p in g.split(",")] + [p.strip() for p in lines]
    return list(dict.fromkeys(p for p in parts if p))


def obs_filter(obs: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows of obs whose column, as text, is one of the values (trimmed). Raises on a missing column, and if none is left."""
    if column not in obs.columns:
        raise ValueError(f"no column {column!r}")
    wanted = list(dict.fromkeys(v.strip() for v in values if v.strip()))
    out = obs.filter(F.col(column).cast("string").isin(wanted))
    if not wanted or not out.limit(1).count():
        raise ValueError(f"no cells with {column} in {wanted}")
    return out


def single_cells(obs: DataFrame, cells: str = "n_cells", coverage: str = "good_coverage", guide: str = "guide") -> DataFrame:
    """Rows of exactly one cell with good coverage (a truth value or its text) and a guide other than '*'; nulls are no."""
    ok = (F.col(cells).cast("double") == 1) & truth(F.col(coverage)) & (F.col(guide) != "*")
    return obs.filter(F.coalesce(ok, F.lit(False)))


def browse_scope(scope: str, has_checkpoint: bool) -> str:
    """fitted or all; anything else is fitted where there is a checkpoint."""
    return scope if scope in ("fitted", "all") else "fitted" if has_checkpoint else "all"


def browsed(genes: DataFrame, text: str, scope: str, priors: DataFrame | None) -> DataFrame:
    """Genes whose name contains a text in any case; with scope fitted only those that have a prior."""
    token = text.strip().lower()
    out = genes.filter(F.contains(F.lower("gene_id"), F.lit(token))) if token else genes
    if priors is None or browse_scope(scope, True) == "all":
        return out
    return out.join(priors.select("gene_id").distinct(), "gene_id", "left_semi")


def lacking_labels(obs: DataFrame, priors: DataFrame) -> DataFrame:
    """Labels of cells that have no prior of their own."""
    have = priors.filter(F.startswith("scope", F.lit("label:"))).select(F.expr("substring(scope, 7)").alias("label")).distinct()
    return obs.select(F.col("label").cast("string").alias("label")).distinct().join(have, "label", "left_anti")


def with_guides(obs: DataFrame, guides: DataFrame, key: str = "cell_id", group: str = "gem_group") -> DataFrame:
    """obs with the guides' columns; the group comes from obs, else from the guides. Raises where the two differ."""
    other = guides.withColumnRenamed(group, "__group")
    both = obs.join(other, key, "left")
    if both.filter(F.col(group) != F.col("__group")).limit(1).count():
        raise ValueError(f"{group} of cells and guides differ")
    return both.withColumn(group, F.coalesce(group, "__group")).drop("__group")


def shared_cells(first: DataFrame, second: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows of the first table whose key the second has, too."""
    return first.join(second.select(key).distinct(), key, "left_semi")


def with_aliases(rows: DataFrame, annotation: DataFrame, name: str, alias: str, shown: str = "shown") -> DataFrame:
    """rows with the alias that an annotation gives a name, or the name where it gives none. Of several the least counts."""
    known = annotation.filter(F.coalesce(F.trim(alias), F.lit("")) != "").groupBy(F.col(name).alias("__name")).agg(F.min(F.trim(alias)).alias("__alias"))
    both = rows.join(known, F.col(name) == F.col("__name"), "left")
    return both.withColumn(shown, F.coalesce("__alias", F.col(name))).drop("__name", "__alias")


def concatenated(*parts: Matrix) -> Matrix:
    """Matrices one under the other; genes that a part lacks have no counts there. Cells keep their ids, which must
    differ between parts."""
    counts, obs, var = parts[0].counts, parts[0].obs, parts[0].var
    for m in parts[1:]:
        counts = counts.unionByName(m.counts, allowMissingColumns=True)
        obs = obs.unionByName(m.obs, allowMissingColumns=True)
        var = var.unionByName(m.var, allowMissingColumns=True)
    check_names(obs.select(F.col("cell_id").cast("string").alias("cell_id")), "cell_id")
    return Matrix(counts, obs, var.dropDuplicates(["gene_id"]))


def scopes(mode: str, rows: DataFrame) -> DataFrame:
    """scope and cells of what a fit covers, from obs: global, by-label, or both."""
    every = rows.agg(F.lit("global").alias("scope"), F.count(F.lit(1)).alias("cells"))
    each = rows.groupBy(F.concat(F.lit("label:"), F.coalesce(F.col("label").cast("string"), F.lit("nan"))).alias("scope")).agg(F.count(F.lit(1)).alias("cells"))
    if mode not in ("global", "by-label", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    return every if mode == "global" else each if mode == "by-label" else every.unionByName(each)


def last_mapping(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and its value in the last row by order."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def top_cells(rows: DataFrame, n: int = 12) -> DataFrame:
    """The n observations with the largest counts, ties by cell."""
    return rows.orderBy(F.desc("k"), "cell_id").limit(n)


def deg_export(tests: DataFrame, by: str, most_fdr: float, least_fold: float, n: int) -> DataFrame:
    """Of each group the first n genes by fdr and name among those within the limits, with their rank."""
    ok = tests.filter((F.col("fdr") <= most_fdr) & (F.abs("log2_fold_change") >= least_fold))
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("fdr", "gene_id"))).filter(F.col("rank") <= n)


def confidence_mask(rows: DataFrame, share: float, top: float, seed: int) -> DataFrame:
    """Of each cell's genes (cell_id, gene_id, confidence) a share, drawn by hash from the `top` share with the highest
    confidence; at least one gene of each cell."""
    if not 0 < share < 1 or not 0 < top <= 1:
        raise ValueError("shares must lie between 0 and 1")
    cell = Window.partitionBy("cell_id")
    n = F.count(F.lit(1)).over(cell)
    masked = F.greatest(F.lit(1), F.bround(n * share).cast("int"))
    chosen = F.least(n, F.greatest(masked, F.bround(n * top).cast("int")))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("cell_id").cast("string"), "gene_id"))
    best = rows.withColumns({"__n": masked, "__c": chosen, "__r": F.row_number().over(cell.orderBy(F.desc("confidence"), "gene_id"))}).filter("__r <= __c")
    return best.withColumn("__d", F.row_number().over(cell.orderBy(key, "gene_id"))).filter("__d <= __n").select(rows.columns)


#: Rank error of quantiles from sketches of so many items (k): about 2.3 / k ** 0.9 of a group's rows, in 99 of 100.
SKETCH = 400
#: Rows of a group up to which quantiles are exact if "auto" decides.
EXACT_ROWS = 1 << 20


def sketched(rows: DataFrame, by: list[str], value: str, k: int = SKETCH) -> DataFrame:
    """A mergeable quantile sketch of a value for each group, a few KB each whatever the rows: by and sketch."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of finer groups as those of coarser ones."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles_of(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...], method: str = "auto") -> DataFrame:
    """by and q, an array of the quantiles. method: exact (interpolated; a group's distinct values meet in one buffer),
    sketch (a value whose rank is within the sketch's error), or auto: exact where no group has over EXACT_ROWS rows."""
    if method not in ("exact", "sketch", "auto"):
        raise ValueError(f"unknown method {method!r}")
    if method == "auto":
        most = rows.groupBy(*by).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0]
        method = "exact" if (most or 0) <= EXACT_ROWS else "sketch"
    if method == "exact":
        return rows.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("q"))
    return sketched(rows, by, value).select(*by, F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(s)) for s in shares]).alias("q"))


def value_summary(rows: DataFrame, by: list[str], value: str, method: str = "exact") -> DataFrame:
    """mean, median, p90 and max of a value by groups; method of the quantiles as in quantiles_of()."""
    if method == "exact":
        q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9)))
        out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("q"), F.max(value).alias("max"))
    else:
        rest = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
        out = rest.join(quantiles_of(rows, by, value, (0.5, 0.9), method), by)
    return out.select(*by, "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"), "max")


def loss_weight_mean(rows: DataFrame, points: int, entropy: str = "posterior_entropy") -> DataFrame:
    """weight_mean: the mean of 1 - H / ln(points), at least 0, missing entropies as 0. Raises on fewer than two points."""
    if points < 2:
        raise ValueError("at least two support points are needed")
    h = F.col(entropy).cast("double")
    finite = F.when(h.isNull() | F.isnan(h) | (F.abs(h) == float("inf")), F.lit(0.0)).otherwise(h)
    return rows.agg(F.avg(F.greatest(1 - finite / F.log(F.lit(float(points))), F.lit(0.0))).alias("weight_mean"))


def support_size(rows: DataFrame, entropy: str = "prior_entropy") -> DataFrame:
    """points: exp of the largest finite entropy, as a whole number."""
    h = F.col(entropy).cast("double")
    return rows.filter(~F.isnan(h) & (F.abs(h) != float("inf"))).agg(F.bround(F.exp(F.max(h))).cast("long").alias("points"))


def ensembl_like(genes: DataFrame, first: int = 32) -> DataFrame:
    """ensembl: whether the first genes by place (columns pos, gene_id) all begin with ENSG."""
    return genes.orderBy("pos").limit(first).agg(F.coalesce(F.bool_and(F.startswith("gene_id", F.lit("ENSG"))), F.lit(False)).alias("ensembl"))


def layer_sum(m: Matrix, *layers: DataFrame) -> Matrix:
    """The matrix whose counts are the sum of layers."""
    rows = layers[0].select("cell_id", "gene_id", "value")
    for x in layers[1:]:
        rows = rows.unionByName(x.select("cell_id", "gene_id", "value"))
    return m.layer(rows.groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value")))


def alias_ambiguity(mapping: DataFrame, alias: str, gene: str) -> DataFrame:
    """alias, genes and whether it stands for several genes."""
    rows = mapping.groupBy(F.col(alias).alias("alias")).agg(F.countDistinct(gene).alias("genes"))
    return rows.withColumn("ambiguous", F.col("genes") > 1)


def aggregate_posterior(posteriors: DataFrame) -> DataFrame:
    """gene_id, prob: the weighted mean of posteriors (gene_id, weight, posterior)."""
    points = posteriors.select("gene_id", "weight", F.posexplode("posterior").alias("j", "p")).groupBy("gene_id", "j")
    points = points.agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p"))
    return points.groupBy("gene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "p"))), lambda x: x["p"]).alias("prob"))


def normal_tail(z: Column) -> Column:
    """Two-sided p-value of z >= 0, by the rational approximation of Abramowitz and Stegun 26.2.17."""
    x = F.greatest(z, F.lit(0.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(2 * F.exp(-x * x / 2) / 2.5066282746310002 * poly, F.lit(1.0))


def merged_jsd(left: DataFrame, right: DataFrame) -> DataFrame:
    """gene_id, jsd of two tables of priors: both laid by interpolation on the union of their scaled supports (nothing
    beyond their ends), normalised there."""
    scaled = lambda p: F.transform("support", lambda x: x * F.col("scale"))
    a = left.select("gene_id", scaled(left).alias("x_a"), F.col("prob").alias("p_a"))
    b = right.select("gene_id", scaled(right).alias("x_b"), F.col("prob").alias("p_b"))
    both = a.join(b, "gene_id").withColumn("grid", F.array_sort(F.array_distinct(F.concat("x_a", "x_b"))))
    laid = both.select("gene_id", X.interpolated(F.col("x_a"), F.col("p_a"), F.col("grid")).alias("p"), X.interpolated(F.col("x_b"), F.col("p_b"), F.col("grid")).alias("q"))
    return laid.select("gene_id", X.jsd(F.col("p"), F.col("q")).alias("jsd"))
