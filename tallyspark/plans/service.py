"""Registered queries that read answers of the service back, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import expr as X
from tallyspark.functions.order import shared_path
from tallyspark.operators import checks as K
from tallyspark.operators import model as M
from tallyspark.plans import answers as A
from tallyspark.plans import catalogue as Q
from tallyspark.plans import facades
from tallyspark.plans.catalogue import RETAIL, query, r6, rounded
from tallyspark.sources import matrices as D

_AT = lambda path, kind="double": F.get_json_object("body", f"$.data.{path}").cast(kind)


@query("json_dataset", RETAIL + "z AS (SELECT 1) SELECT count(*)::BIGINT AS cells, (SELECT count(*) FROM var)::BIGINT AS genes, '[\"label\"]' AS keys, round(avg(n), 6) AS mean, round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99 FROM ref")
def _(s, d):
    out = A.dataset(D.retail(s, d), d)
    return out.select(_AT("nCells", "long").alias("cells"), _AT("nGenes", "long").alias("genes"), _AT("labelKeys", "string").alias("keys"), r6(_AT("totalCountMean")).alias("mean"), r6(_AT("totalCountP99")).alias("p99"))


@query(
    "json_genes",
    RETAIL + "f AS (SELECT *, row_number() OVER (ORDER BY total DESC, gene_id) AS r, count(*) OVER () AS n FROM tot WHERE gene_id LIKE '%#1%') "
    "SELECT (r - 4)::INT AS place, gene_id, total, detected, round(detected / (SELECT count(*) FROM obs), 6) AS share, n::BIGINT AS items, ceil(n / 3)::BIGINT AS pages FROM f WHERE r BETWEEN 4 AND 6",
)
def _(s, d):
    out = A.genes(D.retail(s, d), "BRAND#1", page=2, size=3)
    items = F.from_json(_AT("items", "string"), "array<struct<geneName:string,totalCount:long,detectedCells:long,detectedFraction:double>>")
    rows = out.select(F.posexplode(items).alias("place", "x"), _AT("totalItems", "long").alias("items"), _AT("totalPages", "long").alias("pages"))
    return rows.select("place", F.col("x.geneName").alias("gene_id"), F.col("x.totalCount").alias("total"), F.col("x.detectedCells").alias("detected"), r6("x.detectedFraction").alias("share"), "items", "pages")


@query(
    "json_gene",
    Q.POSTERIOR + Q._SUMMARY + ", g AS (SELECT sup * s AS v, h FROM obsn JOIN su USING (gene_id, k, n), mean WHERE gene_id = 'Brand#11') "
    "SELECT (SELECT total FROM tot WHERE gene_id = 'Brand#11')::BIGINT AS total, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, round(max(h), 6) AS entropy, 16 AS points FROM g",
)
def _(s, d):
    out = A.gene(D.retail(s, d), "Brand#11", "checkpoint", Q._priors(s, d), Q._CONFIG)
    signal = lambda x: _AT(f"posterior.summary.{x}")
    points = F.size(F.from_json(_AT("prior.probabilities", "string"), "array<double>"))
    return out.select(_AT("rawSummary.totalCount").cast("long").alias("total"), r6(signal("mapSignal.mean")).alias("mean"), r6(signal("mapSignal.p90")).alias("p90"), r6(signal("posteriorEntropy.max")).alias("entropy"), points.alias("points"))


@query(
    "json_kbulk",
    Q.POSTERIOR
    + "plan AS (SELECT label, count(*)::BIGINT AS cells, 5::BIGINT AS target, 5::BIGINT AS ways FROM ref GROUP BY label HAVING count(*) >= 3), "
    + Q.combos_sql()
    + Q._BULK
    + "SELECT label, (SELECT cells FROM plan WHERE plan.label = ks.label) AS cells, count(*)::BIGINT AS samples, round(avg(signal), 6) AS mean, round(stddev_pop(signal), 6) AS std FROM ks WHERE gene_id = 'Brand#11' GROUP BY label",
)
def _(s, d):
    out = A.kbulk(D.retail(s, d), "Brand#11", Q._priors(s, d), Q._CONFIG, 3, 5, 11)
    groups = F.from_json(_AT("groups", "string"), "array<struct<label:string,nCells:long,realizedSamples:long,meanSignal:double,stdSignal:double>>")
    rows = out.select(F.explode(groups).alias("x"))
    return rows.select("x.label", F.col("x.nCells").alias("cells"), F.col("x.realizedSamples").alias("samples"), r6("x.meanSignal").alias("mean"), r6("x.stdSignal").alias("std"))


@query(
    "kbulk_layers",
    Q._BULK_SQL + "SELECT label, sample_id::INT AS sample_id, gene_id, k_sum AS raw_counts, round(signal, 6) AS signal, round(signal, 6) AS map_mu, round(signal / (SELECT s FROM mean), 6) AS map_probability, "
    "round(signal / (SELECT s FROM mean), 6) AS map_p, round(signal / (SELECT s FROM mean), 6) AS map_support, NULL::DOUBLE AS map_rate, round(h0, 6) AS prior_entropy FROM ks",
)
def _(s, d):
    out = facades.extract_kbulk(D.retail(s, d), Q._priors(s, d), Q._CONFIG, 3, 5, 11, layers=True)
    names = ("signal", "map_mu", "map_probability", "map_p", "map_support", "prior_entropy")
    return rounded(out.select("label", "sample_id", "gene_id", "raw_counts", *names, "map_rate"), *names)


@query("annotation_file", "SELECT 'label:' || n_name AS source, 'retail' AS name, s_name AS gene_id, 'bal=' || printf('%.2f', s_acctbal) || ', key=' || s_suppkey || ', nation=' || n_name AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(s, d):
    path = shared_path(s, "annotation")
    rows = D.read(s, d, "supplier").join(D.read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows.select(F.col("s_name").alias("gene"), F.col("n_name").alias("label"), F.col("s_acctbal").cast("double").alias("bal"), F.col("s_suppkey").alias("key"), F.col("n_name").alias("nation")).write.option("header", True).csv(path)
    return D.read_annotations(s, {"retail": path}).select("source", "name", "gene_id", "text")


# Divergences, smoothing and matched moments of shares of a supplier's lines by line number.

_SHARES = """WITH n AS (SELECT l_suppkey, l_linenumber AS j, count(*)::DOUBLE AS a, sum(l_quantity)::DOUBLE AS b FROM lineitem GROUP BY l_suppkey, l_linenumber),
g AS (SELECT l_suppkey, j, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT DISTINCT l_suppkey FROM n) CROSS JOIN (SELECT unnest(range(1, 8)) AS j) LEFT JOIN n USING (l_suppkey, j)),
x AS (SELECT l_suppkey, j, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM g WINDOW w AS (PARTITION BY l_suppkey))
"""


def _shares(s, d):
    counts = D.read(s, d, "lineitem").groupBy("l_suppkey").pivot("l_linenumber", [*range(1, 8)]).agg(F.count(F.lit(1)).alias("a"), F.sum("l_quantity").alias("b"))
    listed = lambda mark: F.array(*[F.coalesce(F.col(f"`{j}_{mark}`").cast("double"), F.lit(0.0)) for j in range(1, 8)])
    part = lambda c: X.let(X.total(c), lambda t: F.transform(c, lambda x: x / t))
    return counts.select("l_suppkey", part(listed("a")).alias("p"), part(listed("b")).alias("q"))


@query(
    "divergence_variants",
    _SHARES
    + """, c AS (SELECT l_suppkey, j, p, q, greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER w AS pn, greatest(q, 1e-12) / sum(greatest(q, 1e-12)) OVER w AS qn FROM x WINDOW w AS (PARTITION BY l_suppkey))
    SELECT l_suppkey, round(sum(p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) + q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12))) / 2, 9) AS with_eps,
      round(sum(p * ln(greatest(p, 1e-12) / greatest((p + q) / 2, 1e-12)) + q * ln(greatest(q, 1e-12) / greatest((p + q) / 2, 1e-12))) / 2, 9) AS clipped,
      round(sum(pn * ln(pn / ((pn + qn) / 2)) + qn * ln(qn / ((pn + qn) / 2))) / 2, 9) AS normalised FROM c GROUP BY l_suppkey""",
)
def _(s, d):
    x = _shares(s, d)
    p, q = F.col("p"), F.col("q")
    return x.select("l_suppkey", *[F.round(f(p, q), 9).alias(n) for n, f in (("with_eps", X.jsd), ("clipped", X.clipped_jsd), ("normalised", X.normalised_jsd))])


@query(
    "smoothed_shares",
    _SHARES
    + """, k AS (SELECT d, exp(-0.5 * (d / 0.8) ** 2) AS w FROM (SELECT unnest(range(-3, 4)) AS d)), m AS (SELECT x.l_suppkey, x.j, sum(y.p * w) / (SELECT sum(w) FROM k) AS v FROM x CROSS JOIN k
    JOIN x y ON y.l_suppkey = x.l_suppkey AND y.j = least(greatest(x.j + d, 1), 7) GROUP BY x.l_suppkey, x.j)
    SELECT l_suppkey, j::INT AS j, round(v / sum(v) OVER (PARTITION BY l_suppkey), 9) AS p FROM m""",
)
def _(s, d):
    rows = _shares(s, d).select("l_suppkey", F.posexplode(X.smoothed(F.col("p"), 0.8)).alias("j", "v"))
    return rows.select("l_suppkey", (F.col("j") + 1).alias("j"), F.round("v", 9).alias("p"))


@query(
    "moment_matched_shares",
    _SHARES
    + """, n2 AS (SELECT l_suppkey, j, greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER (PARTITION BY l_suppkey) AS p FROM x), mm AS (SELECT l_suppkey, sum(p * j) AS m FROM n2 GROUP BY 1),
    vv AS (SELECT l_suppkey, m, sqrt(greatest(sum(p * (j - m) ** 2), 1e-12)) AS sd FROM n2 JOIN mm USING (l_suppkey) GROUP BY l_suppkey, m),
    gg AS (SELECT l_suppkey, j, greatest(exp(-0.5 * ((j - m) / sd) ** 2), 1e-12) AS v FROM n2 JOIN vv USING (l_suppkey))
    SELECT l_suppkey, j::INT AS j, round(v / sum(v) OVER (PARTITION BY l_suppkey), 9) AS p FROM gg""",
)
def _(s, d):
    grid = F.array(*[F.lit(float(j)) for j in range(1, 8)])
    rows = _shares(s, d).select("l_suppkey", F.posexplode(X.moment_matched(grid, F.col("p"))).alias("j", "v"))
    return rows.select("l_suppkey", (F.col("j") + 1).alias("j"), F.round("v", 9).alias("p"))


@query(
    "weighted_divergence",
    Q.POSTERIOR
    + """w AS (SELECT gene_id, k, n, count(*) AS w FROM obsn GROUP BY ALL), hh AS (SELECT gene_id, k, n, -sum(pp * ln(greatest(pp, 1e-12))) AS h FROM soft GROUP BY ALL),
    cf AS (SELECT gene_id, sum(w * (1 - least(greatest(h / (ln(16) + 1e-12), 0), 1))) / sum(w) AS c FROM hh JOIN w USING (gene_id, k, n) GROUP BY gene_id),
    mp AS (SELECT gene_id, j, sum(w * pp) / sum(w) AS p, any_value(q) AS q FROM soft JOIN w USING (gene_id, k, n) GROUP BY gene_id, j)
    SELECT gene_id, round(c * sum(p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) + q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12))) / 2, 6) AS value FROM mp JOIN cf USING (gene_id) GROUP BY gene_id, c""",
)
def _(s, d):
    out = M.infer(Q._rows(s, d), Q._priors(s, d), Q._CONFIG, channels=("posterior", "prior"))
    sure = F.sum(F.col("weight") * X.entropy_confidence(F.col("posterior_entropy"), F.size("prior"))) / F.sum("weight")
    each = out.groupBy("gene_id").agg(sure.alias("sure"), F.first("prior").alias("prior"))
    both = K.aggregate_posterior(out.select("gene_id", "weight", "posterior")).join(each, "gene_id")
    return both.select("gene_id", r6(X.weighted_jsd(F.col("prob"), F.col("prior"), F.col("sure"))).alias("value"))
