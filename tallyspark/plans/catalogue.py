"""Registered queries of the count engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import expr as X
from tallyspark.functions import text as W
from tallyspark.operators import checkpoints as P
from tallyspark.operators import checks as K
from tallyspark.operators import curves as C
from tallyspark.operators import cycle as Y
from tallyspark.operators import lists as L
from tallyspark.operators import mixture as G
from tallyspark.operators import model as M
from tallyspark.operators import sampling as S
from tallyspark.operators import stats as T
from tallyspark.sources import matrices as D
from tallyspark.sources.context import SHARED
from tallyspark.streaming.scoring import score_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The retail matrix in SQL: counts, dense grid and reference counts.
RETAIL = """
WITH cnt AS (SELECT o_custkey AS cell_id, p_brand AS gene_id, count(*)::BIGINT AS k FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
obs AS (SELECT c_custkey AS cell_id, c_mktsegment AS label FROM customer),
var AS (SELECT DISTINCT p_brand AS gene_id FROM part),
dense AS (SELECT cell_id, label, gene_id, coalesce(k, 0)::BIGINT AS k FROM obs CROSS JOIN var LEFT JOIN cnt USING (cell_id, gene_id)),
ref AS (SELECT cell_id, label, sum(k)::BIGINT AS n FROM dense GROUP BY ALL),
tot AS (SELECT gene_id, sum(k)::BIGINT AS total, count_if(k <> 0)::BIGINT AS detected FROM dense GROUP BY ALL),
"""

#: Uniform priors on 16 points and the posterior of every cell and gene under them, in SQL (binomial).
POSTERIOR = (
    RETAIL
    + """
mean AS (SELECT avg(n) AS s FROM ref WHERE n > 0),
obsn AS (SELECT d.cell_id, d.gene_id, d.k, r.n::DOUBLE AS n FROM dense d JOIN ref r USING (cell_id) WHERE r.n > 0),
top AS (SELECT gene_id, least(greatest(greatest(max(k / n * s), max(k)) / max(s), 1e-12), 1) AS t FROM obsn, mean GROUP BY gene_id),
grid AS (SELECT gene_id, j, least(greatest(t * 1.5::DOUBLE, 1e-12), 1) * j / 15 AS p, 1.0::DOUBLE / 16 AS q FROM top, (SELECT unnest(range(16)) AS j)),
keys AS (SELECT DISTINCT gene_id, k, n FROM obsn),
joint AS (SELECT gene_id, k, n, j, p, q, k * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (n - k) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) + ln(q) AS z
    FROM keys JOIN grid USING (gene_id)),
soft AS (SELECT *, exp(z - max(z) OVER w) / sum(exp(z - mz)) OVER w AS pp FROM (SELECT *, max(z) OVER (PARTITION BY gene_id, k, n) AS mz FROM joint)
    WINDOW w AS (PARTITION BY gene_id, k, n)),
"""
)

_CONFIG = M.FitConfig(points=16)


def query(name: str, sql: str | None = None):
    """Register a query; sql: the same rows in DuckDB, where it can express them."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c) -> F.Column:
    """A double to 6 places, by the SQL's own rule: the multiple of 1e-6 that is nearest to the double times 1e6. F.round
    with places goes by the double's shortest decimal, and differs where that ends in a 5 at the 7th place."""
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(1e6)) / F.lit(1e6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# Aggregates and summaries


@query("reference_counts", RETAIL + "z AS (SELECT 1) SELECT cell_id, n AS n_ref FROM ref")
def _(s, d):
    return T.reference_counts(D.retail(s, d)).select("cell_id", "n_ref")


@query("reference_subset", RETAIL + "z AS (SELECT 1) SELECT cell_id, coalesce(sum(k) FILTER (gene_id LIKE 'Brand#1%'), 0)::BIGINT AS n_ref FROM dense GROUP BY cell_id")
def _(s, d):
    m = D.retail(s, d)
    return T.reference_counts(m, m.var.filter(F.col("gene_id").startswith("Brand#1"))).select("cell_id", "n_ref")


@query("exposure", RETAIL + "z AS (SELECT 1) SELECT cell_id, round(n / avg(n) OVER (PARTITION BY label) * 15.0::DOUBLE, 6) AS n_eff FROM ref")
def _(s, d):
    return rounded(T.exposure(T.reference_counts(D.retail(s, d)), 15.0, ["label"]).select("cell_id", "n_eff"), "n_eff")


@query("gene_totals", RETAIL + "z AS (SELECT 1) SELECT gene_id, total, detected FROM tot")
def _(s, d):
    return T.gene_totals(D.retail(s, d))


@query("cell_zero_fraction", RETAIL + "z AS (SELECT 1) SELECT cell_id, round(1 - count_if(k <> 0) / count(*), 6) AS zero_fraction FROM dense GROUP BY cell_id")
def _(s, d):
    return rounded(T.zero_fractions(D.retail(s, d)), "zero_fraction")


@query(
    "gene_summary",
    RETAIL
    + """z AS (SELECT 1) SELECT gene_id, sum(k)::DOUBLE AS total, round(avg(k), 6) AS mean, quantile_cont(k::DOUBLE, 0.5) AS median,
    round(quantile_cont(k::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(k::DOUBLE, 0.99), 6) AS p99, max(k)::DOUBLE AS max, count_if(k <> 0)::BIGINT AS detected,
    round(count_if(k <> 0) / count(*), 6) AS detected_fraction, round(1 - count_if(k <> 0) / count(*), 6) AS zero_fraction,
    round(coalesce(CASE WHEN stddev_pop(k) > 1e-12 AND stddev_pop(n) > 1e-12 THEN corr(k, n) END, 0), 6) AS total_corr
    FROM dense JOIN ref USING (cell_id) GROUP BY gene_id""",
)
def _(s, d):
    return rounded(T.gene_summary(D.retail(s, d)), "mean", "p90", "p99", "detected_fraction", "zero_fraction", "total_corr")


@query(
    "dataset_summary",
    RETAIL
    + """z AS (SELECT 1) SELECT count(*)::BIGINT AS cells, (SELECT count(*) FROM var)::BIGINT AS genes, count(DISTINCT label)::BIGINT AS labels,
    round(avg(n), 6) AS mean_total, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median_total, round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99_total FROM ref""",
)
def _(s, d):
    return rounded(T.dataset_summary(D.retail(s, d)), "mean_total", "median_total", "p99_total")


@query(
    "scale_diagnostics",
    RETAIL
    + """z AS (SELECT 1) SELECT count(*)::BIGINT AS positive_cells, round(avg(n), 6) AS mean_reference, round(avg(n), 6) AS suggested_scale,
    round(quantile_cont(n::DOUBLE, 0.9), 6) AS q90_reference FROM ref WHERE n > 0""",
)
def _(s, d):
    return rounded(T.scale_diagnostics(T.reference_counts(D.retail(s, d))), "mean_reference", "suggested_scale", "q90_reference")


@query(
    "class_mean_reference",
    RETAIL + "c AS (SELECT label, avg(n) AS m FROM ref GROUP BY label) SELECT label, round(m, 6) AS class_mean, round((SELECT avg(m) FROM c), 6) AS mean_of_means FROM c",
)
def _(s, d):
    return rounded(T.class_means(T.reference_counts(D.retail(s, d))), "class_mean", "mean_of_means")


_NORM = RETAIL + "goal AS (SELECT quantile_cont(n::DOUBLE, 0.5) AS g FROM ref), nv AS (SELECT d.cell_id, d.gene_id, ln(1 + d.k / greatest(n, 1.0::DOUBLE) * g) AS v FROM dense d JOIN ref USING (cell_id), goal), "


@query("normalize_total_log1p", _NORM + "z AS (SELECT 1) SELECT cell_id, gene_id, round(v, 6) AS value FROM nv WHERE v <> 0")
def _(s, d):
    return rounded(T.normalized(D.retail(s, d)), "value")


@query(
    "lognorm_variance",
    _NORM + "z AS (SELECT 1) SELECT gene_id, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(var_pop(v) / greatest(avg(v), 1e-12), 6) AS dispersion FROM nv GROUP BY gene_id",
)
def _(s, d):
    m = D.retail(s, d)
    return rounded(T.moments(m, T.normalized(m)), "mean", "variance", "dispersion")


@query(
    "vector_variance",
    "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) "
    "SELECT printf('d%02d', i) AS gene_id, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM v GROUP BY i",
)
def _(s, d):
    m = D.vectors(s, d)
    return rounded(T.moments(m, m.counts), "mean", "variance").drop("dispersion")


@query(
    "gene_fano",
    RETAIL
    + """z AS (SELECT 1) SELECT gene_id, round(avg(k), 6) AS mean, round(stddev_pop(k), 6) AS std, round(stddev_pop(k) / nullif(avg(k), 0), 6) AS cv,
    round(var_pop(k) / nullif(avg(k), 0), 6) AS fano FROM dense GROUP BY gene_id""",
)
def _(s, d):
    return rounded(T.fano(D.retail(s, d)), "mean", "std", "cv", "fano")


@query("event_totals", "SELECT event_type AS gene_id, count(*)::BIGINT AS total, count(DISTINCT user_id)::BIGINT AS detected FROM events GROUP BY 1")
def _(s, d):
    return T.gene_totals(D.events(s, d))


@query("layer_quantity", "SELECT o_custkey AS cell_id, p_brand AS gene_id, round(sum(l_quantity), 6) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(s, d):
    return rounded(D.quantity(s, d), "value")


@query("log_signal", RETAIL + "z AS (SELECT 1) SELECT cell_id, gene_id, round(ln(1 + greatest(k - 2, 0)), 6) AS value FROM dense")
def _(s, d):
    return D.retail(s, d).dense().select("cell_id", "gene_id", r6(T.log_signal(F.col("value") - 2)).alias("value"))


@query(
    "raw_proxy",
    RETAIL + "z AS (SELECT 1) SELECT d.cell_id, d.gene_id, round(d.k * 10.0::DOUBLE / avg(n) OVER (), 6) AS proxy FROM dense d JOIN ref USING (cell_id)",
)
def _(s, d):
    o = M.observations(D.retail(s, d))
    return o.select("cell_id", "gene_id", r6(F.col("k") * 10.0 / F.col("n_mean")).alias("proxy"))


@query("obs_filter", RETAIL + "z AS (SELECT 1) SELECT cell_id, label FROM obs WHERE label IN ('BUILDING', 'MACHINERY')")
def _(s, d):
    return K.obs_filter(D.retail(s, d).obs, "label", ["BUILDING", " MACHINERY "])


@query("cell_total_filter", RETAIL + "z AS (SELECT 1) SELECT cell_id, n AS n_ref FROM ref WHERE n >= 40")
def _(s, d):
    return T.reference_counts(D.retail(s, d)).filter("n_ref >= 40").select("cell_id", "n_ref")


@query("positive_reference", RETAIL + "z AS (SELECT 1) SELECT cell_id FROM ref WHERE n > 0")
def _(s, d):
    return T.positive_reference(T.reference_counts(D.retail(s, d))).select("cell_id")


@query(
    "label_detect",
    """WITH c AS (SELECT 'c_mktsegment' AS c, count(DISTINCT c_mktsegment) AS n FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer
    UNION ALL SELECT 'c_custkey', count(DISTINCT c_custkey) FROM customer)
    SELECT c AS "column", n::BIGINT AS distinct_values, row_number() OVER (ORDER BY c <> 'c_nationkey', c)::INT AS position FROM c WHERE n BETWEEN 2 AND 64""",
)
def _(s, d):
    return T.label_columns(D.read(s, d, "customer"), ["c_mktsegment", "c_nationkey", "c_custkey"], ["c_nationkey"])


@query("label_counts", RETAIL + "z AS (SELECT 1) SELECT label, count(*)::BIGINT AS cells FROM obs GROUP BY label HAVING count(*) >= 8 ORDER BY cells DESC, label LIMIT 3")
def _(s, d):
    return T.label_counts(D.retail(s, d).obs, 3, 8)


@query(
    "histogram_bins",
    RETAIL
    + """e AS (SELECT gene_id, min(k)::DOUBLE AS lo, max(k)::DOUBLE AS hi FROM dense GROUP BY gene_id)
    SELECT gene_id, least(coalesce(floor((k - lo) / nullif((hi - lo) / 8, 0)), 0), 7)::INT AS bin, count(*)::BIGINT AS n FROM dense JOIN e USING (gene_id) GROUP BY ALL""",
)
def _(s, d):
    return T.histogram(D.retail(s, d).dense(), 8, ["gene_id"])


@query(
    "class_alignment",
    RETAIL
    + """m AS (SELECT label, gene_id, sum(k) / count(*) AS m FROM dense GROUP BY ALL),
    f AS (SELECT label FROM obs GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), r AS (SELECT gene_id, m AS rm FROM m JOIN f USING (label))
    SELECT label, gene_id, round(coalesce(least(greatest(rm / nullif(m, 0), 0.5::DOUBLE), 2.0::DOUBLE), 1), 6) AS factor FROM m JOIN r USING (gene_id)""",
)
def _(s, d):
    return rounded(T.class_alignment(D.retail(s, d)), "factor")


_SET = ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22")


@query(
    "group_zscore",
    RETAIL
    + f"""g AS (SELECT cell_id, coalesce(sum(log2(k + 1.0::DOUBLE)) FILTER (gene_id IN {_SET}), 0) AS score FROM dense GROUP BY cell_id)
    SELECT cell_id, round(score, 6) AS score, round((score - avg(score) OVER ()) / nullif(stddev_samp(score) OVER (), 0), 6) AS z FROM g""",
)
def _(s, d):
    return rounded(T.group_zscore(D.retail(s, d), list(_SET)), "score", "z")


@query(
    "marker_corr",
    RETAIL
    + f"""g AS (SELECT *, avg(k) OVER (PARTITION BY cell_id) AS sm FROM dense WHERE gene_id IN {_SET})
    SELECT gene_id, round(corr(k, sm), 6) AS corr, corr(k, sm) >= 0.3::DOUBLE AS kept FROM g GROUP BY gene_id""",
)
def _(s, d):
    return rounded(T.marker_correlation(D.retail(s, d), list(_SET), 0.3), "corr")


_MW = (
    RETAIL
    + """v AS (SELECT gene_id, label = 'BUILDING' AS a, k FROM dense WHERE label IN ('BUILDING', 'MACHINERY')),
    t AS (SELECT gene_id, k, count(*) AS t, count_if(a) AS t1 FROM v GROUP BY ALL),
    r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY gene_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM t),
    q AS (SELECT gene_id, sum(rk * t1) AS r1, sum(t1)::DOUBLE AS n1, sum(t - t1)::DOUBLE AS n2, sum(t::DOUBLE ** 3 - t) AS ties,
      sum(k * t1) / sum(t1) AS m1, sum(k * (t - t1)) / sum(t - t1) AS m2 FROM r GROUP BY gene_id),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM q)
    SELECT gene_id, round(u, 6) AS u, round((abs(u - n1 * n2 / 2) - 0.5::DOUBLE) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z,
      round(log2((m1 + 1e-9) / (m2 + 1e-9)), 6) AS log2_fold_change FROM u"""
)


@query("deg_mannwhitney", _MW)
def _(s, d):
    return rounded(T.mann_whitney_sparse(D.retail(s, d), "BUILDING", "MACHINERY"), "u", "z", "log2_fold_change")


@query("deg_fdr")
def _(s, d):
    rows = T.mann_whitney_sparse(D.retail(s, d), "BUILDING", "MACHINERY")
    return rounded(T.benjamini_hochberg(rows.withColumn("p", K.normal_tail(F.col("z")))), "u", "z", "log2_fold_change", "p", "fdr")


def seurat_sql(values: str) -> str:
    """SQL of the seurat flavour over values v (a row for each cell of a gene), as CTEs up to hv(gene_id, score)."""
    return f"""sg AS (SELECT gene_id, ln(1 + avg(v)) AS x, ln(greatest(var_samp(v) / greatest(avg(v), 1e-12), 1e-12)) AS d FROM {values} GROUP BY gene_id),
    sb AS (SELECT *, least(coalesce(floor((x - min(x) OVER ()) / nullif((max(x) OVER () - min(x) OVER ()) / 20, 0)), 0), 19) AS bin FROM sg),
    hv AS (SELECT gene_id, coalesce((d - avg(d) OVER b) / nullif(stddev_samp(d) OVER b, 0), 1) AS score FROM sb WINDOW b AS (PARTITION BY bin))"""


@query(
    "hvg_seurat",
    RETAIL
    + "n4 AS (SELECT d.gene_id, exp(ln(1 + d.k / greatest(n, 1.0::DOUBLE) * 1e4)) - 1 AS v FROM dense d JOIN ref USING (cell_id)), "
    + seurat_sql("n4")
    + " SELECT gene_id, round(score, 6) AS dispersions_norm FROM hv",
)
def _(s, d):
    return rounded(T.hvg_seurat(D.retail(s, d)), "dispersions_norm")


# Ranking and lists


def _scores(s, d) -> DataFrame:
    return T.gene_totals(D.retail(s, d)).select("gene_id", F.col("total").cast("double").alias("score"))


@query("rank_topn", RETAIL + "z AS (SELECT 1) SELECT gene_id, total::DOUBLE AS score, row_number() OVER (ORDER BY total DESC, gene_id)::INT AS rank FROM tot QUALIFY rank <= 10")
def _(s, d):
    return L.ranked(_scores(s, d)).filter("rank <= 10")


_WANTED = [(0, "Brand#22"), (1, "Brand#11"), (2, "none"), (3, "Brand#13")]
_WANTED_SQL = "w(pos, gene_id) AS (VALUES (0::BIGINT, 'Brand#22'), (1, 'Brand#11'), (2, 'none'), (3, 'Brand#13'))"


def _wanted(s) -> DataFrame:
    return s.createDataFrame(_WANTED, "pos long, gene_id string")


@query("rank_restrict", RETAIL + _WANTED_SQL + " SELECT pos, gene_id, total::DOUBLE AS score FROM w JOIN tot USING (gene_id)")
def _(s, d):
    return L.restricted(_scores(s, d), _wanted(s))


@query("list_missing", RETAIL + _WANTED_SQL + " SELECT pos, gene_id FROM w WHERE gene_id NOT IN (SELECT gene_id FROM var)")
def _(s, d):
    return L.missing(_wanted(s), D.retail(s, d).var)


@query("subset_genes", RETAIL + _WANTED_SQL + " SELECT pos, gene_id FROM w WHERE gene_id IN (SELECT gene_id FROM var)")
def _(s, d):
    return L.subset_strict(_wanted(s), D.retail(s, d).var, strict=False)


@query("subset_genes_strict", RETAIL + _WANTED_SQL + " SELECT pos, gene_id FROM w WHERE gene_id <> 'none'")
def _(s, d):
    return L.subset_strict(_wanted(s).filter("gene_id <> 'none'"), D.retail(s, d).var)


_LISTS_SQL = (
    RETAIL
    + """s AS (SELECT p_brand AS gene_id, sum(p_retailprice) AS price, count(*) AS parts, avg(p_size) AS size FROM part GROUP BY 1),
    lists AS (SELECT 0 AS list_no, row_number() OVER (ORDER BY total DESC, gene_id) - 1 AS pos, gene_id FROM tot QUALIFY pos < 12
    UNION ALL SELECT 1, row_number() OVER (ORDER BY parts DESC, gene_id) - 1 AS pos, gene_id FROM s QUALIFY pos < 15
    UNION ALL SELECT 2, row_number() OVER (ORDER BY size DESC, gene_id) - 1 AS pos, gene_id FROM s QUALIFY pos < 18)
    """
)


def _lists(s, d) -> DataFrame:
    parts = D.read(s, d, "part").groupBy(F.col("p_brand").alias("gene_id"))
    by = [
        (_scores(s, d), 12),
        (parts.agg(F.count(F.lit(1)).cast("double").alias("score")), 15),
        (parts.agg(F.avg("p_size").alias("score")), 18),
    ]
    out = None
    for i, (scores, n) in enumerate(by):
        one = L.ranked(scores).filter(F.col("rank") <= n).select(F.lit(i).alias("list_no"), (F.col("rank") - 1).cast("long").alias("pos"), "gene_id")
        out = one if out is None else out.union(one)
    return out


@query("list_intersect_first", _LISTS_SQL + "SELECT row_number() OVER (ORDER BY min(pos) FILTER (list_no = 0)) - 1 AS pos, gene_id FROM lists GROUP BY gene_id HAVING count(DISTINCT list_no) = 3")
def _(s, d):
    return L.intersect(_lists(s, d)).withColumn("pos", F.col("pos").cast("long"))


@query("list_intersect_alpha", _LISTS_SQL + "SELECT row_number() OVER (ORDER BY gene_id) - 1 AS pos, gene_id FROM lists GROUP BY gene_id HAVING count(DISTINCT list_no) = 3")
def _(s, d):
    return L.intersect(_lists(s, d), "alpha").withColumn("pos", F.col("pos").cast("long"))


@query("list_union", _LISTS_SQL + "SELECT row_number() OVER (ORDER BY min(list_no * 1000 + pos)) - 1 AS pos, gene_id FROM lists GROUP BY gene_id")
def _(s, d):
    return L.union(_lists(s, d)).withColumn("pos", F.col("pos").cast("long"))


@query(
    "list_rank_sum",
    _LISTS_SQL
    + """, n AS (SELECT list_no, count(*) AS size FROM lists GROUP BY 1), g AS (SELECT g.gene_id, sum(coalesce(pos, size))::BIGINT AS rank_sum, avg(coalesce(pos, size)) AS mean_rank
    FROM (SELECT DISTINCT gene_id FROM lists) g CROSS JOIN n LEFT JOIN lists l ON l.gene_id = g.gene_id AND l.list_no = n.list_no GROUP BY 1)
    SELECT row_number() OVER (ORDER BY rank_sum, mean_rank, gene_id) - 1 AS pos, gene_id, rank_sum, round(mean_rank, 6) AS mean_rank FROM g""",
)
def _(s, d):
    return rounded(L.rank_sum(_lists(s, d)).withColumn("pos", F.col("pos").cast("long")), "mean_rank")


@query(
    "list_subset",
    _LISTS_SQL
    + """, a AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, gene_id FROM lists WHERE list_no = 1 AND gene_id IN (SELECT gene_id FROM lists WHERE list_no = 2)
    AND gene_id NOT IN (SELECT gene_id FROM lists WHERE list_no = 0)) SELECT pos, gene_id FROM a WHERE pos >= 1 AND pos < 3""",
)
def _(s, d):
    x = _lists(s, d)
    one = lambda i: x.filter(F.col("list_no") == i)
    return L.sliced(one(1), start=1, top=2, only=one(2), but=one(0)).withColumn("pos", F.col("pos").cast("long"))


@query("nuisance_filter", "SELECT DISTINCT p_name AS gene_id FROM part WHERE NOT (p_name IN ('part 1') OR starts_with(p_name, 'part 2') OR regexp_full_match(p_name, '.*[aeiou]\\d?'))")
def _(s, d):
    names = D.read(s, d, "part").select(F.col("p_name").alias("gene_id")).distinct()
    return L.filtered(names, (("part 1",), ("part 2",), (r".*[aeiou]\d?",)))


@query("gene_search", RETAIL + "z AS (SELECT 1) SELECT gene_id, total FROM tot WHERE contains(lower(gene_id), 'd#3') ORDER BY total DESC, gene_id LIMIT 3")
def _(s, d):
    return L.search(T.gene_totals(D.retail(s, d)), " D#3", 3).select("gene_id", "total")


@query(
    "gene_resolve",
    RETAIL
    + """i AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS gene_idx FROM var), q(query) AS (VALUES ('Brand#12'), ('3'), ('brand#44'), ('missing')),
    f AS (SELECT query, gene_id, gene_idx, CASE WHEN query = gene_id THEN 0 WHEN query = gene_idx::VARCHAR THEN 1 ELSE 2 END AS w FROM q JOIN i
    ON query = gene_id OR query = gene_idx::VARCHAR OR lower(query) = lower(gene_id))
    SELECT query, gene_id, gene_idx FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY w, gene_idx) = 1""",
)
def _(s, d):
    from pyspark.sql.window import Window

    genes = D.retail(s, d).var.withColumn("gene_idx", (F.row_number().over(Window.orderBy("gene_id")) - 1).cast("long"))
    return L.resolve(genes, s.createDataFrame([("Brand#12",), ("3",), ("brand#44",), ("missing",)], "query string"))


@query("browse_page", RETAIL + "z AS (SELECT 1) SELECT gene_id, total, detected, row_number() OVER (ORDER BY total DESC, gene_id)::INT AS place FROM tot QUALIFY place > 10 AND place <= 20")
def _(s, d):
    return L.page(T.gene_totals(D.retail(s, d)), [F.desc("total"), F.asc("gene_id")], 2, 10)


@query("unique_names", "SELECT p_partkey, p_type, CASE WHEN n = 0 THEN p_type ELSE p_type || '_' || n END AS unique_name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS n FROM part)")
def _(s, d):
    return L.numbered(D.read(s, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey")


@query("gene_shards", RETAIL + "i AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS pos FROM var) SELECT pos, gene_id, pos % 3 AS shard, (pos // 3 // 4)::BIGINT AS batch FROM i")
def _(s, d):
    out = L.shards(D.retail(s, d).var.withColumn("pos", F.col("gene_id")), 3, 4)
    return out.select(F.col("pos").cast("long"), "gene_id", F.col("shard").cast("long").alias("shard"), "batch")


# Strings


@query("label_split", "SELECT p_partkey, regexp_extract(x, '^([^_]+)_(.+)$', 1) AS batch, regexp_extract(x, '^([^_]+)_(.+)$', 2) AS perturbation FROM (SELECT p_partkey, replace(p_type, ' ', '_') AS x FROM part)")
def _(s, d):
    x = F.replace("p_type", F.lit(" "), F.lit("_"))
    get = lambda i: F.regexp_extract(x, "^([^_]+)_(.+)$", i)
    return D.read(s, d, "part").select("p_partkey", get(1).alias("batch"), get(2).alias("perturbation"))


@query(
    "condition_normalise",
    """WITH c AS (SELECT p_partkey, list_filter(list_transform(string_split(lower(p_type), ' '), lambda x: CASE WHEN x IN ('small', 'control', 'ctrl') THEN 'ctrl' ELSE x END), lambda x: x <> '') AS w FROM part),
    g AS (SELECT p_partkey, list_sort(list_distinct(list_filter(w, lambda x: x <> 'ctrl'))) AS g FROM c)
    SELECT p_partkey, CASE WHEN len(g) = 0 THEN 'ctrl' WHEN len(g) = 1 THEN 'ctrl+' || g[1] ELSE array_to_string(g, '+') END AS condition FROM g""",
)
def _(s, d):
    return D.read(s, d, "part").select("p_partkey", W.condition(F.lower("p_type"), ["small", "control", "ctrl"], " ").alias("condition"))


@query(
    "guide_target_parse",
    "SELECT p_partkey, array_to_string(list_filter(string_split(string_split(p_type || '__x', '__')[1], ' '), lambda x: x NOT IN ('SMALL', 'LARGE')), '+') AS target FROM part",
)
def _(s, d):
    head = F.split(F.concat("p_type", F.lit("__x")), "__")[0]
    return D.read(s, d, "part").select("p_partkey", F.array_join(F.filter(F.split(head, " "), lambda x: ~x.isin("SMALL", "LARGE")), "+").alias("target"))


@query("suffix_group", "SELECT c_custkey, try_cast(nullif(regexp_extract(c_name, '#0*(\\d+)$', 1), '') AS BIGINT) AS gem_group FROM customer")
def _(s, d):
    return D.read(s, d, "customer").select("c_custkey", W.suffix_number(F.col("c_name"), "#").alias("gem_group"))


@query("annotation_text", "SELECT s_suppkey, 'balance=' || coalesce(printf('%.2f', s_acctbal), 'NA') || ', nation=' || s_nationkey AS text FROM supplier")
def _(s, d):
    t = D.read(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return t.select("s_suppkey", D.annotation_text(t, ["s_suppkey"], ["balance", "nation"]).alias("text"))


@query("alias_check", "SELECT p_type AS alias, count(DISTINCT p_brand)::BIGINT AS genes, count(DISTINCT p_brand) > 1 AS ambiguous FROM part GROUP BY 1")
def _(s, d):
    return K.alias_ambiguity(D.read(s, d, "part"), "p_type", "p_brand")


@query("json_property", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(s, d):
    return D.read(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("layer_sum", "SELECT l_suppkey AS cell_id, p_brand AS gene_id, sum(v)::BIGINT AS value FROM (SELECT l_suppkey, l_partkey, 1 AS v FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey, l_partkey, 2 FROM lineitem WHERE l_returnflag = 'A') JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(s, d):
    lines, parts = D.read(s, d, "lineitem"), D.read(s, d, "part").select("p_partkey", F.col("p_brand").alias("gene_id"))
    part = lambda flag, v: lines.filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("cell_id"), "l_partkey", F.lit(v).alias("v"))
    named = lambda rows: rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("cell_id", "gene_id", F.col("v").alias("value"))
    return K.layer_sum(D.retail(s, d), named(part("R", 1)), named(part("A", 2))).counts


# Sampling

_KEY = "md5('{0}|' || cell_id)"


@query("fit_subsample", RETAIL + f"z AS (SELECT 1) SELECT cell_id, label FROM obs ORDER BY {_KEY.format(7)}, cell_id LIMIT 60")
def _(s, d):
    return S.subsample(D.retail(s, d).obs, 60, 7)


@query(
    "stratified_downsample",
    RETAIL
    + f"""q AS (SELECT label, least(greatest(round_even(count(*) * 0.25::DOUBLE, 0)::BIGINT, 3), count(*)) AS q FROM obs GROUP BY label)
    SELECT cell_id, label FROM obs JOIN q USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_KEY.format(42)}, cell_id) <= any_value(q) OVER (PARTITION BY label)""",
)
def _(s, d):
    return S.stratified(D.retail(s, d).obs, 0.25, 3, 42)


@query(
    "train_split",
    RETAIL
    + f"""u AS (SELECT cell_id, label, (row_number() OVER (PARTITION BY label ORDER BY {_KEY.format(3)}, cell_id) - 1) / count(*) OVER (PARTITION BY label) AS u FROM obs)
    SELECT cell_id, label, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS part FROM u""",
)
def _(s, d):
    return S.split(D.retail(s, d).obs, (0.7, 0.15), 3)


_PLAN = (
    RETAIL
    + """c AS (SELECT label, count(*)::BIGINT AS cells, avg(n) AS m FROM ref GROUP BY label HAVING count(*) >= 3),
    plan AS (SELECT label, cells, greatest(1, round_even(5 * m / (SELECT avg(m) FROM c), 0)::BIGINT) AS target, (cells * (cells - 1) * (cells - 2) // 6)::BIGINT AS ways FROM c),
    """
)


@query("kbulk_plan", _PLAN + "z AS (SELECT 1) SELECT label, cells, target, least(target, ways) AS realized FROM plan")
def _(s, d):
    return S.plan(T.reference_counts(D.retail(s, d)), 3, 5, True)


def combos_sql(k: int = 3, seed: int = 11, exposure: str = "n") -> str:
    """SQL of the samples of k cells, by Floyd's draws of ranks: cho, and sums over them, agg and ex. Needs plan, obs, ref."""
    draw = f"1 + ('0x' || substr(md5('{seed}|' || label || '|' || sample_id || '|' || i), 1, 15))::BIGINT % (cells - {k} + i)"
    return (
        "smp AS (SELECT label, unnest(range(1, least(target, ways) + 1)) AS sample_id FROM plan), "
        "num AS (SELECT label, cell_id, row_number() OVER (PARTITION BY label ORDER BY cell_id) AS rank FROM obs), "
        f"drw AS (SELECT label, sample_id, list_reduce({[*range(1, k + 1)]}, lambda acc, i: list_append(acc, CASE WHEN list_contains(acc, {draw}) "
        f"THEN cells - {k} + i ELSE {draw} END), []::BIGINT[]) AS ranks FROM smp JOIN plan USING (label)), "
        "cho AS (SELECT label, sample_id, cell_id FROM (SELECT label, sample_id, unnest(ranks) AS rank FROM drw) JOIN num USING (label, rank)), "
        f"agg AS (SELECT label, sample_id, gene_id, sum(k)::BIGINT AS k_sum, sum(k) / {k} AS mean, 1 - count_if(k <> 0) / {k} AS zero_fraction FROM cho JOIN dense USING (label, cell_id) GROUP BY ALL), "
        f"ex AS (SELECT label, sample_id, sum({exposure}) AS exposure_sum FROM cho JOIN ref USING (label, cell_id) GROUP BY ALL), "
    )


#: Posteriors of samples under the uniform priors; after POSTERIOR, a plan and combos_sql().
_BULK = """kj AS (SELECT label, sample_id, gene_id, k_sum, j, p, q, k_sum * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (exposure_sum - k_sum) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) + ln(q) AS z
    FROM agg JOIN ex USING (label, sample_id) JOIN grid USING (gene_id)),
km AS (SELECT *, exp(z - max(z) OVER w) AS e FROM kj WINDOW w AS (PARTITION BY label, sample_id, gene_id)),
kp AS (SELECT *, e / sum(e) OVER (PARTITION BY label, sample_id, gene_id) AS pp FROM km),
ks AS (SELECT label, sample_id, gene_id, any_value(k_sum) AS k_sum, arg_min(p, j) FILTER (pp = mp) * (SELECT s FROM mean) AS signal, -sum(pp * ln(greatest(pp, 1e-12))) AS h, -sum(q * ln(q)) AS h0
    FROM (SELECT *, max(pp) OVER (PARTITION BY label, sample_id, gene_id) AS mp FROM kp) GROUP BY ALL) """

_COMBOS = _PLAN + combos_sql()
#: The plan of kbulk_* with posteriors.
_BULK_SQL = POSTERIOR + _COMBOS[len(RETAIL) :] + _BULK


def _kbulk(s, d) -> DataFrame:
    m = D.retail(s, d)
    ref = T.reference_counts(m)
    chosen = S.combinations(m.obs, S.plan(ref, 3, 5, True), 3, 11)
    return S.aggregate(m.counts, ref, chosen, m.var, 3)


@query("kbulk_combinations", _COMBOS + "z AS (SELECT 1) SELECT label, sample_id::INT AS sample_id, cell_id FROM cho")
def _(s, d):
    m = D.retail(s, d)
    return S.combinations(m.obs, S.plan(T.reference_counts(m), 3, 5, True), 3, 11)


@query("kbulk_mean", _COMBOS + "z AS (SELECT 1) SELECT label, sample_id::INT AS sample_id, gene_id, k_sum, round(mean, 6) AS mean, round(zero_fraction, 6) AS zero_fraction, exposure_sum::BIGINT AS exposure_sum FROM agg JOIN ex USING (label, sample_id)")
def _(s, d):
    return rounded(_kbulk(s, d), "mean", "zero_fraction")


@query("kbulk_unique")
def _(s, d):
    m = D.retail(s, d)
    return S.unique_combinations(m.obs, S.plan(T.reference_counts(m), 3, 5, True), 3, 11)


@query(
    "kbulk_signals",
    _BULK_SQL + "SELECT label, sample_id::INT AS sample_id, gene_id, round(signal, 6) AS signal, round(h, 6) AS posterior_entropy, round(greatest(h0 - h, 0), 6) AS mutual_information FROM ks",
)
def _(s, d):
    rows = _kbulk(s, d).select(F.lit("global").alias("scope"), "label", "sample_id", "gene_id", F.col("k_sum").alias("k"), F.col("exposure_sum").alias("n_ref"))
    out = M.infer(rows, _priors(s, d), _CONFIG, raw_exposure=True)
    return rounded(out.select("label", "sample_id", "gene_id", "signal", "posterior_entropy", "mutual_information"), "signal", "posterior_entropy", "mutual_information")


# Grids, likelihoods, posteriors


def _rows(s, d) -> DataFrame:
    return SHARED.held(s, ("compressed", d), lambda: M.compressed(D.retail(s, d)))


def _label_rows(s, d) -> DataFrame:
    return SHARED.held(s, ("compressed by label", d), lambda: M.compressed(D.retail(s, d), by_label=True))


def _scale(s, d) -> F.Column:
    """The mean of positive references, which compressed observations carry along."""
    return F.col("n_mean")


def _priors(s, d, config: M.FitConfig = _CONFIG) -> DataFrame:
    return M.initial_priors(M.support_tops(_rows(s, d), _scale(s, d), config), config)


@query("compressed_observations", RETAIL + "z AS (SELECT 1) SELECT gene_id, k, n AS n_ref, count(*)::BIGINT AS weight FROM dense JOIN ref USING (cell_id) WHERE n > 0 GROUP BY ALL")
def _(s, d):
    return _rows(s, d).select("gene_id", "k", "n_ref", "weight")


@query("support_grid_observed", POSTERIOR + "z AS (SELECT 1) SELECT gene_id, j::INT AS j, round(p, 9) AS p FROM grid")
def _(s, d):
    return _priors(s, d).select("gene_id", F.posexplode("support").alias("j", "p")).select("gene_id", "j", F.round("p", 9).alias("p"))


@query(
    "support_grid_sqrt",
    POSTERIOR + "z AS (SELECT 1) SELECT gene_id, j::INT AS j, round(least(greatest(t * 1.5::DOUBLE, 1e-12), 1) * (j / 15) ** 2, 9) AS p FROM top, (SELECT unnest(range(16)) AS j)",
)
def _(s, d):
    return _priors(s, d, M.FitConfig(points=16, spacing="sqrt")).select("gene_id", F.posexplode("support").alias("j", "p")).select("gene_id", "j", F.round("p", 9).alias("p"))


@query("support_top_quantile", POSTERIOR + "z AS (SELECT 1) SELECT gene_id, round(least(greatest(quantile_cont(k / n, 0.95), 1e-12), 1), 9) AS top FROM obsn GROUP BY gene_id")
def _(s, d):
    rows = _rows(s, d)
    return M.support_tops(rows, _scale(s, d), M.FitConfig(support_from="quantile")).select("gene_id", F.round("top", 9).alias("top"))


@query("rate_grid", POSTERIOR + "z AS (SELECT 1) SELECT gene_id, j::INT AS j, round(greatest(max(k) * 1.5::DOUBLE, 1e-12) * j / 15, 9) AS p FROM obsn, (SELECT unnest(range(16)) AS j) GROUP BY gene_id, j")
def _(s, d):
    return _priors(s, d, M.FitConfig(points=16, likelihood="poisson")).select("gene_id", F.posexplode("support").alias("j", "p")).select("gene_id", "j", F.round("p", 9).alias("p"))


_SUMMARY = (
    "su AS (SELECT gene_id, k, n, arg_min(p, j) FILTER (pp = mp) AS sup, -sum(pp * ln(greatest(pp, 1e-12))) AS h, -sum(q * ln(q)) AS h0 "
    "FROM (SELECT *, max(pp) OVER (PARTITION BY gene_id, k, n) AS mp FROM soft) GROUP BY ALL) "
)


@query(
    "map_signal",
    POSTERIOR
    + _SUMMARY
    + """SELECT cell_id, gene_id, round(sup * s, 6) AS signal, round(h, 6) AS posterior_entropy, round(h0, 6) AS prior_entropy, round(greatest(h0 - h, 0), 6) AS mutual_information,
    round(sup, 6) AS map_probability FROM obsn JOIN su USING (gene_id, k, n), mean""",
)
def _(s, d):
    out = M.signals(D.retail(s, d), _priors(s, d), _CONFIG).expanded()
    return rounded(
        out.select("cell_id", "gene_id", "signal", "posterior_entropy", "prior_entropy", "mutual_information", "map_probability"),
        "signal", "posterior_entropy", "prior_entropy", "mutual_information", "map_probability",
    )


def _other(kind: str) -> str:
    """SQL summary of the posterior under another likelihood, on a rate grid or the probability grid."""
    if kind == "poisson":
        grid = "g2 AS (SELECT gene_id, j, greatest(max(k) * 1.5::DOUBLE, 1e-12) * j / 15 AS p FROM obsn, (SELECT unnest(range(16)) AS j) GROUP BY gene_id, j)"
        ll = "k * ln(greatest(p, 1e-12)) - greatest(p, 1e-12)"
    else:
        grid = "g2 AS (SELECT gene_id, j, p FROM grid)"
        mean = "(n * least(greatest(p, 1e-12), 1 - 1e-12))"
        ll = f"k * ln({mean} + 1e-12) - (k + 100) * ln(100 + {mean})"
    return (
        POSTERIOR
        + f"""{grid}, j2 AS (SELECT gene_id, k, n, j, p, {ll} AS z FROM keys JOIN g2 USING (gene_id)), m2 AS (SELECT *, max(z) OVER (PARTITION BY gene_id, k, n) AS mz FROM j2),
    s2 AS (SELECT *, exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY gene_id, k, n) AS pp FROM m2)
    SELECT gene_id, k, n::BIGINT AS n_ref, round(-sum(pp * ln(greatest(pp, 1e-12))), 6) AS posterior_entropy, round(sum(p * pp), 6) AS posterior_mean FROM s2 GROUP BY ALL"""
    )


def _posteriors(s, d, likelihood: str) -> DataFrame:
    config = M.FitConfig(points=16, likelihood=likelihood)
    rows = _rows(s, d)
    out = M.infer(rows, _priors(s, d, config), config, channels=("posterior", "support"))
    mean = X.total(F.zip_with("posterior", "support", lambda a, b: a * b))
    return out.select("gene_id", "k", "n_ref", r6("posterior_entropy").alias("posterior_entropy"), r6(mean).alias("posterior_mean"))


@query("posterior_binomial", POSTERIOR + "z AS (SELECT 1) SELECT gene_id, k, n::BIGINT AS n_ref, round(-sum(pp * ln(greatest(pp, 1e-12))), 6) AS posterior_entropy, round(sum(p * pp), 6) AS posterior_mean FROM soft GROUP BY ALL")
def _(s, d):
    return _posteriors(s, d, "binomial")


@query("posterior_negbin", _other("negative_binomial"))
def _(s, d):
    return _posteriors(s, d, "negative_binomial")


@query("posterior_poisson", _other("poisson"))
def _(s, d):
    return _posteriors(s, d, "poisson")


@query(
    "posterior_label_prior",
    RETAIL
    + """lm AS (SELECT label, avg(n) AS nm FROM ref WHERE n > 0 GROUP BY label), o AS (SELECT DISTINCT label, gene_id, k, r.n::DOUBLE AS n FROM dense d JOIN ref r USING (cell_id, label) WHERE r.n > 0),
    t AS (SELECT label, gene_id, least(greatest(greatest(max(k / n * nm), max(k)) / max(nm), 1e-12), 1) AS t, max(nm) AS nm FROM o JOIN lm USING (label) GROUP BY ALL),
    g AS (SELECT label, gene_id, j, nm, least(t * 1.5::DOUBLE, 1) * j / 15 AS p FROM t, (SELECT unnest(range(16)) AS j)),
    z1 AS (SELECT label, gene_id, k, n, j, p, k * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (n - k) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) AS z FROM o JOIN g USING (label, gene_id)),
    z2 AS (SELECT *, exp(z - max(z) OVER (PARTITION BY label, gene_id, k, n)) AS e FROM z1), z3 AS (SELECT *, e / sum(e) OVER (PARTITION BY label, gene_id, k, n) AS pp FROM z2)
    SELECT 'label:' || label AS scope, gene_id, k, n::BIGINT AS n_ref, round(-sum(pp * ln(greatest(pp, 1e-12))), 6) AS posterior_entropy FROM z3 GROUP BY ALL""",
)
def _(s, d):
    rows = _label_rows(s, d)
    priors = M.initial_priors(M.support_tops(rows, F.col("n_mean"), _CONFIG), _CONFIG)
    return M.infer(rows, priors, _CONFIG).select("scope", "gene_id", "k", "n_ref", r6("posterior_entropy").alias("posterior_entropy"))


_NLL = """, lz AS (SELECT gene_id, k, n, max(z) + ln(sum(exp(z - mz))) + lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) AS lz
    FROM (SELECT *, max(z) OVER (PARTITION BY gene_id, k, n) AS mz FROM joint) GROUP BY gene_id, k, n, mz)"""


@query("gene_nll", POSTERIOR.rstrip(", \n") + _NLL + " SELECT gene_id, round(-avg(lz), 6) AS nll FROM obsn JOIN lz USING (gene_id, k, n) GROUP BY gene_id")
def _(s, d):
    return M.gene_nll(_rows(s, d), _priors(s, d), _CONFIG).select("gene_id", r6("nll").alias("nll"))


_EM1 = (
    POSTERIOR.rstrip(", \n")
    + """, wt AS (SELECT gene_id, k, n, count(*) AS w FROM obsn GROUP BY ALL),
    e1 AS (SELECT gene_id, j, greatest(sum(w * pp), 1e-12) AS u, any_value(p) AS p FROM soft JOIN wt USING (gene_id, k, n) GROUP BY gene_id, j),
    p1 AS (SELECT gene_id, j, p, u / sum(u) OVER (PARTITION BY gene_id) AS q FROM e1)"""
)


@query("em_one_step", _EM1 + " SELECT gene_id, j::INT AS j, round(q, 6) AS prob FROM p1")
def _(s, d):
    return _exploded(M.em_step(_rows(s, d), _priors(s, d), _CONFIG))


def _exploded(priors: DataFrame) -> DataFrame:
    return priors.select("gene_id", F.posexplode("prob").alias("j", "p")).select("gene_id", "j", r6("p").alias("prob"))


_EM2 = (
    _EM1
    + """, y1 AS (SELECT j1.gene_id, j1.k, j1.n, j1.j, p1.p, z - ln(j1.q) + ln(greatest(p1.q, 1e-12)) AS z FROM joint j1 JOIN p1 ON p1.gene_id = j1.gene_id AND p1.j = j1.j),
    y2 AS (SELECT *, exp(z - max(z) OVER (PARTITION BY gene_id, k, n)) AS e FROM y1), y3 AS (SELECT *, e / sum(e) OVER (PARTITION BY gene_id, k, n) AS pp FROM y2),
    e2 AS (SELECT gene_id, j, greatest(sum(w * pp), 1e-12) AS u, any_value(p) AS p FROM y3 JOIN wt USING (gene_id, k, n) GROUP BY gene_id, j),
    p2 AS (SELECT gene_id, j, p, u / sum(u) OVER (PARTITION BY gene_id) AS q FROM e2)"""
)


@query("em_two_step", _EM2 + " SELECT gene_id, j::INT AS j, round(q, 6) AS prob FROM p2")
def _(s, d):
    rows = _rows(s, d)
    return _exploded(M.em_step(rows, M.em_step(rows, _priors(s, d), _CONFIG), _CONFIG))


@query("em_in_parts", _EM2 + " SELECT gene_id, j::INT AS j, round(q, 6) AS prob FROM p2")
def _(s, d):
    """Two iterations over parts of a few hundred observations, in blocks of 64."""
    config = M.FitConfig(points=16, max_iterations=2, tolerance=1e-12, block=64)
    return _exploded(M.fit_large(_rows(s, d), F.col("n_mean"), config, part=300))


def _step(s, d) -> DataFrame:
    return M.em_step(_rows(s, d), _priors(s, d), _CONFIG)


@query("prior_entropy_rank", _EM1 + ", h AS (SELECT gene_id, -sum(q * ln(greatest(q, 1e-12))) AS h FROM p1 GROUP BY 1) SELECT gene_id, round(h, 6) AS score, row_number() OVER (ORDER BY round(h, 9) DESC, gene_id)::INT AS rank FROM h")
def _(s, d):
    return rounded(L.ranked(_step(s, d).select("gene_id", F.round(X.entropy(F.col("prob")), 9).alias("score"))), "score")


@query("curve_cdf", _EM1 + " SELECT gene_id, j::INT AS j, round(sum(q) OVER (PARTITION BY gene_id ORDER BY j), 6) AS cdf FROM p1")
def _(s, d):
    return _step(s, d).select("gene_id", F.posexplode(X.cumulative(F.col("prob"))).alias("j", "c")).select("gene_id", "j", r6("c").alias("cdf"))


@query("support_diagnostics", _EM1 + """, c AS (SELECT *, sum(q) OVER (PARTITION BY gene_id ORDER BY j) AS c, max(q) OVER (PARTITION BY gene_id) AS mq FROM p1),
    x AS (SELECT gene_id, coalesce(min(j) FILTER (c >= 0.99::DOUBLE), 15) AS qi, min(j) FILTER (q = mq) AS mi, max(q) FILTER (j = 15) AS em, sum(q) FILTER (j >= 14) AS tm FROM c GROUP BY gene_id)
    SELECT gene_id, qi::INT AS quantile_index, mi::INT AS map_index, round(em, 6) AS edge_mass, round(tm, 6) AS tail_mass,
    qi >= 15 OR mi >= 15 OR em >= 0.01 OR ((qi >= 14 OR mi >= 14) AND tm >= 0.05) AS expand FROM x""")
def _(s, d):
    return rounded(M.diagnostics(_step(s, d)).drop("scope"), "edge_mass", "tail_mass")


@query("em_converged")
def _(s, d):
    out = M.fit_priors(_rows(s, d), _scale(s, d), M.FitConfig(points=64))
    return out.select("scope", "gene_id", "n_iter", r6("final_objective").alias("final_objective"), r6(X.entropy(F.col("prob"))).alias("prior_entropy"))


@query("adaptive_fit")
def _(s, d):
    out = M.fit_priors(_rows(s, d), _scale(s, d), M.FitConfig(points=32, max_iterations=50, adaptive=True), batch=8)
    return out.select("gene_id", "rounds", "n_iter", r6(F.element_at("support", -1)).alias("top"), r6("final_objective").alias("final_objective"))


@query("fit_by_label")
def _(s, d):
    out = M.fit_priors(_label_rows(s, d), F.col("n_mean"), M.FitConfig(points=32, max_iterations=20))
    return out.select("scope", "gene_id", "n_iter", r6("final_objective").alias("final_objective"))


# Curves, labels, checkpoints


@query("curve_density", _EM1 + " SELECT gene_id, j::INT AS j, round(p * s, 6) AS x, round(q, 6) AS prob FROM p1, mean")
def _(s, d):
    return rounded(C.curve_points(_step(s, d)).select("gene_id", "j", "x", "prob"), "x", "prob")


@query(
    "curve_summary",
    _EM1
    + """, c AS (SELECT *, max(q) OVER (PARTITION BY gene_id) AS mq FROM p1) SELECT gene_id, round(sum(p * q * s), 6) AS mean, round(arg_min(p * s, j) FILTER (q = mq), 6) AS map,
    round(-sum(q * ln(greatest(q, 1e-12))), 6) AS entropy FROM c, mean GROUP BY gene_id""",
)
def _(s, d):
    return rounded(C.curve_summaries(_step(s, d)).drop("scope"), "mean", "map", "entropy")


@query(
    "display_cutoff",
    _EM1 + ", c AS (SELECT *, sum(q) OVER (PARTITION BY gene_id ORDER BY j) AS c FROM p1) SELECT gene_id, round(coalesce(min(p * s) FILTER (c >= 0.95::DOUBLE), max(p * s)), 6) AS cutoff FROM c, mean GROUP BY gene_id",
)
def _(s, d):
    return rounded(C.display_cutoff(_step(s, d), 0.95).drop("scope"), "cutoff")


_LABELS = (
    RETAIL
    + """lm AS (SELECT label, avg(n) AS nm FROM ref WHERE n > 0 GROUP BY label), o AS (SELECT label, gene_id, d.k, r.n::DOUBLE AS n, count(*) AS w FROM dense d JOIN ref r USING (cell_id, label) WHERE r.n > 0 GROUP BY ALL),
    t AS (SELECT label, gene_id, least(greatest(greatest(max(k / n * nm), max(k)) / max(nm), 1e-12), 1) AS t, max(nm) AS nm FROM o JOIN lm USING (label) GROUP BY ALL),
    g AS (SELECT label, gene_id, j, nm, least(t * 1.5::DOUBLE, 1) * j / 15 AS p FROM t, (SELECT unnest(range(16)) AS j)),
    z1 AS (SELECT label, gene_id, k, n, j, p, nm, w, k * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (n - k) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) AS z FROM o JOIN g USING (label, gene_id)),
    z2 AS (SELECT *, exp(z - max(z) OVER (PARTITION BY label, gene_id, k, n)) AS e FROM z1), z3 AS (SELECT *, e / sum(e) OVER (PARTITION BY label, gene_id, k, n) AS pp FROM z2),
    e1 AS (SELECT label, gene_id, j, any_value(p * nm) AS x, greatest(sum(w * pp), 1e-12) AS u FROM z3 GROUP BY label, gene_id, j),
    pr AS (SELECT label, gene_id, x, u / sum(u) OVER (PARTITION BY label, gene_id) AS q FROM e1), ls AS (SELECT DISTINCT label FROM pr),
    ab AS (SELECT a.label AS a, b.label AS b FROM ls a, ls b),
    un AS (SELECT a, b, gene_id, x, q AS p, 0.0::DOUBLE AS q FROM pr JOIN ab ON label = a UNION ALL SELECT a, b, gene_id, x, 0.0, q FROM pr JOIN ab ON label = b),
    al AS (SELECT a, b, gene_id, x, sum(p) AS p, sum(q) AS q FROM un GROUP BY ALL),
    js AS (SELECT a, b, gene_id, sum(0.5::DOUBLE * p * ln(greatest(p, 1e-12) / greatest((p + q) / 2, 1e-12)) + 0.5::DOUBLE * q * ln(greatest(q, 1e-12) / greatest((p + q) / 2, 1e-12))) AS jsd, sum(least(p, q)) AS ov FROM al GROUP BY ALL)
    """
)


def _label_priors(s, d) -> DataFrame:
    rows = _label_rows(s, d)
    return M.em_step(rows, M.initial_priors(M.support_tops(rows, F.col("n_mean"), _CONFIG), _CONFIG), _CONFIG)


@query("label_jsd", _LABELS + "SELECT 'label:' || a AS label_a, 'label:' || b AS label_b, round(avg(jsd), 6) AS value FROM js GROUP BY a, b")
def _(s, d):
    return rounded(C.label_similarity(_label_priors(s, d)), "value")


@query("label_overlap", _LABELS + "SELECT 'label:' || a AS label_a, 'label:' || b AS label_b, round(avg(ov), 6) AS value FROM js GROUP BY a, b")
def _(s, d):
    return rounded(C.label_similarity(_label_priors(s, d), "overlap"), "value")


@query("checkpoint_merge", _EM1 + " SELECT gene_id, count(*)::INT AS points, round(sum(q), 6) AS mass FROM p1 GROUP BY gene_id")
def _(s, d):
    p = _step(s, d)
    halves = [p.filter(F.crc32("gene_id") % 2 == i) for i in (0, 1)]
    return P.merged([(h, {"likelihood": "binomial"}) for h in halves]).select("gene_id", F.size("support").alias("points"), r6(X.total(F.col("prob"))).alias("mass"))


@query("checkpoint_inspect", _EM1 + " SELECT 'global' AS scope, count(DISTINCT gene_id)::BIGINT AS genes, 16 AS points, round(max(s), 6) AS scale_min, round(max(s), 6) AS scale_max FROM p1, mean")
def _(s, d):
    return rounded(C.inspect(_step(s, d)), "scale_min", "scale_max")


@query(
    "full_matrix_layout",
    POSTERIOR + _SUMMARY + "SELECT o.cell_id, v.gene_id, round(sup * s, 6) AS signal FROM obs o CROSS JOIN var v LEFT JOIN (SELECT * FROM obsn WHERE gene_id LIKE 'Brand#1%') x USING (cell_id, gene_id) LEFT JOIN su ON su.gene_id = x.gene_id AND su.k = x.k AND su.n = x.n, mean",
)
def _(s, d):
    m = D.retail(s, d)
    rows = M.observations(m).filter((F.col("n_ref") > 0) & F.col("gene_id").startswith("Brand#1"))
    return rounded(C.full_matrix(M.infer(rows, _priors(s, d), _CONFIG), m.obs, m.var), "signal")


@query("bin_edges", _EM1 + """, e AS (SELECT gene_id, j, p, lead(p) OVER (PARTITION BY gene_id ORDER BY j) AS nx FROM p1)
    SELECT gene_id, (j + 1)::INT AS i, round((p + nx) / 2, 9) AS edge FROM e WHERE nx IS NOT NULL UNION ALL SELECT gene_id, 0, round(min(p), 9) FROM e GROUP BY gene_id
    UNION ALL SELECT gene_id, 16, round(max(p), 9) FROM e GROUP BY gene_id""")
def _(s, d):
    return _step(s, d).select("gene_id", F.posexplode(X.bin_edges(F.col("support"))).alias("i", "edge")).select("gene_id", "i", F.round("edge", 9).alias("edge"))


@query(
    "interpolate_grid",
    _EM1
    + """, m AS (SELECT gene_id, j, p, q, lead(p) OVER w AS p1, lead(q) OVER w AS q1, max(p) OVER (PARTITION BY gene_id) AS mp FROM p1 WINDOW w AS (PARTITION BY gene_id ORDER BY j)),
    g AS (SELECT DISTINCT gene_id, i, mp * i / 30 AS x FROM m, (SELECT unnest(range(31)) AS i)),
    v AS (SELECT g.gene_id, i, greatest(max(q + (q1 - q) * (x - p) / (p1 - p)), 1e-12) AS v FROM g JOIN m ON m.gene_id = g.gene_id AND m.p1 IS NOT NULL AND x >= p - 1e-15 AND x <= p1 + 1e-15 GROUP BY ALL)
    SELECT gene_id, i::INT AS i, round(v / sum(v) OVER (PARTITION BY gene_id), 6) AS prob FROM v""",
)
def _(s, d):
    grid = X.linear_grid(F.element_at("support", -1), 31)
    p = X.interpolated(F.col("support"), F.col("prob"), grid)
    return _step(s, d).select("gene_id", F.posexplode(p).alias("i", "p")).select("gene_id", "i", r6("p").alias("prob"))


@query(
    "peak_indices",
    _EM1 + ", l AS (SELECT gene_id, j, q, lag(q) OVER w AS a, lead(q) OVER w AS b FROM p1 WINDOW w AS (PARTITION BY gene_id ORDER BY j)) SELECT gene_id, j::INT AS peak FROM l WHERE (a IS NULL OR a < q) AND (b IS NULL OR b < q)",
)
def _(s, d):
    return _step(s, d).select("gene_id", F.explode(G.peak_indices(F.col("prob"))).alias("peak"))


@query(
    "prior_distances",
    _EM1
    + """, u AS (SELECT gene_id, q, 1.0::DOUBLE / 16 AS v FROM p1) SELECT gene_id, round(sum(q * ln((q + 1e-12) / (v + 1e-12))), 6) AS kl,
    round(sum(0.5::DOUBLE * q * ln((q + 1e-12) / ((q + v) / 2 + 1e-12)) + 0.5::DOUBLE * v * ln((v + 1e-12) / ((q + v) / 2 + 1e-12))), 6) AS jsd, round(sum(least(q, v)), 6) AS overlap,
    round(greatest(1 + sum(q * ln(greatest(q, 1e-12))) / ln(16), 0), 6) AS confidence FROM u GROUP BY gene_id""",
)
def _(s, d):
    p, u = F.col("prob"), X.uniform(16)
    return _step(s, d).select("gene_id", r6(X.kl(p, u)).alias("kl"), r6(X.jsd(p, u)).alias("jsd"), r6(X.overlap(p, u)).alias("overlap"), r6(X.confidence(p)).alias("confidence"))


@query("lgamma_values", "SELECT l_orderkey, l_linenumber, round(lgamma(l_quantity + 1), 6) AS v FROM lineitem")
def _(s, d):
    return D.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", r6(X.lgamma(F.col("l_quantity") + 1)).alias("v"))


@query(
    "posterior_mean",
    POSTERIOR.rstrip(", \n") + ", wt AS (SELECT gene_id, k, n, count(*) AS w FROM obsn GROUP BY ALL) SELECT gene_id, j::INT AS j, round(sum(w * pp) / sum(w), 6) AS prob FROM soft JOIN wt USING (gene_id, k, n) GROUP BY gene_id, j",
)
def _(s, d):
    out = M.infer(_rows(s, d), _priors(s, d), _CONFIG, channels=("posterior",))
    return _exploded(K.aggregate_posterior(out))


_PHASE = (
    RETAIL
    + """w AS (SELECT cell_id, list(k ORDER BY gene_id) AS v FROM dense WHERE gene_id IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') GROUP BY cell_id),
    c AS (SELECT cell_id, i, CASE WHEN list_stddev_pop(v) > 1e-12 THEN (v[i] - list_avg(v)) / (2 * list_stddev_pop(v)) ELSE 0 END AS r FROM w, (SELECT unnest(range(1, 6)) AS i))
    """
)


@query("phase_assign", _PHASE + "SELECT cell_id, (arg_min(i, struct_pack(a := -round(r, 9), b := i)) - 1)::INT AS phase, round(max(r), 6) AS best FROM c GROUP BY cell_id")
def _(s, d):
    return Y.phases(D.retail(s, d), list(_SET)).select("cell_id", "phase", r6("best").alias("best"))


@query(
    "cycle_order",
    _PHASE
    + """, a AS (SELECT cell_id, (arg_min(i, struct_pack(a := -round(r, 9), b := i)) - 1)::INT AS phase, list(round(r, 9) ORDER BY i) AS rs FROM c GROUP BY cell_id),
    p AS (SELECT cell_id, phase, round(rs[(phase + 4) % 5 + 1] - rs[(phase + 1) % 5 + 1], 6) AS progress FROM a)
    SELECT cell_id, phase, progress, round((row_number() OVER (PARTITION BY phase ORDER BY progress DESC, cell_id) - 1) / nullif(count(*) OVER (PARTITION BY phase) - 1, 0), 6) AS place FROM p""",
)
def _(s, d):
    return rounded(Y.cycle_order(Y.phases(D.retail(s, d), list(_SET))).drop("best"), "place")


def _shapes(s, d):
    return M.fit_priors(_rows(s, d), _scale(s, d), M.FitConfig(points=48, max_iterations=30))


@query("gmm_search")
def _(s, d):
    return rounded(G.mixtures(_shapes(s, d), G.StageConfig(max_components=4)).select("gene_id", "k", F.col("jsd").alias("error")), "error")


@query("gmm_fit")
def _(s, d):
    out = G.mixtures(_shapes(s, d), G.StageConfig(max_components=3), G.FitConfig(prunings=1))
    parts = out.select("gene_id", "k", r6("jsd").alias("error"), F.explode("components").alias("c"))
    return parts.select("gene_id", "k", "error", *[r6(f"c.{c}").alias(c) for c in ("weight", "mean", "std", "left", "right")])


@query("gmm_paths")
def _(s, d):
    """Errors and residuals by number of components, of a search that takes whole stages, along the scaled axis."""
    config = G.StageConfig(max_components=4, frontier="full_stage", select="marginal_gain", refit=G.RefitConfig(iterations=10, free=False))
    out = G.mixtures(_shapes(s, d), config, axis="scaled")
    paths = F.arrays_zip("jsd_path", "residual_mass", "residual_peak")
    rows = out.select("gene_id", "k", F.posexplode(paths).alias("n", "x"))
    return rows.select("gene_id", "k", (F.col("n") + 1).alias("n"), *[r6(f"x.{c}").alias(c) for c in ("jsd_path", "residual_mass", "residual_peak")])


_PATHS = """WITH e AS (SELECT l_suppkey, l_linenumber AS n, avg(l_tax) + 0.1::DOUBLE / l_linenumber AS e FROM lineitem GROUP BY l_suppkey, l_linenumber),
x AS (SELECT l_suppkey, list(round(e, 9) ORDER BY n) AS errors, list(n::INTEGER ORDER BY n) AS targets FROM e GROUP BY l_suppkey)
"""


def _error_paths(s, d):
    each = D.read(s, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg((F.avg("l_tax") + F.lit(0.1) / F.col("l_linenumber")).alias("e"))
    path = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("n"), F.round("e", 9).alias("e"))))
    return each.groupBy("l_suppkey").agg(path.alias("x")).select("l_suppkey", F.col("x.e").alias("errors"), F.col("x.n").alias("targets"))


@query(
    "gmm_frontier",
    _PATHS
    + """SELECT l_suppkey, targets[list_position(errors, list_min(errors))] AS best_prefix, 1 AS single_step, list_max(targets) AS full_stage FROM x""",
)
def _(s, d):
    x = _error_paths(s, d)
    return x.select("l_suppkey", *[G.frontier_column(F.lit(0), F.col("targets"), F.col("errors"), strategy).alias(strategy) for strategy in G.STRATEGIES])


@query(
    "gmm_component_count",
    _PATHS
    + """, i AS (SELECT l_suppkey, errors, list_position(list_transform(errors, lambda e: e <= 0.05::DOUBLE), true) AS within,
      list_transform(range(1, len(errors)), lambda j: errors[j] - errors[j + 1]) AS gains FROM x),
    g AS (SELECT *, list_filter(range(1, len(gains)), lambda j: gains[j] <= 0.004::DOUBLE AND gains[j + 1] <= 0.004::DOUBLE)[1] AS idle,
      list_transform(range(1, len(errors) + 1), lambda j: errors[j] + 0.01::DOUBLE * j) AS dear FROM i)
    SELECT l_suppkey, coalesce(nullif(within, 0), list_position(errors, list_min(errors)))::INTEGER AS threshold_first,
      coalesce(nullif(within, 0), idle, list_position(errors, list_min(errors)))::INTEGER AS marginal_gain,
      coalesce(nullif(within, 0), list_position(dear, list_min(dear)))::INTEGER AS penalized_error FROM g""",
)
def _(s, d):
    x = _error_paths(s, d)
    modes = [G.StageConfig(select=m, error_threshold=0.05, min_gain=0.004, patience=2, penalty=0.01) for m in G.SELECTIONS]
    return x.select("l_suppkey", *[G.count_column(F.col("errors"), c).alias(c.select) for c in modes])


@query("stream_scores", POSTERIOR + _SUMMARY + "SELECT gene_id, k, n::BIGINT AS n_ref, round(sup * s, 6) AS signal, round(h, 6) AS posterior_entropy FROM su, mean")
def _(s, d):
    rows = _rows(s, d)
    mean = float(rows.agg(F.max("n_mean")).first()[0])
    out = score_stream(rows.select("gene_id", "k", "n_ref"), _priors(s, d), mean, _CONFIG)
    return rounded(out, "signal", "posterior_entropy")


@query(
    "kbulk_server",
    POSTERIOR
    + "plan AS (SELECT label, count(*)::BIGINT AS cells, 24::BIGINT AS target, 24::BIGINT AS ways FROM ref GROUP BY label HAVING count(*) >= 8), "
    + combos_sql(8, 5, "n / m * (SELECT s FROM mean)").replace("JOIN ref USING (label, cell_id)", "JOIN (SELECT *, avg(n) OVER (PARTITION BY label) AS m FROM ref) USING (label, cell_id)")
    + _BULK
    + "SELECT label, gene_id, round(avg(signal), 6) AS mean, round(stddev_pop(signal), 6) AS std, round(avg(h), 6) AS entropy FROM ks GROUP BY ALL",
)
def _(s, d):
    m = D.retail(s, d)
    ref = T.exposure(T.reference_counts(m), M.scale_of(m), ["label"]).select("cell_id", "label", F.col("n_eff").alias("n_ref"))
    agg = S.aggregate(m.counts, ref, S.combinations(m.obs, S.plan(ref, 8, 24, False), 8, 5), m.var, 8)
    rows = agg.select(F.lit("global").alias("scope"), "label", "sample_id", "gene_id", F.col("k_sum").alias("k"), F.col("exposure_sum").alias("n_ref"))
    out = M.infer(rows, _priors(s, d), _CONFIG, raw_exposure=True)
    stats = out.groupBy("label", "gene_id").agg(F.avg("signal").alias("mean"), F.stddev_pop("signal").alias("std"), F.avg("posterior_entropy").alias("entropy"))
    return rounded(stats, "mean", "std", "entropy")
