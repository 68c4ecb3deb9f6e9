"""Registered queries of the command surface: texts, checks, scopes, checkpoints, facades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import expr as X
from tallyspark.functions import text as W
from tallyspark.operators import checkpoints as P
from tallyspark.operators import checks as K
from tallyspark.operators import curves as C
from tallyspark.operators import lists as L
from tallyspark.operators import model as M
from tallyspark.operators import sampling as S
from tallyspark.operators import stats as T
from tallyspark.plans import catalogue as Q
from tallyspark.plans import facades
from tallyspark.plans.catalogue import RETAIL, query, r6, rounded
from tallyspark.sources import matrices as D

# Rules and texts

@query(
    "nuisance_builtin",
    """WITH g AS (SELECT DISTINCT CASE p_size % 12 WHEN 0 THEN 'MT-' || p_size WHEN 1 THEN 'RPL' || p_size WHEN 2 THEN 'MALAT1' WHEN 3 THEN 'HB' || chr((65 + p_size % 5)::INT) || p_size % 10
      WHEN 4 THEN 'HSPA' || p_size WHEN 5 THEN 'DNAJB' || p_size WHEN 6 THEN 'FOSB' WHEN 7 THEN 'rpl' || p_size WHEN 8 THEN 'Dusp' || p_size WHEN 9 THEN 'sig' || chr((65 + p_size % 26)::INT)
      WHEN 10 THEN 'Mrps' || p_size ELSE p_brand END AS gene_id FROM part)
    SELECT 'human' AS species, gene_id FROM g WHERE NOT (gene_id IN ('MALAT1', 'NEAT1', 'XIST', 'FTL', 'FTH1') OR gene_id[:3] IN ('MT-', 'RPL', 'RPS') OR gene_id[:4] IN ('MRPL', 'MRPS')
      OR regexp_full_match(gene_id, 'HB[A-Z][0-9]?|HSP(90|A|B|D|E|H)[A-Za-z0-9_]*|DNAJ[A-C][0-9]+|FOS[BL]?|JUN[BD]?|EGR[1-4]|IER[1-5][A-Z]?|DUSP[1-9][0-9]?'))
    UNION ALL SELECT 'mouse', gene_id FROM g WHERE NOT (gene_id IN ('Malat1', 'Neat1', 'Xist', 'Ftl1', 'Fth1') OR gene_id[:3] IN ('mt-', 'Rpl', 'Rps') OR gene_id[:4] IN ('Mrpl', 'Mrps')
      OR regexp_full_match(gene_id, 'Hb[a-z].*|Hsp(90|a|b|d|e|h)[A-Za-z0-9_]*|Dnaj[a-c][0-9]+|Fos[bl]?|Jun[bd]?|Egr[1-4]|Ier[1-5][a-z]?|Dusp[1-9][0-9]?'))
    UNION ALL SELECT 'ecoli', gene_id FROM g WHERE NOT (gene_id IN ('tsf', 'infA', 'infB', 'infC', 'ssrA') OR gene_id[:3] IN ('rpl', 'rps', 'rpm')
      OR regexp_full_match(gene_id, 'rr[slf][A-H]|tuf[AB]?|fus[A-Z]?|gro[ELS]+|dna[KJ][A-Za-z0-9_]*|clp[ABPX][A-Za-z0-9_]*|csp[A-I]'))
    UNION ALL SELECT 'bsub', gene_id FROM g WHERE NOT (gene_id IN ('tsf', 'infA', 'infB', 'infC', 'ssrA') OR gene_id[:3] IN ('rpl', 'rps', 'rpm')
      OR regexp_full_match(gene_id, 'rrn[A-Z]|tuf[A-Z]?|fus[A-Z]?|groE[SL][A-Za-z0-9_]*|dna[KJ][A-Za-z0-9_]*|clp[CEPQXY][A-Za-z0-9_]*|csp[A-Z]|sig[A-Z]|hbs[A-Za-z0-9_]*'))""",
)
def _(s, d):
    """Names made of part sizes and brands, of which each species' rules leave some."""
    size = F.col("p_size")
    made = {0: F.concat(F.lit("MT-"), size), 1: F.concat(F.lit("RPL"), size), 2: F.lit("MALAT1"), 3: F.concat(F.lit("HB"), F.chr(65 + size % 5), size % 10), 4: F.concat(F.lit("HSPA"), size), 5: F.concat(F.lit("DNAJB"), size), 6: F.lit("FOSB"), 7: F.concat(F.lit("rpl"), size), 8: F.concat(F.lit("Dusp"), size), 9: F.concat(F.lit("sig"), F.chr(65 + size % 26)), 10: F.concat(F.lit("Mrps"), size)}
    names = D.read(s, d, "part").select(F.coalesce(*[F.when(size % 12 == k, v) for k, v in made.items()], F.col("p_brand")).alias("gene_id")).distinct()
    out = None
    for species in sorted(L.RULES):
        one = L.filtered(names, L.RULES[species]).select(F.lit(species).alias("species"), "gene_id")
        out = one if out is None else out.union(one)
    return out


_GUIDE = "replace(p_type, ' ', '_') || '__' || p_size"


@query(
    "guide_targets",
    f"""WITH g AS (SELECT p_partkey, string_split(string_split({_GUIDE}, '__')[1], '_') AS p FROM part),
    t AS (SELECT p_partkey, len(p) AS n, CASE p[1] WHEN 'SMALL' THEN 'TINY' ELSE p[1] END AS a, CASE p[2] WHEN 'SMALL' THEN 'TINY' ELSE coalesce(p[2], '') END AS b FROM g),
    l AS (SELECT *, CASE WHEN n = 1 THEN a ELSE a || '_' || b END AS label FROM t)
    SELECT p_partkey, n::INT AS num_targets, a AS target_1, b AS target_2, label AS guide_target, CASE WHEN label IN ('TINY_PLATED', 'LARGE_BRUSHED') THEN 'control'
    WHEN starts_with(a, 'STAND') AND NOT starts_with(b, 'STAND') THEN b WHEN starts_with(b, 'STAND') AND NOT starts_with(a, 'STAND') THEN a ELSE label END AS target FROM l""",
)
def _(s, d):
    guide = F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("__"), F.col("p_size").cast("string"))
    rows = D.read(s, d, "part").select("p_partkey", W.guide_targets(guide, {"SMALL": "TINY"}, ["TINY_PLATED", "LARGE_BRUSHED"], "STAND").alias("g"))
    return rows.select("p_partkey", "g.*")


@query("clean_names", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment WHEN c_nationkey % 3 = 1 THEN c_name ELSE 'gene_' || c_custkey END AS name FROM customer")
def _(s, d):
    c = D.read(s, d, "customer")
    symbol = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit(" '"), "c_mktsegment", F.lit("' ")))
    ident = F.when(F.col("c_nationkey") % 3 == 1, F.col("c_name")).otherwise(F.lit("  "))
    return c.select("c_custkey", W.preferred_name(F.col("c_custkey"), symbol, ident).alias("name"))


@query("cell_name_parts", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'young' ELSE 'old' END AS age, CASE WHEN c_custkey % 3 = 0 THEN 'MPP' ELSE 'LT_HSC' END AS kind, c_custkey::BIGINT AS number FROM customer WHERE c_custkey % 5 <> 0")
def _(s, d):
    name = F.concat_ws("_", F.when(F.col("c_custkey") % 2 == 0, "young").otherwise("old"), F.when(F.col("c_custkey") % 3 == 0, "MPP").otherwise("LT_HSC"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, "x"))
    return D.read(s, d, "customer").select("c_custkey", W.cell_parts(name).alias("p")).filter("p IS NOT NULL").select("c_custkey", "p.*")


@query("label_parts", "SELECT p_partkey, nullif(regexp_extract(p_type, '^([^ ]+) (.+)$', 1), '') AS batch, nullif(regexp_extract(p_type, '^([^ ]+) (.+)$', 2), '') AS perturbation FROM part")
def _(s, d):
    return D.read(s, d, "part").select("p_partkey", W.label_parts(F.col("p_type"), " ").alias("p")).select("p_partkey", "p.*")


@query("truth_values", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN true WHEN 'N' THEN false END AS value FROM lineitem")
def _(s, d):
    given = F.when(F.col("l_returnflag") == "R", " True").when(F.col("l_returnflag") == "N", "NO").otherwise("maybe")
    return D.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", W.truth(given).alias("value"))


@query("display_source", "SELECT DISTINCT 'retail/label:' || c_mktsegment AS source FROM customer")
def _(s, d):
    label = F.concat(F.lit("label:"), "c_mktsegment")
    return D.read(s, d, "customer").select(W.display_source(label, F.lit("retail")).alias("source")).distinct()


@query("json_gene_list", RETAIL + "z AS (SELECT 1) SELECT gene_id, total::DOUBLE AS score FROM tot")
def _(s, d):
    one = T.gene_totals(D.retail(s, d)).agg(F.to_json(F.struct(F.collect_list("gene_id").alias("gene_names"), F.collect_list(F.col("total").cast("double")).alias("scores"))).alias("j"))
    zipped = one.select(W.json_genes(F.col("j")).alias("g")).select(F.explode(F.arrays_zip("g.gene_names", "g.scores")).alias("x"))
    return zipped.select(F.col("x.gene_names").alias("gene_id"), F.col("x.scores").alias("score"))


@query("ensembl_hint", RETAIL + "z AS (SELECT 1) SELECT bool_and(starts_with(gene_id, 'ENSG')) AS ensembl FROM (SELECT gene_id FROM var ORDER BY gene_id LIMIT 32)")
def _(s, d):
    return K.ensembl_like(D.retail(s, d).var.withColumn("pos", F.col("gene_id")))


# Checks, filters, joins


@query("matrix_faults", "SELECT count_if(v < 0)::BIGINT AS bad_counts, 0::BIGINT AS repeated_genes, 0::BIGINT AS repeated_cells FROM (SELECT unnest(embedding) AS v FROM embeddings)")
def _(s, d):
    return K.matrix_faults(D.vectors(s, d))


@query("single_cells", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_quantity > 10")
def _(s, d):
    rows = D.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("n_cells"), F.when(F.col("l_returnflag") == "R", "TRUE").alias("good_coverage"), F.when(F.col("l_quantity") > 10, "guide").otherwise("*").alias("guide"))
    return K.single_cells(rows).select("l_orderkey", "l_linenumber")


@query("browse_fitted", RETAIL + "z AS (SELECT 1) SELECT gene_id, total FROM tot WHERE contains(lower(gene_id), 'd#3') AND gene_id <> 'Brand#31'")
def _(s, d):
    m = D.retail(s, d)
    return K.browsed(T.gene_totals(m).select("gene_id", "total"), " D#3", "auto", m.var.filter("gene_id <> 'Brand#31'"))


@query("lacking_labels", "SELECT DISTINCT c_mktsegment AS label FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def _(s, d):
    priors = s.createDataFrame([("global",), ("label:BUILDING",), ("label:MACHINERY",)], "scope string")
    return K.lacking_labels(D.retail(s, d).obs, priors)


@query("guide_join", "SELECT c_custkey AS cell_id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, s_nationkey)::INT AS gem_group, s_name AS guide FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND (c_custkey % 2 = 1 OR s_nationkey = c_nationkey)")
def _(s, d):
    obs = D.read(s, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).cast("int").alias("gem_group"))
    guides = D.read(s, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_nationkey").cast("int").alias("gem_group"), F.col("s_name").alias("guide"))
    known = D.read(s, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("n"))
    agreeing = guides.join(known, "cell_id").filter((F.col("cell_id") % 2 == 1) | (F.col("gem_group") == F.col("n"))).drop("n")
    return K.with_guides(obs, agreeing).select("cell_id", "gem_group", "guide")


@query("shared_cells", "SELECT c_custkey AS cell_id, c_mktsegment AS label FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def _(s, d):
    return K.shared_cells(D.retail(s, d).obs, D.events(s, d).obs)


@query("alias_join", "SELECT l_orderkey, l_linenumber, coalesce(s_name, l_suppkey::VARCHAR) AS shown FROM lineitem LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0) ON s_suppkey = l_suppkey")
def _(s, d):
    names = D.read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(" ").alias("alias"))
    rows = D.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("id"))
    return K.with_aliases(rows, names, "id", "alias").drop("id")


@query("dataset_concat", RETAIL + "e AS (SELECT event_type AS gene_id, count(*)::BIGINT AS total FROM events GROUP BY 1) SELECT gene_id, total FROM tot UNION ALL SELECT gene_id, total FROM e")
def _(s, d):
    prefixed = lambda m, p: D.Matrix(m.counts.withColumn("cell_id", F.concat(F.lit(p), F.col("cell_id").cast("string"))), m.obs.withColumn("cell_id", F.concat(F.lit(p), F.col("cell_id").cast("string"))), m.var)
    both = K.concatenated(prefixed(D.retail(s, d), "c"), prefixed(D.events(s, d), "u"))
    return T.gene_totals(both).select("gene_id", "total")


@query("fit_scopes", "SELECT 'global' AS scope, count(*)::BIGINT AS cells FROM customer UNION ALL SELECT 'label:' || c_mktsegment, count(*) FROM customer GROUP BY 1")
def _(s, d):
    return K.scopes("both", D.retail(s, d).obs)


@query("last_mapping", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def _(s, d):
    return K.last_mapping(D.read(s, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")


@query("top_cells", RETAIL + "z AS (SELECT 1) SELECT cell_id, k FROM dense WHERE gene_id = 'Brand#11' ORDER BY k DESC, cell_id LIMIT 12")
def _(s, d):
    return K.top_cells(D.retail(s, d).counts.filter("gene_id = 'Brand#11'").select("cell_id", F.col("value").alias("k")))


_P = (
    Q._MW.rsplit("SELECT gene_id, round(u, 6)", 1)[0]
    + """, zz AS (SELECT gene_id, greatest((abs(u - n1 * n2 / 2) - 0.5::DOUBLE) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 0) AS x, log2((m1 + 1e-9) / (m2 + 1e-9)) AS fold FROM u),
    tt AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * x) AS t FROM zz),
    pp AS (SELECT gene_id, fold, least(2 * exp(-x * x / 2) / 2.5066282746310002::DOUBLE * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE))))), 1) AS p FROM tt),
    rr AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS nn FROM pp),
    ff AS (SELECT gene_id, fold, p, least(min(p * nn / r) OVER (ORDER BY p DESC, r DESC), 1) AS fdr FROM rr)"""
)


def _tests(s, d) -> DataFrame:
    rows = T.mann_whitney_sparse(D.retail(s, d), "BUILDING", "MACHINERY")
    return T.benjamini_hochberg(rows.withColumn("p", K.normal_tail(F.col("z"))))


@query("deg_sparse", _P + " SELECT gene_id, round(p, 6) AS p, round(fdr, 6) AS fdr, round(fold, 6) AS log2_fold_change FROM ff")
def _(s, d):
    return rounded(_tests(s, d).select("gene_id", "p", "fdr", "log2_fold_change"), "p", "fdr", "log2_fold_change")


Q.ORACLE_SQL["deg_fdr"] = _P + """ SELECT gene_id, round(u.u, 6) AS u, round((abs(u.u - n1 * n2 / 2) - 0.5::DOUBLE) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z,
    round(fold, 6) AS log2_fold_change, round(p, 6) AS p, round(fdr, 6) AS fdr FROM ff JOIN u USING (gene_id)"""


@query("deg_export", _P + " SELECT 'BUILDING' AS \"group\", gene_id, round(fdr, 6) AS fdr, row_number() OVER (ORDER BY round(fdr, 9), gene_id)::INT AS rank FROM ff WHERE round(fdr, 9) <= 1 AND abs(fold) >= 0.01 QUALIFY rank <= 5")
def _(s, d):
    tests = _tests(s, d).withColumns({"group": F.lit("BUILDING"), "fdr": F.round("fdr", 9)})
    return rounded(K.deg_export(tests, "group", 1.0, 0.01, 5).select("group", "gene_id", "fdr", "rank"), "fdr")


@query(
    "confidence_mask",
    RETAIL
    + """c AS (SELECT cell_id, gene_id, row_number() OVER (PARTITION BY cell_id ORDER BY k DESC, gene_id) AS r FROM dense),
    m AS (SELECT cell_id, gene_id, row_number() OVER (PARTITION BY cell_id ORDER BY md5('5|' || cell_id || '|' || gene_id), gene_id) AS q FROM c WHERE r <= 10) SELECT cell_id, gene_id FROM m WHERE q <= 5""",
)
def _(s, d):
    rows = D.retail(s, d).dense().select("cell_id", "gene_id", F.col("value").alias("confidence"))
    return K.confidence_mask(rows, 0.2, 0.4, 5).select("cell_id", "gene_id")


@query("gene_slice", RETAIL + "z AS (SELECT 1) SELECT cell_id, label, k AS value FROM dense WHERE gene_id = 'Brand#12'")
def _(s, d):
    return D.gene_slice(D.retail(s, d), "Brand#12")


@query("usable_genes", RETAIL + Q._WANTED_SQL + " SELECT pos, gene_id FROM w WHERE gene_id IN (SELECT gene_id FROM var) AND gene_id <> 'Brand#11'")
def _(s, d):
    m = D.retail(s, d)
    return L.usable(Q._wanted(s), m.var, m.var.filter("gene_id <> 'Brand#11'"))


@query("gene_subset", RETAIL + "z AS (SELECT 1) SELECT row_number() OVER (ORDER BY md5('9|' || gene_id), gene_id) - 1 AS pos, gene_id FROM var QUALIFY pos < 7")
def _(s, d):
    return S.gene_subset(D.retail(s, d).var, 7, 9).withColumn("pos", F.col("pos").cast("long"))


@query("reindexed", RETAIL + Q._WANTED_SQL + " SELECT pos, gene_id, total FROM w LEFT JOIN tot USING (gene_id)")
def _(s, d):
    return D.reindexed(T.gene_totals(D.retail(s, d)).select("gene_id", "total"), Q._wanted(s), "gene_id").select("pos", "gene_id", "total")


# Posteriors


def _signals(s, d) -> DataFrame:
    m = D.retail(s, d)
    return facades.extract_signals(m, Q._priors(s, d), Q._CONFIG)


_SU = Q.POSTERIOR + Q._SUMMARY


@query("posterior_summary", _SU + "SELECT gene_id, round(avg(h), 6) AS mean, round(quantile_cont(h, 0.5), 6) AS median, round(quantile_cont(h, 0.9), 6) AS p90, round(max(h), 6) AS max FROM obsn JOIN su USING (gene_id, k, n) GROUP BY gene_id")
def _(s, d):
    return rounded(K.value_summary(_signals(s, d), ["gene_id"], "posterior_entropy"), "mean", "median", "p90", "max")


@query("loss_weight_mean", _SU + "SELECT round(avg(greatest(1 - h / ln(16), 0)), 6) AS weight_mean FROM obsn JOIN su USING (gene_id, k, n)")
def _(s, d):
    return rounded(K.loss_weight_mean(_signals(s, d), 16), "weight_mean")


@query("support_size", _SU + "SELECT max(m)::BIGINT AS points FROM (SELECT gene_id, count(*) AS m FROM grid GROUP BY gene_id)")
def _(s, d):
    return K.support_size(_signals(s, d))


@query("extract_signals", _SU + "SELECT cell_id, gene_id, round(sup * s, 6) AS signal, round(h, 6) AS posterior_entropy FROM obsn JOIN su USING (gene_id, k, n), mean")
def _(s, d):
    return rounded(_signals(s, d).select("cell_id", "gene_id", "signal", "posterior_entropy"), "signal", "posterior_entropy")


@query("signal_moments", _SU + "SELECT gene_id, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(var_pop(v) / greatest(avg(v), 1e-12), 6) AS dispersion FROM (SELECT gene_id, ln(1 + sup * s) AS v FROM obsn JOIN su USING (gene_id, k, n), mean UNION ALL SELECT gene_id, 0 FROM dense JOIN ref USING (cell_id) WHERE n = 0) GROUP BY gene_id")
def _(s, d):
    layer = _signals(s, d).select("cell_id", "gene_id", T.log_signal(F.col("signal")).alias("value"))
    return rounded(T.moments(D.retail(s, d), layer), "mean", "variance", "dispersion")


@query("posterior_channels", _SU + "SELECT gene_id, k, n::BIGINT AS n_ref, round(sup, 9) AS map_support, round(sup * s, 6) AS map_scaled_support, NULL::DOUBLE AS map_rate, round(sc, 6) AS scaled_sum FROM su JOIN (SELECT gene_id, sum(p * s) AS sc FROM grid, mean GROUP BY gene_id) USING (gene_id), mean")
def _(s, d):
    out = M.infer(Q._rows(s, d), Q._priors(s, d), Q._CONFIG, channels=("map_scaled_support", "map_rate", "scaled_support"))
    return out.select("gene_id", "k", "n_ref", F.round("map_support", 9).alias("map_support"), r6("map_scaled_support").alias("map_scaled_support"), "map_rate", r6(X.total(F.col("scaled_support"))).alias("scaled_sum"))


@query("distribution_rows", RETAIL + "z AS (SELECT 1) SELECT label, gene_id, count(*)::BIGINT AS n, round(avg(k), 6) AS mean, quantile_cont(k::DOUBLE, 0.5) AS median, round(quantile_cont(k::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(k::DOUBLE, 0.9), 6) AS p90, min(k)::DOUBLE AS min, max(k)::DOUBLE AS max FROM dense WHERE gene_id LIKE 'Brand#1%' GROUP BY ALL")
def _(s, d):
    rows = D.retail(s, d).dense().filter(F.col("gene_id").startswith("Brand#1"))
    return rounded(C.distribution_rows(rows, ["label", "gene_id"]), "mean", "p10", "p90")


@query("gene_raw", RETAIL + "z AS (SELECT 1) SELECT cell_id, k, round(k / n * (SELECT avg(n) FROM ref), 6) AS signal FROM dense JOIN ref USING (cell_id) WHERE gene_id = 'Brand#11' AND n > 0")
def _(s, d):
    return rounded(facades.gene_analysis(D.retail(s, d), "Brand#11", "raw").select("cell_id", "k", "signal"), "signal")


@query("gene_checkpoint", _SU + "SELECT cell_id, k, round(sup * s, 6) AS signal, round(h, 6) AS posterior_entropy FROM obsn JOIN su USING (gene_id, k, n), mean WHERE gene_id = 'Brand#11'")
def _(s, d):
    out = facades.gene_analysis(D.retail(s, d), "Brand#11", "checkpoint", Q._CONFIG, Q._priors(s, d))
    return rounded(out.select("cell_id", "k", "signal", "posterior_entropy"), "signal", "posterior_entropy")


@query("gene_fit")
def _(s, d):
    out = facades.gene_analysis(D.retail(s, d), "Brand#11", "fit", M.FitConfig(points=32, max_iterations=20))
    return rounded(out.select("cell_id", "k", "signal", "posterior_entropy"), "signal", "posterior_entropy")


@query(
    "extract_kbulk",
    Q._BULK_SQL + "SELECT label, sample_id::INT AS sample_id, gene_id, k_sum, round(signal, 6) AS signal, round(h, 6) AS posterior_entropy FROM ks",
)
def _(s, d):
    out = facades.extract_kbulk(D.retail(s, d), Q._priors(s, d), Q._CONFIG, 3, 5, 11)
    return rounded(out.select("label", "sample_id", "gene_id", "k_sum", "signal", "posterior_entropy"), "signal", "posterior_entropy")


# Rankings


@query("rank_dispersion", Q._NORM + "g AS (SELECT gene_id, var_pop(v) / greatest(avg(v), 1e-12) AS score FROM nv GROUP BY gene_id) SELECT gene_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, gene_id)::INT AS rank FROM g QUALIFY rank <= 10")
def _(s, d):
    return rounded(facades.rank_genes(D.retail(s, d), "dispersion", top=10), "score")


_CR = """n4 AS (SELECT d.cell_id, d.gene_id, exp(ln(1 + d.k / greatest(n, 1.0::DOUBLE) * 1e4)) - 1 AS v FROM dense d JOIN ref USING (cell_id)),
    g AS (SELECT gene_id, greatest(avg(v), 1e-12) AS mean, var_samp(v) / greatest(avg(v), 1e-12) AS d FROM n4 GROUP BY gene_id),
    cu AS (SELECT quantile_cont(mean, [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]) AS c FROM g),
    b AS (SELECT gene_id, d, len(list_filter(c, lambda x: x < mean)) AS bin FROM g, cu), md AS (SELECT *, median(d) OVER (PARTITION BY bin) AS m FROM b),
    ma AS (SELECT *, median(abs(d - m)) OVER (PARTITION BY bin) / 0.6744897501960817::DOUBLE AS mad FROM md)"""


@query("hvg_cell_ranger", RETAIL + _CR + " SELECT gene_id, round(coalesce((d - m) / nullif(mad, 0), 0), 4) AS score FROM ma")
def _(s, d):
    return T.hvg(D.retail(s, d), "cell_ranger").select("gene_id", F.round("score", 4).alias("score"))


@query("hvg_seurat_v3")
def _(s, d):
    return T.hvg(D.retail(s, d), "seurat_v3").select("gene_id", F.round("score", 4).alias("score"))


@query(
    "signal_hvg",
    _SU.rstrip() + ", sv AS (SELECT gene_id, sup * s AS v FROM obsn JOIN su USING (gene_id, k, n), mean UNION ALL SELECT gene_id, 0 FROM dense JOIN ref USING (cell_id) WHERE n = 0), "
    + Q.seurat_sql("sv") + " SELECT gene_id, round(score, 4) AS score FROM hv",
)
def _(s, d):
    out = facades.rank_genes(D.retail(s, d), "signal-hvg", signals=_signals(s, d))
    return out.select("gene_id", F.round("score", 4).alias("score"))


# Checkpoints and curves


@query(
    "warm_start",
    Q._EM1
    + """, b AS (SELECT gene_id, (row_number() OVER (ORDER BY gene_id) - 1) // 5 AS b FROM (SELECT DISTINCT gene_id FROM p1)),
    ok AS (SELECT b, bool_and(gene_id <> 'Brand#13') AS ok FROM b GROUP BY b)
    SELECT gene_id, j::INT AS j, round(CASE WHEN ok THEN q ELSE 1.0::DOUBLE / 16 END, 6) AS prob FROM p1 JOIN b USING (gene_id) JOIN ok USING (b)""",
)
def _(s, d):
    from pyspark.sql.window import Window

    new = Q._priors(s, d)
    old = Q._step(s, d).filter("gene_id <> 'Brand#13'")
    batches = new.select("scope", "gene_id").withColumn("b", F.floor((F.row_number().over(Window.partitionBy("scope").orderBy("gene_id")) - 1) / 5))
    return Q._exploded(P.warm_start(new, old, batches))


@query("checkpoint_assemble", RETAIL + "z AS (SELECT 1) SELECT 'global' AS scope, count(*)::BIGINT AS genes FROM var UNION ALL SELECT 'label:' || label, (SELECT count(*) FROM var) FROM (SELECT DISTINCT label FROM obs)")
def _(s, d):
    both = P.assembled(Q._priors(s, d), Q._label_priors(s, d))
    P.check_same_genes(both)
    return C.inspect(both).select("scope", "genes")


@query("scale_metadata", RETAIL + "z AS (SELECT 1) SELECT 'label:' || label AS scope, round(avg(n), 6) AS scale, (SELECT count(*) FROM var)::BIGINT AS genes FROM ref WHERE n > 0 GROUP BY label")
def _(s, d):
    return rounded(P.scale_metadata(Q._label_priors(s, d)), "scale")


@query("label_priors", "SELECT DISTINCT c_mktsegment AS label FROM customer")
def _(s, d):
    return P.labels(Q._label_priors(s, d))


@query("prior_reorder", Q._EM1 + ", w(pos, gene_id) AS (VALUES (0::BIGINT, 'Brand#22'), (1, 'Brand#11')) SELECT pos, gene_id, round(-sum(q * ln(greatest(q, 1e-12))), 6) AS entropy FROM w JOIN p1 USING (gene_id) GROUP BY ALL")
def _(s, d):
    wanted = s.createDataFrame([(0, "Brand#22"), (1, "Brand#11")], "pos long, gene_id string")
    return P.select_genes(P.get_prior(Q._step(s, d)), wanted).select("pos", "gene_id", r6(X.entropy(F.col("prob"))).alias("entropy"))


@query("checkpoint_merge_partial", Q._EM1 + " SELECT gene_id, round(-sum(q * ln(greatest(q, 1e-12))), 6) AS entropy FROM p1 WHERE gene_id IN ('Brand#11', 'Brand#22') GROUP BY gene_id")
def _(s, d):
    p = Q._step(s, d)
    meta = {"layer": "counts", "fit_config": {"points": 16}}
    shards = [(p.filter(F.crc32("gene_id") % 2 == i), meta) for i in (0, 1)]
    wanted = s.createDataFrame([("Brand#22",), ("Brand#11",), ("none",)], "gene_id string")
    return P.merged(shards, wanted, allow_partial=True).select("gene_id", r6(X.entropy(F.col("prob"))).alias("entropy"))


@query("reference_overlap", RETAIL + "z AS (SELECT 1) SELECT count(*)::BIGINT AS genes FROM var WHERE gene_id LIKE 'Brand#1%'")
def _(s, d):
    m = D.retail(s, d)
    return P.check_overlap(m.var.filter("gene_id LIKE 'Brand#1%'"), m.var)


@query(
    "curve_rows",
    Q._EM1
    + """, w(gene_pos, gene_id) AS (VALUES (0::BIGINT, 'Brand#22'), (1, 'Brand#11')), ck(checkpoint) AS (VALUES ('a'), ('b'))
    SELECT checkpoint || '/global' AS source, checkpoint, 'global' AS scope, NULL::VARCHAR AS label, gene_id, gene_pos, j::INT AS j, round(p, 9) AS support, round(p * s, 6) AS scaled_support, round(p * s, 6) AS x,
    round(q, 6) AS prob, round(sum(q) OVER (PARTITION BY checkpoint, gene_id ORDER BY j), 6) AS cdf, round(s, 6) AS scale FROM p1 JOIN w USING (gene_id), ck, mean""",
)
def _(s, d):
    p, genes = Q._step(s, d), s.createDataFrame([(0, "Brand#22"), (1, "Brand#11")], "pos long, gene_id string")
    out = C.curve_rows({"a": p, "b": p}, genes)
    return rounded(out.withColumn("support", F.round("support", 9)), "scaled_support", "x", "prob", "cdf", "scale")


@query("grid_curves", RETAIL + "z AS (SELECT 1) SELECT left(label, 1) AS batch, label AS perturbation, 'Brand#11' AS gene_id, 16 AS points FROM (SELECT DISTINCT label FROM obs)")
def _(s, d):
    p = Q._label_priors(s, d)
    grid = P.labels(p).select("label", F.substring("label", 1, 1).alias("batch"), F.col("label").alias("perturbation"))
    out = C.grid_curves(p, s.createDataFrame([("Brand#11",)], "gene_id string"), D.label_grid(grid))
    return out.select("batch", "perturbation", "gene_id", F.size("prob").alias("points"))


@query("ranked_curves", Q._EM1 + ", h AS (SELECT gene_id, -sum(q * ln(greatest(q, 1e-12))) AS h FROM p1 GROUP BY 1 ORDER BY h DESC, gene_id LIMIT 3) SELECT gene_id, j::INT AS j, round(p * s, 6) AS x, round(q, 6) AS prob FROM p1 JOIN h USING (gene_id), mean")
def _(s, d):
    return rounded(facades.ranked_curves(Q._step(s, d), 3).select("gene_id", "j", "x", "prob"), "x", "prob")


@query("merged_support_jsd", Q._EM1 + ", u AS (SELECT gene_id, q, 1.0::DOUBLE / 16 AS v FROM p1) SELECT gene_id, round(sum(0.5::DOUBLE * q * ln((q + 1e-12) / ((q + v) / 2 + 1e-12)) + 0.5::DOUBLE * v * ln((v + 1e-12) / ((q + v) / 2 + 1e-12))), 6) AS jsd FROM u GROUP BY gene_id")
def _(s, d):
    return rounded(K.merged_jsd(Q._step(s, d), Q._priors(s, d)), "jsd")


@query("fit_both_modes")
def _(s, d):
    out = facades.fit_checkpoint(D.retail(s, d), "both", M.FitConfig(points=16, max_iterations=3), genes=s.createDataFrame([(0, "Brand#11"), (1, "Brand#22")], "pos long, gene_id string"))
    return out.select("scope", "gene_id", r6(X.entropy(F.col("prob"))).alias("entropy"))


@query("fit_sharded")
def _(s, d):
    m, config = D.retail(s, d), M.FitConfig(points=16, max_iterations=3)
    parts = [(facades.fit_checkpoint(m, "global", config, shard=(i, 2)), {"fit_mode": "global"}) for i in (0, 1)]
    return P.merged(parts).select("gene_id", r6(X.entropy(F.col("prob"))).alias("entropy"))


@query("fit_report")
def _(s, d):
    engine = M.PriorEngine(D.retail(s, d), M.FitConfig(points=16, max_iterations=5))
    return rounded(engine.fit(D.retail(s, d).var.filter("gene_id LIKE 'Brand#1%'")).select("scope", "genes", "iterations", "rounds", "objective"), "objective")
