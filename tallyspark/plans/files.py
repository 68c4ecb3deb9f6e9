"""Registered queries over files that are first derived from the given tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.order import numbered_lines, shared_path
from tallyspark.plans.catalogue import RETAIL, query
from tallyspark.sources import matrices as D
from tallyspark.sources import positional as N

_EVENTS = """WITH cnt AS (SELECT user_id AS cell_id, event_type AS gene_id, count(*)::DOUBLE AS value FROM events GROUP BY ALL) """


@query("matrix_bundle_file", RETAIL + "z AS (SELECT 1) SELECT cell_id::VARCHAR AS cell_id, gene_id, k::DOUBLE AS value FROM cnt")
def _(s, d):
    path = shared_path(s, "bundle")
    N.write_matrix_bundle(D.retail(s, d), path)
    return N.read_matrix_bundle(s, f"{path}/matrix", f"{path}/barcodes", f"{path}/genes").counts.select("cell_id", "gene_id", "value")


@query("matrix_bundle_cells", RETAIL + "z AS (SELECT 1) SELECT cell_id::VARCHAR AS cell_id, row_number() OVER (ORDER BY cell_id::VARCHAR) - 1 AS pos FROM obs")
def _(s, d):
    path = shared_path(s, "bundle")
    N.write_matrix_bundle(D.retail(s, d), path)
    return N.read_matrix_bundle(s, f"{path}/matrix", f"{path}/barcodes", f"{path}/genes").obs.select("cell_id", "pos")


@query("dense_cells_by_genes", _EVENTS + "SELECT cell_id::VARCHAR AS cell_id, gene_id, value FROM cnt")
def _(s, d):
    path = shared_path(s, "dense")
    N.write_dense(D.events(s, d), path)
    return N.read_cells_by_genes(s, path).counts.select("cell_id", "gene_id", "value")


@query("dense_genes_by_cells", RETAIL + "z AS (SELECT 1) SELECT cell_id::VARCHAR AS cell_id, gene_id, k::DOUBLE AS value FROM cnt")
def _(s, d):
    path = shared_path(s, "dense")
    N.write_dense(D.retail(s, d), path, "\t", genes_first=True)
    return N.read_genes_by_cells(s, path).counts.select("cell_id", "gene_id", "value")


@query(
    "species_files",
    RETAIL + "z AS (SELECT 1) SELECT gene_id, sum(k)::DOUBLE AS total, count(*)::BIGINT AS cells FROM cnt JOIN obs USING (cell_id) WHERE label = 'BUILDING' AND gene_id LIKE 'Brand#1%' GROUP BY gene_id",
)
def _(s, d):
    """Lines of the market segment BUILDING and of brands that begin with 1, out of a table of all."""
    m, path = D.retail(s, d), shared_path(s, "species")
    N.write_dense(m, f"{path}/dense")
    body = numbered_lines(s, f"{path}/dense")
    names = body.select("pos", F.split("value", ",").alias("f"))
    body.repartitionByRange("pos").sortWithinPartitions("pos").select(F.expr("substring(value, instr(value, ',') + 1)")).write.text(f"{path}/expression")
    cells = names.filter("pos > 0").select((F.col("pos") - 1).alias("cell_index"), F.col("f")[0].try_cast("long").alias("cell_id"))
    cells.join(m.obs, "cell_id").select("cell_index", F.col("label").alias("identity")).write.option("header", True).csv(f"{path}/cells")
    genes = names.filter("pos = 0").select(F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("gene_index", "Name"))
    genes.select("gene_index", F.substring("Name", 1, 7).alias("chr"), F.col("Name").alias("Geneid"), "Name").write.option("header", True).csv(f"{path}/genes")
    own = N.read_species(s, f"{path}/expression", f"{path}/cells", f"{path}/genes", "BUILDING", ["Brand#1"])
    return own.counts.groupBy("gene_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("cells"))


@query("numbered_names", "SELECT row_number() OVER (ORDER BY c_name) - 1 AS pos, c_name AS value FROM customer")
def _(s, d):
    path = shared_path(s, "names")
    D.read(s, d, "customer").select(F.col("c_name").alias("value")).repartitionByRange(7, "value").sortWithinPartitions("value").write.text(path)
    return numbered_lines(s, path)
