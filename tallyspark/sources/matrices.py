"""Count matrices as tables: counts(cell_id, gene_id, value > 0), obs(cell_id, label), var(gene_id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.context import SHARED


@dataclass(frozen=True)
class Matrix:
    """A sparse cells x genes matrix. Zeros are implicit; cells and genes without counts stand in obs and var."""

    counts: DataFrame
    obs: DataFrame
    var: DataFrame

    def dense(self) -> DataFrame:
        """cell_id, label, gene_id, value with zeros: as many rows as cells times genes, made where a result needs them."""
        grid = self.obs.select("cell_id", "label").crossJoin(F.broadcast(self.var.select("gene_id")))
        return grid.join(self.counts, ["cell_id", "gene_id"], "left").withColumn("value", F.coalesce("value", F.lit(0)))

    def layer(self, counts: DataFrame) -> Matrix:
        return Matrix(counts, self.obs, self.var)

    def with_genes(self, genes: DataFrame) -> Matrix:
        return Matrix(self.counts.join(genes.select("gene_id"), "gene_id", "left_semi"), self.obs, genes.select("gene_id"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files for one task of a wide step, some half a million order lines.
TASK_BYTES = 8 << 20


def expected_bytes(df: DataFrame) -> int:
    """Bytes that Spark expects of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcasts(df: DataFrame) -> bool:
    """Whether Spark takes a table as small enough to be broadcast in a join."""
    return expected_bytes(df) <= int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def spread(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as source's files ask for (TASK_BYTES each), so that what a task holds does not
    grow with the input; as it is where the session's shuffles already have as many partitions."""
    n = -(-expected_bytes(source) // TASK_BYTES)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *keys)


def retail(spark: SparkSession, sf_dir: str) -> Matrix:
    """Customers x brands; values count order lines; the label is the market segment."""
    whole = read(spark, sf_dir, "lineitem")
    lines = whole.select("l_orderkey", "l_partkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    bought = spread(lines, whole, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey")
    wide = bought if broadcasts(parts) else spread(bought, whole, "l_partkey")
    named = wide.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "p_brand")
    made = (
        spread(named, whole, "o_custkey")
        .groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene_id"))
        .agg(F.count(F.lit(1)).alias("value"))
    )
    counts = SHARED.held(spark, ("retail", sf_dir), lambda: made)
    obs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("label"))
    return Matrix(counts, obs, parts.select(F.col("p_brand").alias("gene_id")).distinct())


def quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retail matrix's second layer: summed quantities."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene_id"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def events(spark: SparkSession, sf_dir: str) -> Matrix:
    """Users x event types; values count events."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_id"))
    obs = rows.select("cell_id").distinct().withColumn("label", (F.col("cell_id") % 3).cast("string"))
    return Matrix(rows.groupBy("cell_id", "gene_id").agg(F.count(F.lit(1)).alias("value")), obs, rows.select("gene_id").distinct())


def vectors(spark: SparkSession, sf_dir: str) -> Matrix:
    """Vectors x components; values may be negative, so only for statistics."""
    rows = read(spark, sf_dir, "embeddings")
    counts = rows.select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("i", "v")).select(
        "cell_id", F.format_string("d%02d", "i").alias("gene_id"), F.col("v").cast("double").alias("value")
    )
    obs = rows.select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("label"))
    return Matrix(counts, obs, counts.select("gene_id").distinct())


def gene_slice(m: Matrix, gene: str) -> DataFrame:
    """cell_id, label, value of one gene in all cells; raises on a gene that the matrix lacks."""
    if not m.var.filter(F.col("gene_id") == gene).limit(1).count():
        raise KeyError(gene)
    hits = m.counts.filter(F.col("gene_id") == gene).select("cell_id", "value")
    return m.obs.select("cell_id", "label").join(hits, "cell_id", "left").withColumn("value", F.coalesce("value", F.lit(0)))


def reindexed(table: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The table's rows for names (pos and key), one for each in their order's pos; null where the table has none."""
    return names.select("pos", key).join(table, key, "left")


def read_annotations(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """name, gene_id, source and text (see annotation_text) of annotation files: CSV with a header, a column gene, and what
    says which curve a row is about: source, or label (blank or NA: global), behind a checkpoint if there is one. Of rows
    for one gene and source the last counts. Raises on blank names, genes, sources and checkpoints, and on files without a
    gene or a value column."""
    out = None
    for name, path in tables.items():
        if not name.strip():
            raise ValueError(f"annotation table name cannot be blank: {path}")
        table = spark.read.option("header", True).option("inferSchema", True).csv(path)
        values = [c for c in table.columns if c not in ("gene", "label", "source", "checkpoint")]
        if "gene" not in table.columns or not values:
            raise ValueError(f"{path} needs a column gene and columns of values")
        cell = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
        needed = ["gene"] + [c for c in ("source",) if c in table.columns] + [c for c in ("checkpoint",) if c in table.columns and "source" not in table.columns]
        for c in needed:
            if table.filter(cell(c) == "").limit(1).count():
                raise ValueError(f"{path} has a blank {c}")
        scope = F.lit("global") if "label" not in table.columns else F.when(cell("label").isin("", "NA", "NaN", "nan"), F.lit("global")).otherwise(F.concat(F.lit("label:"), cell("label")))
        if "source" in table.columns:
            source = cell("source")
        else:
            source = F.concat(cell("checkpoint"), F.lit("/"), scope) if "checkpoint" in table.columns else scope
        rows = table.select(F.lit(name.strip()).alias("name"), cell("gene").alias("gene_id"), source.alias("source"), annotation_text(table, ["gene"], values).alias("text"), F.monotonically_increasing_id().alias("at"))
        one = rows.groupBy("name", "gene_id", "source").agg(F.max_by("text", "at").alias("text"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("at least one annotation file is needed")
    return out


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, value of a text file of names: trimmed, blanks dropped, the first of equal names kept, in their order."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("pos"))
    return ordered_unique(lines.filter("value <> ''"))


def ordered_unique(names: DataFrame) -> DataFrame:
    return names.groupBy("value").agg(F.min("pos").alias("pos")).select("pos", "value")


def write_list(names: DataFrame, path: str) -> None:
    ordered_unique(names).orderBy("pos").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """cell (from 0), gene (from 0), value of a genes x cells coordinate file: comments and the size line are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    rows = lines.filter("line <> '' AND NOT startswith(line, '%')")
    size = rows.agg(F.min("at").alias("first"))
    cells = F.split("line", r"\s+")
    return rows.join(F.broadcast(size), F.col("at") > F.col("first")).select(
        (cells[1].cast("long") - 1).alias("cell"), (cells[0].cast("long") - 1).alias("gene"), cells[2].cast("double").alias("value")
    )


def melt(wide: DataFrame, by: str, name: str = "gene_id") -> DataFrame:
    """A dense table with a column for each gene as by, name, value, without zeros."""
    rest = [c for c in wide.columns if c != by]
    typed = wide.select(by, *[F.col(c).cast("double").alias(c) for c in rest])
    return typed.unpivot([by], rest, name, "value").filter("value <> 0")


def annotation_text(table: DataFrame, keys: list[str], values: list[str]) -> Column:
    """'col=val' pairs of the value columns, floats with two digits, missing ones as NA."""

    def one(c: str) -> Column:
        kind = dict(table.dtypes)[c]
        number = F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c).try_cast("double")))
        text = F.when(~F.isnan(F.col(c)), number) if kind in ("double", "float") else F.col(c).cast("string")
        text = F.when(F.col(c).try_cast("double").isNotNull(), number).otherwise(text) if kind == "string" else text
        return F.concat(F.lit(f"{c}="), F.coalesce(text, F.lit("NA")))

    return F.concat_ws(", ", *[one(c) for c in values])


def label_grid(grid: DataFrame) -> DataFrame:
    """label, batch, perturbation of a grid table; raises on blanks and on pairs that occur twice."""
    for c in ("label", "batch", "perturbation"):
        if grid.filter(F.coalesce(F.trim(c), F.lit("")) == "").limit(1).count():
            raise ValueError(f"blank {c!r} value in the label grid")
    if grid.groupBy("batch", "perturbation").count().filter("count > 1").limit(1).count():
        raise ValueError("a pair of batch and perturbation occurs twice in the label grid")
    return grid.select("label", "batch", "perturbation")
