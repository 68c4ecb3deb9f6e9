"""Matrices in text files whose rows and columns are told by their positions, and their barcode, gene and index files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.order import cut, numbered, numbered_lines
from tallyspark.functions.ship import ship
from tallyspark.functions.text import cleaned
from tallyspark.sources.matrices import Matrix


def _fields(line: Column, delimiter: str) -> Column:
    return F.split(line, "\\Q" + delimiter + "\\E" if delimiter.strip() else delimiter, -1)


def _held(lines: DataFrame) -> DataFrame:
    """Lines that are not blank; their numbers keep their order but leave gaps."""
    return lines.filter(F.trim("value") != "")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """pos (from 0) and fields of the rows of a tab-separated file without a header; blank lines raise no number."""
    rows = _held(numbered_lines(spark, path)).select(F.col("pos").alias("line"), F.split("value", "\t").alias("fields"))
    return numbered(rows, [], ["line"]).select("pos", "fields")


def read_matrix_bundle(spark: SparkSession, matrix: str, barcodes: str, genes: str) -> Matrix:
    """A genes x barcodes coordinate file with its barcodes and genes (id and name), as cells x genes.

    Entries count from 1; equal places are summed; the size line must agree with the entries and with both files. A gene
    id that occurs twice is told by its place: id, then id-1 and so on.
    """
    cells = read_names(spark, barcodes).select("pos", F.trim(F.col("fields")[0]).alias("cell_id"))
    named = read_names(spark, genes).select("pos", F.trim(F.col("fields")[0]).alias("id"), F.trim(F.get("fields", F.lit(1))).alias("gene_name"))
    same = numbered(named, ["id"], ["pos"], "nth")
    var = cut(same.select("pos", F.when(F.col("nth") == 0, F.col("id")).otherwise(F.concat_ws("-", "id", F.col("nth").cast("string"))).alias("gene_id"), "gene_name"))
    rows = _held(numbered_lines(spark, matrix)).filter(~F.startswith(F.trim("value"), F.lit("%")))
    first = rows.agg(F.min_by("value", "pos").alias("size"), F.min("pos").alias("first")).first()
    if first["size"] is None:
        raise ValueError(f"{matrix} has no size line")
    n_genes, n_cells, n_entries = (int(x) for x in first["size"].split())
    part = F.split(F.trim("value"), r"\s+")
    entries = rows.filter(F.col("pos") > first["first"]).select((part[0].cast("long") - 1).alias("g"), (part[1].cast("long") - 1).alias("c"), part[2].cast("double").alias("v"))
    told = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.least("g", "c")), F.lit(0)).alias("low"), F.coalesce(F.max("g"), F.lit(-1)).alias("g"), F.coalesce(F.max("c"), F.lit(-1)).alias("c")).first()
    sizes = (var.count(), cells.count())
    if told["n"] != n_entries or told["low"] < 0 or told["g"] >= n_genes or told["c"] >= n_cells or sizes != (n_genes, n_cells):
        raise ValueError(f"{matrix} says {n_genes} x {n_cells} with {n_entries} entries; found {sizes[0]} genes, {sizes[1]} barcodes, {told['n']} entries")
    met = entries.join(var.select(F.col("pos").alias("g"), "gene_id"), "g").join(cells.select(F.col("pos").alias("c"), "cell_id"), "c")
    counts = met.groupBy("cell_id", "gene_id").agg(F.sum("v").alias("value")).filter("value <> 0")
    return Matrix(counts, cells.withColumn("label", F.lit(None).cast("string")).select("cell_id", "label", "pos"), var)


def write_matrix_bundle(m: Matrix, path: str) -> None:
    """The matrix as a coordinate file (folder matrix), barcodes and genes, in the order of their names."""
    cells = numbered(m.obs.select(F.col("cell_id").cast("string").alias("cell_id")), [], ["cell_id"])
    genes = numbered(m.var.select("gene_id"), [], ["gene_id"])
    cells, genes = cut(cells), cut(genes)
    counts = m.counts.filter("value <> 0").withColumn("cell_id", F.col("cell_id").cast("string"))
    entries = counts.join(genes.withColumnRenamed("pos", "g"), "gene_id").join(cells.withColumnRenamed("pos", "c"), "cell_id")
    lines = entries.select((F.col("g") + 1).alias("o"), (F.col("c") + 1).alias("p"), F.concat_ws(" ", (F.col("g") + 1).cast("string"), (F.col("c") + 1).cast("string"), F.col("value").cast("string")).alias("value"))
    lines = cut(lines)
    head = m.var.sparkSession.createDataFrame([(-1, 0, "%%MatrixMarket matrix coordinate real general"), (0, 0, f"{genes.count()} {cells.count()} {lines.count()}")], "o long, p long, value string")
    head.unionByName(lines).repartitionByRange("o", "p").sortWithinPartitions("o", "p").select("value").write.mode("overwrite").text(f"{path}/matrix")
    for name, table, column in (("barcodes", cells, "cell_id"), ("genes", genes, "gene_id")):
        rows = table.select("pos", (F.col(column) if name == "barcodes" else F.concat_ws("\t", column, column)).alias("value"))
        rows.repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.mode("overwrite").text(f"{path}/{name}")


def write_dense(m: Matrix, path: str, delimiter: str = ",", genes_first: bool = False, chunk: int = 1 << 14) -> None:
    """The matrix as a text table with a cell a line and a gene a column, or the other way round, in the order of names.

    Lines are made in chunks of columns, each from its non-zero values in their order with as many zeros between them as
    there are places, so the work grows with the values and the text, whatever the width.
    """
    line, column = ("gene_id", "cell_id") if genes_first else ("cell_id", "gene_id")
    obs, var = m.obs.select(F.col("cell_id").cast("string").alias("cell_id")), m.var.select("gene_id")
    lines, columns = (var, obs) if genes_first else (obs, var)
    places = cut(numbered(columns, [], [column]))
    width = places.count()
    of = F.floor(F.col("pos") / chunk).alias("c")

    def joined(parts: DataFrame, by: list[str]) -> DataFrame:
        """Texts of the chunks (c, text) of each of `by`, in their order."""
        return parts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]), delimiter).alias("text"))

    names = places.groupBy(of).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", column))), lambda x: x[column]), delimiter).alias("text"))
    head = joined(names, []).select(F.lit("").alias("o"), F.concat_ws(delimiter, F.lit(line), F.when(F.lit(width > 0), F.col("text"))).alias("value"))
    counts = m.counts.filter("value <> 0").withColumn("cell_id", F.col("cell_id").cast("string"))
    held = counts.join(places, column).groupBy(F.col(line).alias("o_"), of).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("string").alias("v")))).alias("x"))
    begin, end = F.col("c") * chunk, F.least((F.col("c") + 1) * chunk, F.lit(width))
    zeros = lambda n: F.repeat(F.lit("0" + delimiter), n.cast("int"))
    before = lambda i: F.coalesce(F.get("x", i - 1)["pos"] + 1, F.col("begin"))
    values = F.array_join(F.transform("x", lambda x, i: F.concat(zeros(x["pos"] - before(i)), x["v"])), delimiter)
    rest = F.col("end") - F.element_at("x", -1)["pos"] - 1
    text = F.when(F.col("x").isNull(), F.concat(zeros(F.col("end") - F.col("begin") - 1), F.lit("0"))).otherwise(F.concat(values, F.repeat(F.lit(delimiter + "0"), rest.cast("int"))))
    chunks = m.var.sparkSession.range(max(1, -(-width // chunk))).select(F.col("id").alias("c"))
    grid = lines.select(F.col(line).alias("o")).crossJoin(F.broadcast(chunks)).join(held.withColumnRenamed("c", "c_"), (F.col("o") == F.col("o_")) & (F.col("c") == F.col("c_")), "left")
    parts = grid.select("o", "c", "x", begin.alias("begin"), end.alias("end")).select("o", "c", text.alias("text"))
    rows = joined(parts, ["o"]).select("o", F.concat_ws(delimiter, "o", F.when(F.lit(width > 0), F.col("text"))).alias("value"))
    sorted_ = head.withColumn("p", F.lit(0)).unionByName(rows.withColumn("p", F.lit(1))).repartitionByRange("p", "o").sortWithinPartitions("p", "o")
    sorted_.select("value").write.mode("overwrite").text(path)


def _cut_lines(delimiter: str, fields: int):
    """Lines (pos, value) as rows of at most so many fields: pos, size (fields of the line), name (its first field), at
    (from 0, of the first field of this row behind the name) and piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = delimiter.encode()
        for batch in batches:
            rows: list[tuple] = []
            for pos, value in zip(batch.column("pos").to_pylist(), batch.column("value").cast(pa.binary()), strict=True):
                line = value.as_py().removesuffix(b"\r")
                # Where fields end, without the fields themselves, which take far more room than their text.
                ends = np.flatnonzero(np.frombuffer(line, np.uint8) == d[0]) if len(d) == 1 else np.array([m.start() for m in re.finditer(re.escape(d), line)], np.int64)
                name = line if not len(ends) else line[: ends[0]]
                for i in range(0, max(len(ends), 1), fields):
                    begin, end = (int(ends[i]) + len(d), int(ends[i + fields]) if i + fields < len(ends) else len(line)) if len(ends) else (0, 0)
                    rows.append((pos, len(ends) + 1, name, i, line[begin:end] if len(ends) else None))
                    if len(rows) >= 1024:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return pieces


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([c.cast(pa.string()) if c.type == pa.binary() else c for c in columns], ["pos", "size", "name", "at", "piece"])


def _wide(spark: SparkSession, path: str, delimiter: str, fields: int = 1 << 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(line, name) of the lines of a wide table with a header and a name in front of each line, (name, at, value) of all
    its non-zero values, and (at, column) of its header. Lines are not given columns of their own, so tables may be of any
    width; they are cut into pieces of so many fields, and no line's fields are held at once."""
    ship(spark)
    lines = _held(numbered_lines(spark, path))
    first = lines.agg(F.min("pos").alias("p")).first()["p"]
    if first is None:
        raise ValueError(f"{path} is empty")
    cut_up = lambda some: some.select("pos", "value").mapInArrow(_cut_lines(delimiter, fields), "pos long, size long, name string, at long, piece string")
    top = cut_up(lines.filter(F.col("pos") == first))
    width = top.agg(F.max("size").alias("n")).first()["n"]
    if width < 2:
        raise ValueError(f"the header of {path} is malformed")
    header = top.select("at", F.posexplode(_fields(F.col("piece"), delimiter)).alias("i", "column"))
    header = header.select((F.col("at") + F.col("i")).cast("int").alias("at"), cleaned(F.col("column")).alias("column"))
    pieces = cut_up(lines.filter(F.col("pos") > first))
    if bad := pieces.filter(F.col("size") != width).select("pos", "size").limit(1).collect():
        raise ValueError(f"line {bad[0]['pos']} of {path} has {bad[0]['size']} fields, not {width}")
    values = F.transform(_fields(F.col("piece"), delimiter), lambda x, i: F.struct(i.alias("i"), F.nullif(F.trim(x), F.lit("")).cast("double").alias("value")))
    some = pieces.select("name", "at", F.explode(F.filter(values, lambda x: x["value"] != 0)).alias("x"))
    counts = some.select(cleaned(F.col("name")).alias("name"), (F.col("at") + F.col("x.i")).cast("int").alias("at"), F.col("x.value").alias("value"))
    return pieces.filter("at = 0").select(F.col("pos").alias("line"), cleaned(F.col("name")).alias("name")), counts, header


def read_genes_by_cells(spark: SparkSession, path: str, delimiter: str = "\t") -> Matrix:
    """A dense text table with a gene a line and a cell a column. Blank lines are no genes; empty fields are zero."""
    rows, values, header = _wide(spark, path, delimiter)
    counts = values.join(header, "at").select(F.col("column").alias("cell_id"), F.col("name").alias("gene_id"), "value")
    obs = header.select(F.col("column").alias("cell_id"), F.lit(None).cast("string").alias("label"), F.col("at").cast("long").alias("pos"))
    return Matrix(counts, obs, numbered(rows.select("line", F.col("name").alias("gene_id")), [], ["line"]).select("gene_id", "pos"))


def read_cells_by_genes(spark: SparkSession, path: str, delimiter: str = ",") -> Matrix:
    """A dense text table with a cell a line and a gene a column."""
    rows, values, header = _wide(spark, path, delimiter)
    counts = values.join(header, "at").select(F.col("name").alias("cell_id"), F.col("column").alias("gene_id"), "value")
    obs = numbered(rows.select("line", F.col("name").alias("cell_id")), [], ["line"]).select("cell_id", F.lit(None).cast("string").alias("label"), "pos")
    return Matrix(counts, obs, header.select(F.col("column").alias("gene_id"), F.col("at").cast("long").alias("pos")))


def read_species(spark: SparkSession, expression: str, cell_index: str, gene_index: str, species: str, chromosomes: list[str] | None = None) -> Matrix:
    """The cells and genes of one species in a dense expression table of several, all by position.

    cell_index: cell_index, identity and others, a row for each line of expression; gene_index: gene_index (its column in
    expression), chr, Geneid, Name. Kept are cells of the species and genes of the chromosomes (the species' name if none
    are given), whose names must stand in that place of the header. obs keeps the index's columns.
    """
    cells = spark.read.option("header", True).csv(cell_index).withColumn("row", F.col("cell_index").cast("long"))
    cells = cells.filter(F.col("identity") == species)
    genes = spark.read.option("header", True).csv(gene_index).filter(F.col("chr").isin(chromosomes or [species]))
    genes = genes.select(F.col("gene_index").cast("long").alias("at"), F.col("chr").alias("genome"), F.col("Geneid").alias("gene_id"), F.col("Name").alias("gene_name"))
    for rows, what in ((cells, "cells"), (genes, "genes")):
        if not rows.limit(1).count():
            raise ValueError(f"no {what} of {species}")
    lines = _held(numbered_lines(spark, expression))
    first = lines.agg(F.min("pos").alias("p")).first()["p"]
    fields = lines.select("pos", F.split("value", ",").alias("f"))
    header = fields.filter(F.col("pos") == first).select(F.posexplode("f").alias("at", "column"))
    if genes.join(header, "at", "left").filter("NOT (trim(column) <=> gene_name)").limit(1).count():
        raise ValueError(f"genes of {species} are not where the header of {expression} has them")
    body = numbered(fields.filter(F.col("pos") > first), [], ["pos"], "row").select("row", "f")
    kept = body.join(cells.select("row"), "row", "left_semi")
    values = F.filter(F.transform("f", lambda x, i: F.struct(i.alias("at"), F.trim(x).cast("double").alias("value"))), lambda x: x["value"] != 0)
    counts = kept.select("row", F.explode(values).alias("x")).select("row", "x.at", "x.value").join(genes.select("at", "gene_id"), "at")
    obs = cells.select(F.col("row").cast("string").alias("cell_id"), F.col("identity").alias("label"), F.lit(species).alias("species"), *[c for c in cells.columns if c not in ("row", "identity")])
    return Matrix(counts.select(F.col("row").cast("string").alias("cell_id"), "gene_id", "value"), obs, genes.select("gene_id", "gene_name", "genome", F.col("at").alias("pos")))
