"""Phases of a cycle by correlation with one-hot templates, and the order of cells within it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.sources.matrices import Matrix


def phases(m: Matrix, genes: list[str]) -> DataFrame:
    """cell_id, phase (index of the best template, the first of equals), best and progress: the correlation with the
    template before minus that with the one after. genes holds one gene for each phase, in order.

    The correlation of values with a one-hot template of length n is (v_i - mean) / (sd * sqrt(n - 1)), 0 if constant.
    """
    n = len(genes)
    place = F.array_position(F.array(*[F.lit(g) for g in genes]), F.col("gene_id")).cast("int")
    rows = m.counts.filter(F.col("gene_id").isin(genes)).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct(place, "value"))).alias("v"))
    rows = m.obs.select("cell_id").join(rows, "cell_id", "left")
    empty = F.create_map().cast("map<int,bigint>")
    v = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at(F.coalesce("v", empty), i), F.lit(0)).cast("double"))
    rows = rows.select("cell_id", v.alias("v"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("mean", add(F.col("v")) / n)
    rows = rows.withColumn("sd", F.sqrt(add(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / n))
    r = F.transform("v", lambda x: F.round(F.when(F.col("sd") > 1e-12, (x - F.col("mean")) / (F.col("sd") * F.sqrt(F.lit(n - 1.0)))).otherwise(0.0), 9))
    rows = rows.select("cell_id", r.alias("r")).withColumn("phase", (F.array_position("r", F.array_max("r")) - 1).cast("int"))
    before, after = F.get("r", (F.col("phase") + n - 1) % n), F.get("r", (F.col("phase") + 1) % n)
    return rows.select("cell_id", "phase", F.array_max("r").alias("best"), F.round(before - after, 6).alias("progress"))


def cycle_order(cells: DataFrame) -> DataFrame:
    """cells with place: from 0 to 1 within a phase by falling progress; null for a phase of one cell."""
    w = Window.partitionBy("phase")
    nth = F.row_number().over(w.orderBy(F.desc("progress"), "cell_id")) - 1
    return cells.withColumn("place", nth / F.nullif(F.count(F.lit(1)).over(w) - 1, F.lit(0)))
