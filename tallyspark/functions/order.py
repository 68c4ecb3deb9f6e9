"""Numbering rows in an order without bringing them, or a group of them, into one task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder. Where spark.checkpoint.dir is unset and all runs on this machine, as in
    tests, the folder is one of the session; on a cluster there is no such folder to fall back on."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="tallyspark-"))
    return f"{context.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back."""
    shared_path(df.sparkSession, "")
    return df.checkpoint()


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "pos") -> DataFrame:
    """df with each row's place (from 0) within its group. Rows are sorted by ranges of group and order; a range's rows
    are numbered by its task, and the ranges' sizes, a row for each range and group, are added up. Rows that are equal in
    all keys of the order get different numbers."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in by], *keys).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col("__p").alias("__q")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*[f"__b{i}" for i in range(len(by))]).orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*[f"__b{i}" for i in range(len(by))], "__q", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*keys))
    same = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    rows = ranged.withColumn("__r", within).join(base, same)
    return rows.select(*df.columns, (F.col("__base") + F.col("__r") - 1).alias(name))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos (from 0) and value of the lines of text files, in the order of their paths. Lines stay where they are read:
    each split's lines are counted, and the splits before it, a row each, say where its numbers begin."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("f", "s").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("f", "s").rowsBetween(Window.unboundedPreceding, -1)  # over splits, not lines
    base = splits.select(F.col("f").alias("f_"), F.col("s").alias("s_"), "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    met = lines.join(base, (F.col("f") == F.col("f_")) & (F.col("s") == F.col("s_")))
    return met.select((F.col("base") + F.col("at") - F.col("first")).alias("pos"), "value")
