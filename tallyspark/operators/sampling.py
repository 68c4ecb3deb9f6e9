"""Deterministic sampling: rows are ordered by md5 of seed and key, so any engine draws the same ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.order import cut, numbered


def draw_key(seed: int, *keys: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def subsample(obs: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows; a top-n, so no full sort."""
    return obs.withColumn("__k", draw_key(seed, "cell_id")).orderBy("__k", "cell_id").limit(n).drop("__k")


def stratified(obs: DataFrame, fraction: float, least: int, seed: int) -> DataFrame:
    """Of each label max(least, n * fraction rounded half to even) rows, at most all; a missing label raises."""
    if obs.filter("label IS NULL").limit(1).count():
        raise ValueError("labels are missing")
    sizes = obs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    quota = F.least(F.greatest(F.bround(F.col("n") * F.lit(fraction)).cast("long"), F.lit(least)), F.col("n"))
    order = Window.partitionBy("label").orderBy("__k", "cell_id")
    rows = obs.withColumn("__k", draw_key(seed, "cell_id")).withColumn("__r", F.row_number().over(order))
    return rows.join(F.broadcast(sizes.select("label", quota.alias("__q"))), "label").filter("__r <= __q").select(obs.columns)


def split(obs: DataFrame, shares: tuple[float, float], seed: int) -> DataFrame:
    """obs with part (train, val, test), by label where each has at least 2 rows."""
    sizes = obs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    strata = "label" if sizes.agg(F.min("n")).first()[0] >= 2 else F.lit(0)
    order = Window.partitionBy(strata).orderBy("__k", "cell_id")
    rows = obs.withColumn("__k", draw_key(seed, "cell_id")).withColumn("__u", (F.row_number().over(order) - 1) / F.count(F.lit(1)).over(Window.partitionBy(strata)))
    part = F.when(F.col("__u") < shares[0], "train").when(F.col("__u") < shares[0] + shares[1], "val").otherwise("test")
    return rows.withColumn("part", part).drop("__k", "__u")


def plan(reference: DataFrame, k: int, n: int, balance: bool) -> DataFrame:
    """label, cells, target, realized: samples of k cells for each class. Balanced targets follow a class's mean
    reference against the mean of all classes (half to even); no more than there are combinations."""
    rows = reference.groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.avg("n_ref").alias("m")).filter(F.col("cells") >= k)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("m").alias("mm"))))
    target = F.greatest(F.lit(1), F.bround(n * F.col("m") / F.col("mm")).cast("long")) if balance else F.lit(n).cast("long")
    # Combinations as a running product, which stops mattering once it exceeds any target.
    ways = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1.0), lambda a, i: a * (F.col("cells") - k + i) / i)
    rows = rows.select("label", "cells", target.alias("target"), F.bround(F.least(ways, F.lit(1e15))).cast("long").alias("ways"))
    return rows.select("label", "cells", "target", F.least("target", "ways").alias("realized"))


def drawn_ranks(n: Column, k: int, *keys: Column) -> Column:
    """k different numbers of 1..n, drawn by Floyd's method: the i-th draw is of 1..n-k+i, and where it repeats an earlier
    one, that bound is taken itself. Draws come from md5 of the keys and i."""

    def draw(i: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *[x.cast("string") for x in keys], i.cast("string"))), 1, 15), 16, 10).cast("long")
        return F.pmod(h, n - k + i) + 1

    def step(drawn: Column, i: Column) -> Column:
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, draw(i)), (n - k + i).cast("long")).otherwise(draw(i).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast("array<long>"), step)


def combinations(obs: DataFrame, plan_: DataFrame, k: int, seed: int) -> DataFrame:
    """label, sample_id, cell_id: for each sample k cells of its class. Each sample draws k ranks, and ranks are joined
    with the numbered cells of the class, so rows are k for each sample, whatever the class's size."""
    samples = plan_.select("label", "cells", F.explode(F.sequence(F.lit(1), F.col("realized").cast("int"))).alias("sample_id"))
    ranks = drawn_ranks(F.col("cells"), k, F.lit(str(seed)), F.col("label"), F.col("sample_id"))
    chosen = samples.select(F.col("label").alias("l_"), "sample_id", F.explode(ranks).alias("rank"))
    cells = numbered(obs.select("label", "cell_id"), ["label"], ["cell_id"])
    met = chosen.join(cells, F.col("l_").eqNullSafe(F.col("label")) & (F.col("rank") == F.col("pos") + 1))
    return met.select("label", "sample_id", "cell_id")


def unique_combinations(obs: DataFrame, plan_: DataFrame, k: int, seed: int, rounds: int = 40) -> DataFrame:
    """combinations() without repeats. Where a class has few more combinations than samples, all are listed and drawn
    from; else samples that repeat an earlier one are drawn again with other seeds, and the earliest draws count. Raises
    if a class has not enough after all rounds."""
    plan_ = cut(plan_)  # a row for each class, from counts of all cells; it is read in each round and at the end
    ways = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1.0), lambda a, i: a * (F.col("cells") - k + i) / i)
    few, many = plan_.filter(ways <= 4 * F.col("realized")), plan_.filter(ways > 4 * F.col("realized"))
    cells = obs.select("label", "cell_id").join(F.broadcast(few.select("label")), "label")
    listed = cells.select("label", F.array("cell_id").alias("cells"))
    for _ in range(k - 1):
        more = cells.select(F.col("label").alias("l_"), F.col("cell_id").alias("c_"))
        met = listed.join(more, (F.col("label") == F.col("l_")) & (F.col("c_") > F.element_at("cells", -1)))
        listed = met.select("label", F.concat("cells", F.array("c_")).alias("cells"))
    out = listed.select("label", "cells", F.struct(F.lit(0).alias("r"), draw_key(seed, "label", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",")).alias("key")).alias("at"))
    todo = many
    for r in range(rounds):
        if not todo.limit(1).count():
            break
        got = combinations(obs, todo, k, seed + 1_000_003 * r)
        sets = got.groupBy("label", "sample_id").agg(F.array_sort(F.collect_list("cell_id")).alias("cells"))
        sets = sets.select("label", "cells", F.struct(F.lit(r).alias("r"), F.format_string("%010d", "sample_id").alias("key")).alias("at"))
        out = cut(out.unionByName(sets).groupBy("label", "cells").agg(F.min("at").alias("at")))  # draws of a round are made once
        have = out.groupBy("label").agg(F.count(F.lit(1)).alias("have"))
        todo = many.join(have, "label", "left").filter("coalesce(have, 0) < realized").select(plan_.columns)
    else:
        if todo.limit(1).count():
            raise RuntimeError(f"not enough distinct samples after {rounds} rounds")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("at"))
    rows = out.withColumn("sample_id", rank).join(F.broadcast(plan_.select("label", "realized")), "label").filter("sample_id <= realized")
    return rows.select("label", "sample_id", F.explode("cells").alias("cell_id"))


def aggregate(counts: DataFrame, reference: DataFrame, chosen: DataFrame, var: DataFrame, k: int) -> DataFrame:
    """label, sample_id, gene_id, k_sum, mean, zero_fraction and the sample's exposure_sum."""
    sums = chosen.join(counts, "cell_id").groupBy("label", "sample_id", "gene_id").agg(
        F.sum("value").alias("k_sum"), F.count_if(F.col("value") != 0).alias("hits")
    )
    each = chosen.join(reference.select("cell_id", "n_ref"), "cell_id").groupBy("label", "sample_id").agg(F.sum("n_ref").alias("exposure_sum"))
    rows = each.crossJoin(F.broadcast(var)).join(sums, ["label", "sample_id", "gene_id"], "left")
    zero = F.lit(0)
    return rows.select(
        "label", "sample_id", "gene_id", F.coalesce("k_sum", zero).alias("k_sum"), (F.coalesce("k_sum", zero) / k).alias("mean"),
        (1 - F.coalesce("hits", zero) / k).alias("zero_fraction"), "exposure_sum",
    )


def gene_subset(var: DataFrame, n: int, seed: int) -> DataFrame:
    """n genes in the order of their draw: pos, gene_id. A top-n, so no full sort; all genes if there are fewer."""
    drawn = var.select("gene_id").withColumn("__k", draw_key(seed, "gene_id")).orderBy("__k", "gene_id").limit(n)
    return drawn.select((F.row_number().over(Window.orderBy("__k", "gene_id")) - 1).alias("pos"), "gene_id")


def ways(n: int, k: int) -> int:
    return math.comb(n, k)
