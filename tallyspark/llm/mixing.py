"""Mixing sources to target weights by entropy balancing.

Rates of documents stay as close as possible (in relative entropy, at document level) to taking each document once,
while each source's tokens meet a target and no document exceeds a cap. The optimum is an exponential tilt of the
document's size, min(cap, exp(lambda_s * size / mean_s)), with one dual variable for each source. The rate depends on
source and size only, so Newton's iterations run over the histogram of sizes, each source's in one group of distinct sizes,
with the dual variables in a DataFrame of their own. Rates become whole copies at last: within a source, from
long documents to short ones, each size takes the number of extra copies that brings the running total nearest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import Staged, let, ship, table, word_array

#: Groups of documents of one source and size are ranked in so many parts.
SALTS = 64


def _source_key(source: Column) -> Column:
    """A key that orders sources by code point, nulls last."""
    return F.when(source.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), source))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sk, source_size, target for a table of sk, source_size. Weights repeat over the ordered sources and split share
    of all sizes; no target exceeds cap times its source's size, and what is cut is shared out again by weight."""
    order = Window.orderBy("sk")
    listed = sizes.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights)))
    limit = F.col("source_size") * F.lit(float(cap))
    ratio = Window.orderBy("r", "sk")
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        listed.withColumn("limit", limit)
        .withColumn("r", F.col("limit") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("mu", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
        .withColumn("mu", F.min(F.when(F.col("r") > F.col("mu"), F.struct("r", "sk", "mu"))).over(every)["mu"])
    )
    full = F.when(F.col("mu").isNull() | (F.col("r") <= F.col("mu")), F.col("limit")).otherwise(F.col("w") * F.col("mu"))
    return level.select("sk", "source_size", full.alias("target"))


def _tilted(cap: float) -> Column:
    """Rate of a document of size `size` under its source's dual variable."""
    return F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(math.log(cap) + 1)))))


def _dual(cap: float, tolerance: float, rounds: int):
    def dual(pdf: pd.DataFrame) -> pd.DataFrame:
        """The dual variable of a source, from its histogram of sizes."""
        size, n = pdf["size"].to_numpy(float), pdf["n"].to_numpy(float)
        source, target = float(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        mass, mean, lam = size * n, float((size * n).sum() / n.sum()), 0.0
        done = not (source > 0 and 0 < target < source * (cap * (1 - 1e-12)))
        if not done:
            x, lo, hi = size / mean, -math.inf, math.log(cap) * mean / float(size[size > 0].min())
            for _ in range(rounds):
                rate = np.minimum(cap, np.exp(np.minimum(lam * x, math.log(cap) + 1)))
                g, dg = float((mass * rate).sum()), float((mass * x * rate)[rate < cap].sum())
                off = math.log(g / target) if g > 0 else -math.inf
                lo, hi = lam if off < 0 else lo, lam if off > 0 else hi
                done = abs(off) <= tolerance or hi - lo <= 1e-13 * abs(hi)
                if done:
                    break
                step = lam - off * g / dg if dg > 0 else math.nan
                if not lo < step < hi:
                    step = 2 * lam - 1 if lo == -math.inf else (lo + hi) / 2
                lam = step
        return pd.DataFrame({"sk": pdf["sk"].iloc[:1], "source_size": pdf["source_size"].iloc[:1], "target": [target], "mean": [mean], "lam": [lam], "done": [done]})

    return dual


def solve_duals(histogram: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-6, rounds: int = 200) -> DataFrame:
    """goals with the dual variable lam of each source, by safeguarded Newton steps on log mass.

    histogram: sk, size, n. goals: sk, source_size, target. Sources whose target is their cap are saturated (lam null,
    rate cap); those with no tokens or no target need no step. A step that leaves what is known of a variable's bounds is
    replaced by a bisection, so the rounds suffice for any source; raises if they do not. A source's steps need nothing of
    other sources, so each takes them all where its histogram is (as for the quota): steps that were jobs of their own
    left the driver more plans the more there were.
    """
    ship(histogram.sparkSession)
    kind = f"sk string, source_size {dict(goals.dtypes)['source_size']}, target double, mean double, lam double, done boolean"
    duals = Staged(histogram.join(goals, "sk").groupBy("sk").applyInPandas(_dual(cap, tolerance, rounds), kind), "duals").df
    waiting = duals.filter("NOT done").count()
    if waiting:
        raise RuntimeError(f"{waiting} sources did not meet their targets within {rounds} rounds")
    full = F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12))
    return duals.select("sk", "source_size", "target", "mean", F.when(~full, F.col("lam")).alias("lam"))


def _quota(pdf: pd.DataFrame) -> pd.DataFrame:
    """Extra copies of each size of a source, longest first, so that the running total stays nearest to the rates'."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    short, extra = 0.0, []
    for size, n, part in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["part"].tolist(), strict=True):
        short += n * part * size
        k = min(n, max(0, math.floor(short / size + 0.5))) if size and part > 0 else 0
        short -= k * size
        extra.append(k)
    return pdf.assign(extra=pd.array(extra, "int64"))[["sk", "size", "n", "whole", "extra"]]


def mix(
    docs: DataFrame, size: Column, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", source: str = "source"
) -> DataFrame:
    """key, size, source_size, target and copies for every row of docs.

    copies is a whole number up to cap (which is a whole number of at least 1). A row of size zero is taken once. Null
    sources form one source, the last. Which of several rows of one source and size get the extra copy is decided by
    a hash of the key, so reruns agree; rows that repeat a key (or have none) are told apart by nothing, so among these
    the engine's order decides. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    k64 = F.xxhash64(F.col(key), F.lit("mix"))
    sized = Staged(
        docs.select(key, _source_key(F.col(source)).alias("sk"), size.cast("long").alias("size"), k64.alias("k")).withColumn(
            "salt", F.pmod("k", F.lit(SALTS)).cast("int")
        ),
        "sizes",
    ).df
    parts = Staged(sized.groupBy("sk", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "parts").df
    histogram = Staged(parts.groupBy("sk", "size").agg(F.sum("n").alias("n")), "histogram").df
    goals = targets(histogram.groupBy("sk").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    duals = solve_duals(histogram, goals, cap)
    rate = F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(_tilted(cap))
    rated = (
        histogram.join(duals, "sk")
        .withColumn("x", F.col("size") / F.col("mean"))
        .withColumn("rate", F.when(F.col("size") == 0, 1.0).when(F.col("target") == 0, 0.0).otherwise(rate))
        .select("sk", "size", "n", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"))
    )
    quota = rated.groupBy("sk").applyInPandas(_quota, "sk string, size long, n long, whole int, extra long")
    quota = Staged(quota, "quota").df
    before = Window.partitionBy("sk", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    some = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(quota.drop("n"), ["sk", "size"])
    some = Staged(some.select("sk", "size", "salt", "whole", (F.col("extra") - F.col("start")).alias("left"), "n"), "shares").df
    rank = Window.partitionBy("sk", "size", "salt").orderBy("k", F.col(key).asc_nulls_last())
    ranked = sized.join(some, ["sk", "size", "salt"]).withColumn(
        "more", F.when(F.col("left") >= F.col("n"), 1).when(F.col("left") <= 0, 0)
    )
    plain = ranked.filter("more IS NOT NULL")
    split = ranked.filter("more IS NULL").withColumn("more", F.when(F.row_number().over(rank) <= F.col("left"), 1).otherwise(0))
    each = plain.unionByName(split).join(duals.select("sk", "source_size", "target"), "sk")
    return each.select(key, "size", "source_size", "target", (F.col("whole") + F.col("more")).cast("int").alias("copies"))


def words(text: str = "text") -> Column:
    return let(word_array(F.col(text)), lambda w: F.size(w))


def mixed_rows(docs: DataFrame, size: Column | None = None, key: str = "doc_id", **options) -> DataFrame:
    """docs with every row repeated as often as mix() takes it. Keys that occur on several rows share out their copies:
    each of these rows gets the mean of them, rounded up for as many as needed, in an order by what they hold, so that
    reruns agree. Rows without a key are taken once. All
    columns stay, whatever they are called. An empty table gives an empty result."""
    taken = mix(docs.filter(F.col(key).isNotNull()), words() if size is None else size, key=key, **options)
    many = taken.groupBy(F.col(key).alias("k")).agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows"))
    many = Staged(many, "copies").df
    # One row for each document: as large a table as its files are small, so it must not be broadcast.
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("key"))
    out = rows.join(many.hint("merge"), F.col("key") == F.col("k"))
    repeated = many.filter("rows > 1").limit(1).count() > 0
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("row"), F.to_json("row"))) if repeated else F.lit(1)
    here = F.floor(F.col("all") / F.col("rows")) + F.when(nth <= F.col("all") % F.col("rows"), 1).otherwise(0)
    out = out.withColumn("n", here.cast("int")).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select("row.*").unionByName(docs.filter(F.col(key).isNull()))


def op1_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    taken = mix(table(spark, sf_dir, "documents"), words())
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
