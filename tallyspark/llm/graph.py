"""Connected components of large sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scope, Staged, small


#: Edges of a node beyond which the node's least neighbour is broadcast to them instead of gathering them.
CROWD = 1 << 15


def _least(edges: DataFrame) -> DataFrame:
    """n, the least m of n and its neighbours, and how many edges u, v it has."""
    return edges.groupBy(F.col("u").alias("n")).agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("many"))


def _told(edges: DataFrame, crowd: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Edges with the least neighbour m of their u, and _least(). Nodes of very many edges are few; where all edges
    (`most` of them) are few, there are none."""
    least = _least(edges)
    if most <= crowd:
        return edges.join(least.select("n", "m").hint("merge"), F.col("u") == F.col("n")).select("u", "v", "m"), least
    least = Staged(least, "least").df
    hot = least.filter(F.col("many") > crowd).select("n", "m")
    n = hot.count()
    plain = least.select("n", "m").hint("merge")
    if not n:
        return edges.join(plain, F.col("u") == F.col("n")).select("u", "v", "m"), least
    some = edges.join(small(hot, n), F.col("u") == F.col("n"), "left").select("u", "v", "m")
    rest = some.filter("m IS NULL").select("u", "v").join(plain, F.col("u") == F.col("n")).select("u", "v", "m")
    return some.filter("m IS NOT NULL").union(rest), least


def _large_star(edges: DataFrame, crowd: int, most: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _told(both, crowd, 2 * most)[0].filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, crowd: int, most: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near, least = _told(down, crowd, most)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60, crowd: int = CROWD) -> DataFrame:
    """node and root (the least node it is connected with) for every node of edges, which has the columns a and b.

    Alternates large and small stars until nothing changes. Each round is written to the shared folder, so a lost
    executor costs one round at most. The edges of a node that has more than `crowd` of them are not gathered in one task.
    """
    now = Staged(edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    mark = now.df.count(), None
    for _ in range(rounds):
        with Scope() as scope:
            then = Staged(_small_star(_large_star(now.df, crowd, mark[0]), crowd, mark[0]).filter("u <> v").distinct(), "edges")
            scope.keep(then)
        now.drop()
        now = then
        new = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = new
    raise RuntimeError(f"components did not settle within {rounds} rounds")
