"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every table hashes a vector to the cells of a few random projections of Gaussian (2-stable) directions. A query visits,
besides its own bucket, those whose cells it lies nearest to, in the order of their estimated success; the candidates
of all tables are merged and ranked by exact Euclidean distance. The first buckets of each table give a query a bound,
its k-th distance so far; of all further buckets only what lies within it is told.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import Staged, ship, small, table

#: Rows of the sample that the index is fitted on, and sampled queries; neither grows with the input.
SAMPLE_ROWS, SAMPLE_QUERIES = 4000, 100
#: Recall that the probes of a query must reach on the sample.
AIM = 0.96
TABLES = 4
#: Buckets of a table that are visited for the bound, and the most that a fitted family may visit.
FIRST, MOST_PROBES = 2, 512
#: Vectors and queries that meet in one task's block of a bucket.
BLOCK = 4096


@dataclass(frozen=True)
class Family:
    """Directions (tables x functions x dimensions), offsets in cells, the cells' width and the probes of a table."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    probes: int

    def cells(self, vectors: np.ndarray, t: int) -> np.ndarray:
        return vectors @ self.directions[t].T / self.width + self.offsets[t]

    @staticmethod
    def bucket(cells: np.ndarray) -> np.ndarray:
        """One number for each row of whole cells."""
        out = np.zeros(cells.shape[:-1], np.uint64)
        for k in range(cells.shape[-1]):
            out = (out ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out.view(np.int64)

    def home(self, vectors: np.ndarray, t: int) -> np.ndarray:
        return self.bucket(np.floor(self.cells(vectors, t)))

    def visited(self, vector: np.ndarray, t: int, probes: int | None = None) -> np.ndarray:
        """Buckets to visit, best first: the success of a step to a neighbouring cell falls with its squared distance."""
        cells = self.cells(vector[None], t)[0]
        low = np.floor(cells)
        return self.bucket(low + steps((cells - low).tolist(), probes or self.probes))


def steps(part: list[float], most: int) -> np.ndarray:
    """Up to so many sets of steps (-1, 0 or 1 for each function) in the order of their summed squared distances, for a
    vector that lies at these parts of its cells."""
    sides = sorted([(x * x, f, -1) for f, x in enumerate(part)] + [((1 - x) ** 2, f, 1) for f, x in enumerate(part)])
    out, waiting = [[0] * len(part)], [(sides[0][0], (0,))]
    while waiting and len(out) < most:
        cost, chosen = heappop(waiting)
        if len({sides[i][1] for i in chosen}) == len(chosen):  # not both sides of one cell
            step = [0] * len(part)
            for i in chosen:
                step[sides[i][1]] = sides[i][2]
            out.append(step)
        last = chosen[-1]
        if last + 1 < len(sides):  # the next side instead of the last one, or besides it
            heappush(waiting, (cost - sides[last][0] + sides[last + 1][0], (*chosen[:-1], last + 1)))
            heappush(waiting, (cost + sides[last + 1][0], (*chosen, last + 1)))
    return np.array(out)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances of one vector to many, in double precision."""
    return np.sqrt(((b - a) ** 2).sum(axis=1))


def fit(sample: np.ndarray, rows: int, aim: float = AIM, seed: int = 7) -> Family:
    """A family for a table of so many rows: more functions for more rows, cells of two standard deviations of the
    projected sample, and the fewest probes by which sampled queries find the sample's own neighbours with recall aim.
    Where MOST_PROBES do not suffice, fewer functions (larger buckets) are tried."""
    n, dims = sample.shape
    most = max(2, round(math.log(max(rows, 64) / 64, 3)))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(TABLES, most, dims))
    width = max(2.0 * float((sample @ directions.reshape(-1, dims).T).std()), 1e-12)
    offsets = rng.uniform(size=(TABLES, most))
    near = []
    for i, q in enumerate(sample[:SAMPLE_QUERIES]):
        d = distances(q, sample)
        d[i] = np.inf
        near.append(np.argsort(d, kind="stable")[: min(10, n - 1)])
    for functions in range(most, 0, -1):
        family = Family(directions[:, :functions], offsets[:, :functions], width, MOST_PROBES)
        homes = [family.home(sample, t) for t in range(TABLES)]
        needed = np.zeros(MOST_PROBES + 1)
        for q, some in zip(sample, near, strict=False):
            first = np.full(len(some), MOST_PROBES)  # the probe that finds each neighbour
            for t in range(TABLES):
                rank = {b: k for k, b in reversed([*enumerate(family.visited(q, t).tolist())])}
                first = np.minimum(first, [rank.get(b, MOST_PROBES) for b in homes[t][some].tolist()])
            np.add.at(needed, first, 1)
        enough = np.flatnonzero(np.cumsum(needed[:MOST_PROBES]) >= aim * needed.sum())
        if len(enough) or functions == 1:
            break
    return Family(family.directions, family.offsets, width, max(FIRST, int(enough[0]) + 1 if len(enough) else MOST_PROBES))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


_NAMES = ["id", "t", "bucket", "vec"]


def _rows(ids: np.ndarray, t: np.ndarray, buckets: np.ndarray, vectors: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    raw = [v.tobytes() for v in vectors]
    columns = [pa.array(ids, pa.int64()), pa.array(t, pa.int32()), pa.array(buckets, pa.int64()), pa.array(raw, pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.float64()) for x in more]], [*_NAMES, *["bound"] * len(more)])


def _indexed(family: Family, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = batch.column("id").to_numpy(), _vectors(batch.column("vec"))
        for t in range(TABLES):
            yield _rows(ids, np.full(len(ids), t), family.home(vectors, t), vectors)


def _probed(family: Family, begin: int, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The begin-th to end-th bucket of each table for each query, less those that it has visited before."""
    for batch in batches:
        columns = zip(batch.column("id").to_pylist(), _vectors(batch.column("vec")), batch.column("bound").to_pylist(), strict=True)
        for i, v, bound in columns:
            for t in range(TABLES):
                seen = family.visited(v, t, end)
                seen = np.setdiff1d(seen[begin:], seen[:begin])
                if len(seen):
                    yield _rows(np.full(len(seen), i), np.full(len(seen), t), seen, np.repeat(v[None], len(seen), axis=0), np.full(len(seen), bound))


def _ranked(k: int):
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of a block, the k + 1 nearest vectors within its bound for each query that visits it."""
        out: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            vectors = np.stack([np.frombuffer(v) for v in right["vec"]])
            ids = right["id"].to_numpy()
            for q, raw, bound in zip(left["id"].tolist(), left["vec"], left["bound"].tolist(), strict=True):
                d = distances(np.frombuffer(raw), vectors)
                some = np.flatnonzero(d <= bound)
                if len(some) > 4 * k:  # all that tie with the last one stay in the running
                    some = some[d[some] <= np.partition(d[some], k)[k]]
                for j in some[np.lexsort((ids[some], d[some]))][: k + 1].tolist():
                    out.append((q, int(ids[j]), float(d[j])))
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    return best


def _met(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """query_id, id, score of the k + 1 nearest vectors in all buckets that a query visits."""
    on = ["t", "bucket"]
    share = lambda df, c: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(c))
    blocks = Staged(share(index, "vectors").join(share(probes, "queries"), on), "blocks").df
    dealt = small(blocks, blocks.count())
    each = lambda mine, other: [F.pmod(F.xxhash64("id"), F.col(mine)).cast("int").alias(f"b_{mine}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"b_{other}")]
    left = probes.join(dealt, on).select("t", "bucket", "id", "vec", "bound", *each("queries", "vectors"))
    right = index.join(dealt, on).select("t", "bucket", "id", "vec", *each("vectors", "queries"))
    by = ["t", "bucket", "b_queries", "b_vectors"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_ranked(k), "query_id long, id long, score double")
    return _nearest(found, k)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("nth", best).filter(F.col("nth") <= k + 1)


def valid(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null or zero and has only finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def _one_each(rows: DataFrame) -> DataFrame:
    """rows (id, vec) without further vectors of an id; equal rows stay."""
    h = F.xxhash64("vec")
    several = rows.groupBy(F.col("id").alias("of")).agg(F.min(h).alias("least"), F.max(h).alias("most")).filter("least <> most")
    several = Staged(several.select("of", "least"), "several").df
    return rows.join(small(several, several.count()), F.col("id") == F.col("of"), "left").filter(F.col("of").isNull() | (h == F.col("least"))).drop("of", "least")


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest of all other rows found, ties to smaller ids.

    queries defaults to the rows whose key is divisible by `every`. Keys are whole numbers; rows without one, and
    vectors that are null, zero, not finite or of another length than most, take no part; rows that repeat a key and
    vector count once; of several vectors of one key that with the least hash counts. All rows are indexed. Equal
    vectors are indexed once, with the k + 1 smallest of their keys, so copies cost nothing. Buckets that many vectors or queries share are worked off in blocks.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")), "vec").filter("id IS NOT NULL")
    rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vec") == length["n"])
    asked = rows.filter(F.col("id") % every == 0) if queries is None else valid(
        queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")), "vec"
    ).filter(F.size("vec") == length["n"])
    asked = _one_each(asked)
    rows = _one_each(rows)
    first = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))  # equal rows count once
    few = rows.withColumn("nth", first).filter(F.col("nth") <= k + 1).groupBy("vec")
    distinct = Staged(few.agg(F.min("id").alias("id"), F.array_sort(F.collect_set("id")).alias("ids")), "vectors").df
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vec").collect()
    family = fit(np.array([r["vec"] for r in sample]), total)
    kind = "id long, t int, bucket long, vec binary"
    index = Staged(distinct.select("id", "vec").mapInArrow(lambda b: _indexed(family, b), kind), "index").df

    def visits(queries: DataFrame, begin: int, end: int) -> DataFrame:
        probes = queries.mapInArrow(lambda b: _probed(family, begin, end, b), f"{kind}, bound double")
        return Staged(_met(index, Staged(probes, "probes").df, k), "found").df

    asked = Staged(asked.select("id", "vec").dropDuplicates(["id"]), "asked").df
    found = visits(asked.withColumn("bound", F.lit(float("inf"))), 0, FIRST)
    if family.probes > FIRST:
        bounds = found.filter(F.col("nth") == k + 1).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
        bounded = asked.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        further = visits(bounded.select("id", "vec", "bound"), FIRST, family.probes)
        found = _nearest(found.unionByName(further).drop("nth"), k)
    named = found.join(distinct.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id"))
    named = named.filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"))
