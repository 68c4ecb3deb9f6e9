"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into two halves. Two fingerprints that differ in at most 2 bits differ in at most 1 bit in one of
the halves, so each half's ball of radius 1 (33 values) is looked up in that half's table and the complete distance
verified. Halves that very many fingerprints share are not paired up: there the rest of the ball is spelled out and
looked up in the table of whole fingerprints.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Staged, ship, small, table
from tallyspark.llm.graph import components

#: Differing bits at which fingerprints still link.
RADIUS = 2
#: Fingerprints that may share a half before the ball is spelled out instead of pairing them.
CROWD = 1024

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.uint16)


def fingerprint(text: bytes, shingle: int = 3, block: int = 1 << 16) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; zero for a text without words."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly space and 9 to 13
    if not words:
        return 0
    many = max(1, len(words) - shingle + 1)
    if many == 1:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 42)).astype(np.int64))
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, many, block):
        stop = min(at + block, many)
        pieces = map(b" ".join, zip(*[words[at + k : stop + k] for k in range(shingle)], strict=True))
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, stop - at)
        lanes = (h.view(np.uint8).reshape(-1, 8) + _LANES).ravel()
        ones += np.bincount(lanes, minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones > many, axis=1, bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


def _masks(radius: int) -> list[int]:
    """All values of 32 bits with at most so many ones."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(32), n)]


def _half(seg: int):
    return F.shiftrightunsigned("fp", 32) if seg == 0 else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in column fp that differ in at most radius bits (up to 3), each once."""
    ball = radius // 2
    entries = F.array(*[F.struct(F.lit(s).alias("seg"), _half(s).alias("val")) for s in (0, 1)])
    index = fps.select("fp", F.explode(entries).alias("x")).select("x.seg", "x.val", F.col("fp").alias("b"))
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(ball)])
    probes = (
        fps.select("fp", F.explode(entries).alias("x"))
        .select("fp", "x.seg", "x.val", F.explode(masks).alias("flip"))
        .select(F.col("fp").alias("a"), "seg", F.col("val").bitwiseXOR(F.col("flip")).alias("val"), "flip")
    )
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    crowds = Staged(index.groupBy("seg", "val").count().filter(F.col("count") > crowd).select("seg", "val"), "crowds").df
    n = crowds.count()
    sparse = index if n == 0 else index.join(small(crowds, n), ["seg", "val"], "left_anti")
    # Both sides are many times their table's size, which Spark does not see: it must not broadcast either.
    found = probes.join(sparse.hint("merge"), ["seg", "val"]).filter((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")
    if n:
        into = probes.join(small(crowds, n), ["seg", "val"], "left_semi")
        left = F.when(F.col("flip") == 0, F.array(*[F.lit(m).cast("long") for m in _masks(radius)]))
        for used in range(1, ball + 1):
            rest = F.array(*[F.lit(m).cast("long") for m in _masks(radius - used)])
            left = left.when(F.bit_count("flip") == used, rest)
        whole = F.when(F.col("seg") == 0, F.shiftleft("val", 32).bitwiseOR(_half(1).bitwiseXOR(F.col("m")))).otherwise(
            F.shiftleft(_half(0).bitwiseXOR(F.col("m")), 32).bitwiseOR(F.col("val"))
        )
        spelled = into.withColumnRenamed("a", "fp").withColumn("m", F.explode(left)).select(F.col("fp").alias("a"), whole.alias("b"))
        met = spelled.filter("a < b").join(fps.select(F.col("fp").alias("b")), "b", "left_semi")
        found = found.union(met.select("a", "b"))
    return found.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fp (signed 64-bit fingerprint) and component_id, the smallest key that links reach, one row per row of docs.

    A null text counts as empty; texts without words have fingerprint zero and link like any other. Null keys never
    become a component_id unless a component has no other. Equal fingerprints are linked through one representative,
    so groups of copies of any size cost one row.
    """
    ship(docs.sparkSession)
    rows = Staged(docs.select(key, F.arrow_udf(_fingerprints, "long")(F.col(text)).alias("fp")), "fingerprints").df
    fps = Staged(rows.groupBy("fp").agg(F.min(key).alias("least")), "distinct").df
    roots = components(links(fps.select("fp"), radius))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = Staged(rooted, "rooted").df
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    each = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(each, "fp").select(key, "fp", "component_id")


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
