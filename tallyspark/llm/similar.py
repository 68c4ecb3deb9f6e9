"""Near copies by the similarity of their sets of shingles, by SimHash and multi-index hashing.

Texts of similarity 0.8 differ in some 15 of 100 fingerprint bits, so fingerprints are long (24 words of 32 bits) and
each word's upper bits are a segment of the index. Of a segment's Hamming ball only the part is enumerated that near
copies fall into: flips of the bits that the fewest shingles decide. Two texts meet where their parts of the balls do.
Complete distances of fingerprints are verified first, then the complete sets of shingles.

A bucket of the index links its members to its smallest one only, and what these links join loosely has a middle, the
text nearest to the majority of its bits (the original, where copies were edited each for itself). Every
text is compared with its nearest candidate and with the middle. Of a loose group that this leaves in several parts,
texts of different parts are compared if their differences from the group's usual shingles share one of the rarest,
which sets of the required similarity must; so no pair of a loose group is lost, and copies of a template cost rows in
proportion to their number, as what each was edited to is its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Staged, ship, small
from tallyspark.llm.graph import components

#: Words of a fingerprint, each one segment.
SEGMENTS = 24
#: Differing bits of all of them (of 768) up to which texts belong together loosely (at similarity 0.8: 116, give or
#: take 10).
FAR = 200
#: Of 64 of these bits so many, beyond which two texts met in a bucket by chance: texts that meet so grow with the square
#: of their number, and differ in 32, give or take 4. Texts of similarity 0.8 differ in 10, give or take 3.
UNLIKE = 26
#: Bits of a segment that are indexed: so many more than the number of texts has, and the fewest and most. A bit more for
#: twice the texts, from 2^16 on and up to 2^24: a text meets others by chance in 2.5 times as many buckets for five times
#: the texts (more segments are flipped), not in five times as many.
SPARE, NARROW, WIDE = 8, 24, 32
#: Segments in which a bit more is flipped, for each bit of width beyond the fewest: pairs at 0.80 to 0.83 that share a
#: bucket are 2996 of 3000 at 24 bits, and 2995 at 26 bits, with one flip more in 6 segments (2990 without).
MORE = 4
#: Small rows (a key and two hashes) that may be broadcast.
MOST = 200_000

_DRAWN = np.random.default_rng(12).integers(0, 1 << 63, (3, SEGMENTS), dtype=np.uint64)
_SALT, _ODD = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)
_SIGNS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1) * 2.0 - 1.0
_LANES = (np.arange(4 * SEGMENTS) * 256).astype(np.int64)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words of a UTF-8 text; a shorter text is one run."""
    words = text.lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], "<u8")
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), "<u8", len(words))
    out = np.zeros(len(words) - size + 1, "<u8")
    for k in range(size):
        out = (out ^ each[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signed_sums(found: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """For each bit of the fingerprint the sum of the shingles' signs, each with a weight of its own between 1 and 2, so
    that few shingles decide bits by more or less, too."""
    total = np.zeros((4 * SEGMENTS, 256))
    for at in range(0, len(found), block):
        h = found[at : at + block, None]
        words = (((h ^ _SALT) * _ODD) >> np.uint64(32)).astype(">u4")
        weight = 1 + (found[at : at + block] >> np.uint64(40)).astype(float) / (1 << 24)
        lanes = words.view(np.uint8).reshape(len(h), -1) + _LANES
        total += np.bincount(lanes.ravel(), np.repeat(weight, 4 * SEGMENTS), total.size).reshape(total.shape)
    return (total @ _SIGNS).reshape(SEGMENTS, 32)


def packed(sums: np.ndarray) -> np.ndarray:
    """The fingerprint's words."""
    return np.packbits(sums > 0, axis=1).view(">u4").ravel().astype(np.uint32)


def ball(sums: np.ndarray, words: np.ndarray, width: int, flips: int) -> np.ndarray:
    """Keys (segment and value) of the indexed part of each segment's ball: the least decided bits, flipped or not."""
    least = np.argsort(np.abs(sums[:, :width]), axis=1, kind="stable")[:, :flips]
    bits = np.uint64(1) << (width - 1 - least).astype(np.uint64)
    masks = bits @ np.array(list(product((0, 1), repeat=flips)), np.uint64).T
    value = (words >> np.uint32(32 - width)).astype(np.uint64)[:, None] ^ masks
    return ((np.arange(SEGMENTS, dtype=np.uint64)[:, None] << np.uint64(32)) | value).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common members (Jaccard) of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(size: int):
    def sign(texts: pa.Array) -> pa.Array:
        values = texts.cast(pa.binary())
        nodes, sketch, sums = np.zeros(len(values), np.uint64), [], []
        for i, t in enumerate(values):  # one text at a time, as sets take more room than texts
            found = shingles(t.as_py() or b"", size)
            nodes[i] = xxhash.xxh64_intdigest(found.tobytes(), 7)
            s = signed_sums(found)
            sketch.append(packed(s))
            # How firmly bits are decided, in 255 steps: enough to tell the least decided ones.
            sums.append(np.minimum(np.abs(s) * (255 / max(np.abs(s).max(), 1e-9)), 255).astype(np.uint8).tobytes())
        fp = [x.astype("<u4").tobytes() for x in sketch]
        return pa.StructArray.from_arrays([pa.array(nodes.view(np.int64)), pa.array(fp, pa.binary()), pa.array(sums, pa.binary())], ["node", "fp", "firm"])

    return sign


def keyed(sums: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Keys of a text in an index of that width: the ball of 3 flips, of more in some segments where it is wider."""
    flips, more = divmod(MORE * (width - NARROW), SEGMENTS) if width > NARROW else (0, 0)
    keys = ball(sums, words, width, 3 + flips).reshape(SEGMENTS, -1)[more:].ravel()
    return np.concatenate([ball(sums, words, width, 4 + flips).reshape(SEGMENTS, -1)[:more].ravel(), keys]) if more else keys


def _keys(width: int):
    def keys(fp: pa.Array, firm: pa.Array) -> pa.Array:
        out = []
        for f, m in zip(fp.to_pylist(), firm.to_pylist(), strict=True):
            out.append(keyed(np.frombuffer(m, np.uint8).reshape(SEGMENTS, 32).astype(np.int16), np.frombuffer(f, "<u4"), width).view(np.int64))
        return _lists(out)

    return keys


def _apart(a: pa.Array, b: pa.Array) -> pa.Array:
    """Differing bits of fingerprints."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (a, b))
    return pa.array(np.bitwise_count(x ^ y).sum(axis=1).astype(np.int32), pa.int32())


def _held(values: pa.Array, kind: str) -> Iterator[np.ndarray]:
    """Each binary value as an array over the batch's own memory: sets of a batch's rows are not copied all at once."""
    return (np.frombuffer(v.as_buffer(), kind) for v in values)


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(x, y) for x, y in zip(_held(a, "<u8"), _held(b, "<u8"), strict=True)], pa.float64())


def _sets(size: int):
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py() or b"", size).tobytes() for t in texts.cast(pa.binary())], pa.binary())

    return sets


def _digests(text: str) -> list[Column]:
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("d1"), F.xxhash64(F.lit("second"), whole).alias("d2")]


def candidates(sets: DataFrame) -> DataFrame:
    """a, b and apart (differing bits, FAR at most) of texts (node, fp, firm) that share buckets of the index: enough pairs
    to connect what buckets join. Each text meets the smallest text of all its buckets first; where that leaves a bucket
    with texts of several groups, those of the others meet one of its first group, unless 64 bits of their fingerprints tell
    that chance brought them there, which would make pairs by the square of the number of texts. So a text of a large group of copies,
    whose buckets begin with many different texts, costs one pair and not one for each of these."""
    n = sets.count()
    width = min(WIDE, max(NARROW, n.bit_length() + SPARE))
    key = F.arrow_udf(_keys(width), "array<long>")(F.col("fp"), F.col("firm"))
    index = sets.select("node", F.explode(key).alias("key"))
    # Of the whole index, keys alone are counted first; what shares no bucket, most of it, goes no further.
    met = Staged(index.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("of"), "buckets").df
    held = Staged(index.join(met.hint("merge"), F.col("key") == F.col("of")).select("node", "key"), "held").df
    least = held.groupBy(F.col("key").alias("bucket")).agg(F.min("node").alias("least"))
    first = held.join(least.hint("merge"), F.col("key") == F.col("bucket")).groupBy(F.col("node").alias("b")).agg(F.min("least").alias("a")).filter("a <> b")
    near = _near(first.select("a", "b"), sets)
    roots = Staged(components(near), "first-roots").df.select(F.col("node").alias("n_"), "root")
    rooted = sets.select("node", _spot().alias("spot")).join(roots.hint("merge"), F.col("node") == F.col("n_"), "left")
    rooted = rooted.select(F.col("node").alias("m_"), F.coalesce("root", "node").alias("root"), "spot")
    index = held.select("node", "key").join(rooted.hint("merge"), F.col("node") == F.col("m_")).select("node", "root", "spot", "key")
    across = index.groupBy(F.col("key").alias("of")).agg(F.min(F.struct("root", "node", "spot")).alias("x"), F.max("root").alias("hi")).filter("x.root <> hi")
    across = Staged(across.select("of", "x"), "mixed-buckets").df
    unlike = F.bit_count(F.col("spot").bitwiseXOR(F.col("x.spot"))) > UNLIKE
    more = index.join(across.hint("merge"), (F.col("key") == F.col("of")) & (F.col("root") != F.col("x.root")) & ~unlike)
    return near.union(_near(more.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct(), sets))


def _spot() -> Column:
    """64 bits of a fingerprint that narrow indexes leave out: the last byte of its first 8 words (which lie in memory
    with the last byte first)."""
    return F.conv(F.hex(F.concat(*[F.substring("fp", 4 * k + 1, 1) for k in range(8)])), 16, -10).cast("long")


def _sketch() -> Column:
    """The first 64 bits of a fingerprint."""
    word = lambda at: F.conv(F.hex(F.substring("fp", at, 4)), 16, 10).cast("long")
    return F.shiftleft(word(1), 32).bitwiseOR(word(5))


def middles(loose: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b of every text b in a group (node, root) with the group's middle a."""
    own = Staged(sets.select(F.col("node").alias("of"), _sketch().alias("sketch")).join(loose.hint("merge"), F.col("of") == F.col("node")).select("node", "root", "sketch"), "loose").df
    bits = [F.sum(F.shiftright("sketch", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)]
    counts = own.groupBy("root").agg(F.count(F.lit(1)).alias("n"), *bits)
    major = F.lit(0).cast("long")
    for k in range(64):
        major = major.bitwiseOR(F.when(2 * F.col(f"b{k}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    major = Staged(counts.select(F.col("root").alias("r_"), major.alias("major")), "majorities").df
    off = own.join(major.hint("merge"), F.col("root") == F.col("r_"))
    best = off.groupBy(F.col("root").alias("r_")).agg(F.min(F.struct(F.bit_count(F.col("sketch").bitwiseXOR(F.col("major"))).alias("off"), "node")).alias("x"))
    return own.join(best.hint("merge"), F.col("root") == F.col("r_")).select(F.col("x.node").alias("a"), F.col("node").alias("b")).filter("a <> b")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose fingerprints differ in FAR bits at most, with their number."""
    one = sets.select(F.col("node").alias("a_"), F.col("fp").alias("fp_a"))
    two = sets.select(F.col("node").alias("b_"), F.col("fp").alias("fp_b"))
    both = pairs.join(one.hint("merge"), F.col("a") == F.col("a_")).join(two.hint("merge"), F.col("b") == F.col("b_"))
    # Told not to be deterministic, as else the filter gets an evaluation of its own, with workers of its own.
    told = F.arrow_udf(_apart, "int").asNondeterministic()(F.col("fp_a"), F.col("fp_b"))
    apart = both.select("a", "b", told.alias("apart"))
    return Staged(apart.filter(F.col("apart") <= FAR), "near").df


def _verified(pairs: DataFrame, raw: DataFrame, least: float) -> DataFrame:
    one = raw.select(F.col("node").alias("a_"), F.col("raw").alias("raw_a"))
    two = raw.select(F.col("node").alias("b_"), F.col("raw").alias("raw_b"))
    # A set has at most 1 / least as many members as one that is alike.
    sizes = F.least(F.octet_length("raw_a"), F.octet_length("raw_b")) >= least * F.greatest(F.octet_length("raw_a"), F.octet_length("raw_b")) - 1e-6
    both = pairs.select("a", "b").join(one.hint("merge"), F.col("a") == F.col("a_")).join(two.hint("merge"), F.col("b") == F.col("b_")).filter(sizes)
    return Staged(both.select("a", "b", F.arrow_udf(_alike, "double")(F.col("raw_a"), F.col("raw_b")).alias("s")).filter(F.col("s") >= least - 1e-12).select("a", "b"), "links").df


def _lists(each: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, each)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *each])))


def _listed(raw: pa.Array) -> pa.Array:
    return _lists([*_held(raw, "<i8")])


def _differences(raw: pa.Array, usual: pa.Array) -> pa.Array:
    """What either of two sets holds alone. Rows of a group come with the same usual set, as numbers of Python these would
    take some five times the room."""
    flat, ends = usual.values.to_numpy(), usual.offsets.to_numpy()
    return _lists([np.setxor1d(x, flat[a:b]) for x, a, b in zip(_held(raw, "<i8"), ends[:-1], ends[1:], strict=True)])


def rarest(raw: DataFrame, loose: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs a, b of texts of one loose group that may be of the required similarity, or that tell what such pairs would.

    Sets are told by what they differ in, n shingles, from the group's usual set: that of the shingles which over half of
    its texts hold. a and b are alike if and only if they differ in no more than m = (|a| + |b|) (1 - least) / (1 + least).
    So their differences from the usual set share at least c = (n_a + n_b - m) / 2, and so one among the first
    n_a - c + 1 of a and n_b - c + 1 of b, sorted by how many texts have them. Texts made from one template, each edited
    for itself, differ from it in shingles that no other text has, which come first; so they meet nobody. Where c is not
    above 0, the two are alike, as they are both near the usual set; then either is alike to the text that is nearest to
    it in n - |.| (1 - least) / (1 + least), so all are compared with that one. Groups of two texts are settled already.
    """
    rooted = loose.select("node", F.col("root").alias("loose")).join(roots.select(F.col("node").alias("n_"), "root").hint("merge"), F.col("node") == F.col("n_"), "left")
    rooted = Staged(rooted.select("node", "loose", F.coalesce("root", "node").alias("root")), "rooted").df
    split = rooted.groupBy(F.col("loose").alias("l_")).agg(F.count(F.lit(1)).alias("group"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("group > 2 AND lo <> hi")
    split = Staged(split.select("l_", "group"), "split").df
    own = rooted.join(split.hint("merge"), F.col("loose") == F.col("l_")).drop("l_")
    own = raw.select(F.col("node").alias("b_"), "raw").join(own.hint("merge"), F.col("b_") == F.col("node")).drop("b_")
    own = Staged(own, "split-sets", "none").df
    held = own.select("loose", "group", F.explode(F.arrow_udf(_listed, "array<long>")("raw")).alias("t"))
    held = held.groupBy("loose", "t").agg(F.count(F.lit(1)).alias("texts"), F.max("group").alias("group")).filter(2 * F.col("texts") > F.col("group"))
    usual = split.select("l_").join(held.groupBy("loose").agg(F.collect_list("t").alias("usual")).hint("merge"), F.col("l_") == F.col("loose"), "left")
    usual = Staged(usual.select("l_", F.coalesce("usual", F.array().cast("array<long>")).alias("usual")), "usual").df
    size = (F.octet_length("raw") / 8).cast("int")
    differ = F.arrow_udf(_differences, "array<long>")(F.col("raw"), F.col("usual"))
    own = own.join(usual.hint("merge"), F.col("loose") == F.col("l_"))
    own = Staged(own.select("node", "loose", "root", size.alias("size"), differ.alias("x")).withColumn("n", F.size("x")), "differences").df

    held = own.select("node", "loose", F.explode("x").alias("t"))
    many = held.groupBy(F.col("loose").alias("l_"), F.col("t").alias("t_")).agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    shared = held.join(many.hint("merge"), (F.col("loose") == F.col("l_")) & (F.col("t") == F.col("t_"))).groupBy(F.col("node").alias("n_")).agg(F.array_sort(F.collect_list(F.struct("texts", "t"))).alias("y"))
    share = F.lit((1 - least) / (1 + least))
    near = own.groupBy(F.col("loose").alias("l_")).agg(F.min(F.struct((F.col("n") - F.col("size") * share).alias("off"), F.col("node").alias("best"))).alias("z"), F.ceil(F.max("size") / 12).cast("int").alias("w"))
    near = Staged(near.select("l_", "z.*", "w"), "nearest-usual").df
    rows = own.drop("x").join(shared.hint("merge"), F.col("node") == F.col("n_"), "left").join(near.hint("merge"), F.col("loose") == F.col("l_"))
    rows = rows.withColumn("alone", F.col("n") - F.coalesce(F.size("y"), F.lit(0))).drop("n_", "l_")
    rows = Staged(rows, "shared").df
    star = rows.filter((F.col("node") != F.col("best")) & (F.col("off") + F.col("n") - F.col("size") * share <= 1e-6)).select(F.col("best").alias("a"), F.col("node").alias("b"))

    # A text meets others by classes of size and of n, as c grows with both: at a place `at` of its differences only those
    # whose n is no larger than m + n - 2 at, m for the largest size of the class.
    most = F.col("size") * F.lit((1 - least) / least) + 1e-6
    step = math.log(1.1)
    grade = lambda size: F.floor(F.ln(size) / step)
    first = F.posexplode(F.slice("y", F.lit(1), F.greatest(F.floor(F.col("reach")).cast("int") + 1 - F.col("alone"), F.lit(0))))

    def laid(reach: Column, mark: str) -> DataFrame:
        out = rows.filter("y IS NOT NULL").withColumn("reach", reach).select("node", "loose", "root", "size", "n", "w", "alone", first.alias("i", "z"))
        out = out.withColumn("at", F.col("alone") + F.col("i")).withColumn("grade2", F.explode(F.sequence(grade(F.col("size") * least), grade(F.col("size") / least))))
        largest = F.least(F.exp((F.col("grade2") + 1) * step), F.col("size") / least)
        m = (F.col("size") + largest) * share + 1e-6
        bound = m + F.col("n") - 2 * F.col("at")
        low, high = (F.col("n").cast("double"), bound) if mark == "f" else (F.greatest(F.col("n") - m, F.lit(0.0)), F.least(F.col("n").cast("double"), bound))
        out = out.withColumns({"low": low, "high": high}).filter("low <= high")
        out = out.withColumn("class2", F.explode(F.sequence(F.floor(F.col("low") / F.col("w")), F.floor(F.col("high") / F.col("w")))))
        out = out.withColumns({"class": F.floor(F.col("n") / F.col("w")), "grade": grade(F.col("size"))})
        return out.select(*[F.col(c).alias(f"{c}_{mark}") for c in ("node", "loose", "root", "size", "n", "at", "class", "class2", "grade", "grade2")], F.col("z.t").alias(f"t_{mark}"))

    fewer, more = laid(most / 2, "f"), laid(most, "m")
    c = F.ceil((F.col("n_f") + F.col("n_m") - (F.col("size_f") + F.col("size_m")) * share - 1e-6) / 2)
    met = fewer.join(
        more.hint("merge"),
        (F.col("loose_f") == F.col("loose_m")) & (F.col("t_f") == F.col("t_m")) & (F.col("class_f") == F.col("class2_m")) & (F.col("class2_f") == F.col("class_m"))
        & (F.col("grade_f") == F.col("grade2_m")) & (F.col("grade2_f") == F.col("grade_m"))
        & (F.col("root_f") != F.col("root_m")) & ((F.col("n_f") < F.col("n_m")) | ((F.col("n_f") == F.col("n_m")) & (F.col("node_f") < F.col("node_m"))))
        & (F.least("size_f", "size_m") >= F.lit(least) * F.greatest("size_f", "size_m") - 1e-6) & (F.col("at_f") <= F.col("n_f") - c) & (F.col("at_m") <= F.col("n_m") - c),
    )
    both = met.select(F.col("node_f").alias("a"), F.col("node_m").alias("b")).union(star)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame, key: str, text: str, size: int, least: float) -> DataFrame:
    """id, d1, d2 (key, and hashes of the text) and group of every row of docs."""
    ship(docs.sparkSession)
    signed = F.arrow_udf(_signed(size), "struct<node:long,fp:binary,firm:binary>")
    rows = docs.select(F.col(key).alias("id"), *_digests(text), signed(F.col(text)).alias("s"))
    rows = Staged(rows.select("id", "d1", "d2", "s.*"), "signatures").df
    sets = rows.groupBy("node").agg(F.min(F.struct("d1", "d2")).alias("d"), F.first("fp").alias("fp"), F.first("firm").alias("firm"))
    sets = Staged(sets.select("node", "d.d1", "d.d2", "fp", "firm"), "distinct").df
    near = candidates(sets.select("node", "fp", "firm"))
    loose = Staged(components(near), "loose").df

    # Every text with its nearest candidate and with the middle of its group.
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    nearest = both.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select(F.least("x.a", "b").alias("a"), F.greatest("x.a", "b").alias("b"))
    centred = _near(middles(loose, sets), sets).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nearest = Staged(nearest.union(centred).distinct(), "nearest").df
    nodes = near.select(F.col("a").alias("of")).union(near.select("b")).distinct()
    named = sets.select("node", F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    named = Staged(named.join(nodes.hint("merge"), F.col("node") == F.col("of"), "left_semi"), "candidates").df
    texts = docs.select(F.col(text).alias("t"), *_digests(text))
    texts = texts.join(small(named, named.count(), MOST), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    raw = texts.select("node", F.arrow_udf(_sets(size), "binary")(F.col("t")).alias("raw")).dropDuplicates(["node"])
    raw = Staged(raw, "sets", "none").df
    first = _verified(nearest, raw, least)
    roots = Staged(components(first), "roots").df

    second = _verified(rarest(raw, loose, roots, least), raw, least)
    roots = components(first.union(second)).withColumnRenamed("node", "of").hint("merge")
    groups = rows.select("id", "d1", "d2", "node").join(roots, F.col("node") == F.col("of"), "left")
    return Staged(groups.select("id", "d1", "d2", F.coalesce("root", "node").alias("group")), "groups").df


def keep_rows(docs: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """docs with exactly one row of each group: that with the smallest key (null keys come last), of equal keys that
    with the least hash of its text. groups: id, d1, d2 (key and hashes of the text) and group of every row.

    The dropped rows are fewer than the kept ones, so only where they are very many does the join shuffle texts.
    """
    each = groups.groupBy("group", "id", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("id").isNull().alias("no"), "id", "d1", "d2")
    first = groups.groupBy(F.col("group").alias("of")).agg(F.min(rank).alias("first"))
    # eqNullSafe, as a group of documents without a key may be one of null.
    met = each.join(first.hint("merge"), F.col("group").eqNullSafe(F.col("of"))).withColumn("stays", rank.eqNullSafe(F.col("first")))
    settled = met.filter("NOT stays OR n > 1").select(F.col("id").alias("s0"), F.col("d1").alias("s1"), F.col("d2").alias("s2"), "stays")
    settled = Staged(settled, "settled").df
    same = F.col("id").eqNullSafe(F.col("s0")) & (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("id"), *_digests(text))
    out = rows.join(small(settled, settled.count(), MOST), same, "left_anti")
    again = settled.filter("stays")
    n = again.count()
    if n:
        out = out.unionByName(rows.join(small(again, n, MOST), same, "left_semi").dropDuplicates(["id", "d1", "d2"]))
    return out.select("row.*")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group that chains of texts of similarity `least` or more join; see keep_rows().

    Similarity is that of the sets of runs of `size` words, A-Z in lower case. A null text counts as empty, and texts
    without words are alike. Of pairs at just 0.8 one in some 800 shares no bucket, of more alike ones fewer; all pairs of
    texts that buckets join, directly or not, are settled exactly. All columns stay, whatever they are called. An empty table gives an empty result.
    """
    return keep_rows(docs, similar_groups(docs, key, text, size, least), key, text)
