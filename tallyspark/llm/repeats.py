"""Removal of passages that an earlier document holds already, exact to the byte.

The dealt method, external induced suffix sorting, is not what runs here: see the README. Any two equal strings of
`least` bytes hold the same least-hashed short gram at the same place. So documents exchange the hashes of such anchor
grams only, and where other documents have one too, the strings around it; equal strings then meet in one group.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Folder, Staged, drop_path, shared_dir, ship, small, table
from tallyspark.llm.tokenfiles import _file_system

#: Least bytes of an anchor gram, bytes of text in a part, and of text for each group of passages (half a group of anchors).
GRAM, PART, GROUP = 16, 1 << 20, 8 << 20

#: Parts that one message may tell of, and anchors, or bytes around them, that a task gathers for its messages.
BLOCK, HELD, HELD_BYTES = 8, 1 << 21, 16 << 20

_ODD = 0x9E3779B97F4A7C15
_EVEN = pow(_ODD, -1, 1 << 64)  # evens a power of _ODD out
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Powers are kept for so many places; those of later places are products of two.
_NEAR = 1 << 16


@lru_cache(2)
def _powers(base: int) -> np.ndarray:
    p = np.full(_NEAR, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def _far(base: int, size: int) -> np.ndarray:
    """Powers of _NEAR, 2 * _NEAR and so on, as far as places below size need."""
    p = np.full((size >> 16) + 1, pow(base, _NEAR, 1 << 64), np.uint64)
    p[0] = 1
    return np.cumprod(p)


def _times_powers(x: np.ndarray, base: int) -> None:
    """x[i] *= base ** i."""
    near = _powers(base)
    for i, far in enumerate(_far(base, len(x))):
        own = x[i * _NEAR : (i + 1) * _NEAR]
        own *= near[: len(own)] * far


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Hashes:
    """Hashes of any substrings of some bytes, from running sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        each = _BYTES[data]
        _times_powers(each, _ODD)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(each, out=self.sums[1:])

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        h = self.sums[starts + size]
        h -= self.sums[starts]
        h *= _powers(_EVEN)[starts & (_NEAR - 1)]
        h *= _far(_EVEN, len(self.sums))[starts >> 16]
        return _mixed(h)

    def all(self, size: int) -> np.ndarray:
        """Those at every start."""
        h = self.sums[size:] - self.sums[:-size]
        _times_powers(h, _EVEN)
        return _mixed(h)


def gram(least: int) -> int:
    """Bytes of an anchor gram. Short grams of common words occur in other texts by chance, the more the larger the
    input; two thirds of a string rarely do, at the cost of more anchors."""
    return max(GRAM, 2 * least // 3)


def _first_least(low: np.ndarray, wide: int) -> np.ndarray:
    """Where the least of each `wide` neighbours stands. Places take the lowest bits of the hashes, so that one minimum
    finds both; how many depends on wide alone, as equal strings have to choose alike wherever they stand."""
    bits = max(17, wide.bit_length() + 1)
    step, mask = 1 << (bits - 1), np.uint64((1 << bits) - 1)
    out = np.empty(len(low) - wide + 1, np.int64)
    for lo in range(0, len(out), step):
        m = low[lo : lo + step + wide - 1] & ~mask
        m |= np.arange(len(m), dtype=np.uint64)
        span = 1
        while span < wide:
            by = min(span, wide - span)
            m = np.minimum(m[:-by], m[by:])
            span += by
        out[lo : lo + len(m)] = (m & mask).astype(np.int64) + lo
    return out


def anchors(hashes: Hashes, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first start, number of starts) of each run of strings of `least` bytes that share an anchor. bounds:
    where texts begin, and the end of the last; no string reaches over a bound."""
    n, size = int(bounds[-1]), gram(least)
    grams = n - size + 1
    if n < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = hashes.all(size)
    at = _first_least(low, least - size + 1)
    inside = np.zeros(n + 1, np.int32)
    sizes = np.diff(bounds)
    long = sizes >= least
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - least + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(at)]) > 0)
    a = at[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(starts) != 1)])) if len(starts) else np.zeros(0, np.int64)
    return low[a[new]], starts[new], np.diff(np.append(new, len(starts)))


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] times, for all i."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def later(keys: np.ndarray, ids: np.ndarray, data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Which strings (of `size` bytes at starts, with hashes keys) are equal to one with a smaller id. Strings of equal
    hashes are compared by their bytes, in runs, as neighbours differ in one byte only."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.lexsort((ids, keys))
    k = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    first = np.empty(len(keys), np.int64)
    first[order] = np.repeat(order[begins], np.diff(np.append(begins, len(k))))
    old = ids > ids[first]
    at = np.flatnonzero(old)
    a, b = starts[at], starts[first[at]]
    along = np.concatenate([[False], (np.diff(a) == 1) & (np.diff(b) == 1)])[: len(at)]
    same = data[a + size - 1] == data[b + size - 1]
    heads = np.flatnonzero(~along)
    for i in range(0, len(heads), 1 << 13):  # a block at a time, as places take eight bytes for each byte compared
        h, span = heads[i : i + (1 << 13)], np.arange(size)
        same[h] = (data[a[h][:, None] + span] == data[b[h][:, None] + span]).all(axis=1)
    if not same.all():  # another string has the same hash: all that look repeated are compared as they are
        twins = np.flatnonzero(np.isin(keys, keys[at]))
        least: dict[bytes, int] = {}
        raw = [data[s : s + size].tobytes() for s in starts[twins].tolist()]
        for r, i in zip(raw, ids[twins].tolist(), strict=True):
            least[r] = min(least.get(r, i), i)
        old[twins] = [least[r] < i for r, i in zip(raw, ids[twins].tolist(), strict=True)]
    return old


def runs(docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, count) of the maximal runs of consecutive starts of a document."""
    order = np.lexsort((starts, docs))
    d, s = docs[order], starts[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
    return d[new], s[new], np.diff(np.append(new, len(d)))


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(1).compress(np.array([len(arrays[0])], "<i8").tobytes() + body)


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = int(np.frombuffer(body, "<i8", 1)[0]), 8, []
    for k in kinds:
        size = len(body) - at if k == "rest" else n * np.dtype(k).itemsize
        out.append(np.frombuffer(body[at : at + size], np.uint8 if k == "rest" else k))
        at += size
    return out


def _group(h: np.ndarray, groups: int) -> np.ndarray:
    return ((h * np.uint64(_ODD)) >> np.uint64(33)) % np.uint64(groups)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, seq, id, bytes end to end, bounds) of the texts of each part in a batch. A part may come in several pieces, as
    batches and scan tasks may cut it."""
    for batch in batches:
        part, seq, ids = (batch.column(c).to_numpy() for c in ("part", "seq", "id"))
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            texts = batch.column("text").take(pa.array(own)).cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(own) + 1]
            data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
            yield p, seq[own], ids[own], data, bounds - bounds[0]


def _rows(rows: list[tuple], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    for at in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 512], strict=True), kinds, strict=True)], list(names))


def _by_group(g: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(g, kind="stable")
    cuts = np.flatnonzero(np.diff(g[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(g[own[0]]), own


def _told(least: int, groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each piece of a part, with the part, dealt to groups. A task gathers the pieces it reads, so
    that messages are as many as groups for each task, not for each part."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def dealt() -> Iterator[pa.RecordBatch]:
        h, of = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        yield from _rows([(g, _pack(h[own], of[own])) for g, own in _by_group(_group(h, groups))], ("g", "raw"))

    for part, _, _, data, bounds in _parts(batches):
        h = np.sort(anchors(Hashes(data), bounds, least)[0])
        h = h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
        held.append((h, np.full(len(h), part, "<i4")))
        if sum(len(x) for x, _ in held) >= HELD:
            yield from dealt()
    if held:
        yield from dealt()


def _shared(block: int):
    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block of parts its anchors that other parts, or other pieces of a part, hold too, with the part."""
        h, of = (np.concatenate(x) for x in zip(*[_unpack(r, "<u8", "<i4") for r in pdf["raw"]], strict=True))
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        # A piece tells an anchor once, so an anchor that one part tells twice is in two of its pieces.
        same = h[1:] == h[:-1]
        met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        h, of = h[met], of[met]
        out = [(b, _pack(h[own], of[own])) for b, own in _by_group(of // block)]
        return pd.DataFrame(out, columns=["block", "raw"])

    return share


def _side(path: str, block: int) -> list[bytes]:
    """What is written for a block in a folder partitioned by block."""
    store, folder = _file_system(f"{path}/block={block}")
    if store.get_file_info(folder).type == pa.fs.FileType.NotFound:
        return []
    return pa.dataset.dataset(folder, filesystem=store, format="parquet").to_table(columns=["raw"]).column("raw").to_pylist()


def _passages(least: int, groups: int, block: int, path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: strings around shared anchors, for groups; kind 1: repeats that a part settles by itself."""
    names = ("kind", "g", "block", "raw")
    known, wide, of_part = None, np.zeros(0, np.uint64), np.zeros(0, np.int32)
    held: list[tuple[np.ndarray, ...]] = []

    def dealt() -> Iterator[pa.RecordBatch]:
        h, id_, seq, first, count, part, data = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        size = count + least - 1
        begins = np.cumsum(size) - size
        rows = []
        for g, own in _by_group(_group(h, groups)):
            rows.append((0, g, 0, _pack(id_[own], seq[own], first[own], count[own], part[own], data[spread(begins[own], size[own])])))
        yield from _rows(rows, names)

    for part, seq, ids, data, bounds in _parts(batches):
        if part // block != known:
            known = part // block
            each = [_unpack(r, "<u8", "<i4") for r in _side(path, known)]
            wide, of_part = (np.concatenate(x) for x in zip(*each, strict=True)) if each else (wide[:0], of_part[:0])
        hashes = Hashes(data)
        h, first, count = anchors(hashes, bounds, least)
        doc = np.searchsorted(bounds, first, side="right") - 1
        abroad = np.isin(h, wide[of_part == part])
        here = _of_several(h, doc)
        met = np.flatnonzero(abroad | here)
        starts = spread(first[met], count[met])
        of = np.repeat(met, count[met])
        old = later(hashes.of(starts, least), ids[doc[of]], data, starts, least)
        d, s, n = runs(seq[doc[of[old]]], starts[old] - bounds[doc[of[old]]])
        if len(d):
            yield from _rows([(1, 0, known, _pack(d.astype("<i8"), s.astype("<i8"), n.astype("<i8")))], names)
        fresh = np.zeros(len(h), bool)
        fresh[of[~old]] = True
        sent = np.flatnonzero(abroad & fresh)
        if len(sent):
            raw = data[spread(first[sent], count[sent] + least - 1)]
            told = (ids[doc[sent]], seq[doc[sent]], first[sent] - bounds[doc[sent]], count[sent])
            held.append((h[sent], *[x.astype("<i8") for x in told], np.full(len(sent), part, "<i4"), raw))
        if sum(len(x[-1]) for x in held) >= HELD_BYTES:
            yield from dealt()
    if held:
        yield from dealt()


def _of_several(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which hashes occur in several documents."""
    if not len(h):
        return np.zeros(0, bool)
    order = np.argsort(h, kind="stable")
    k, d = h[order], doc[order]
    begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    several = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(several, np.diff(np.append(begins, len(k))))
    return out


def _settled(least: int, block: int):
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_unpack(r, "<i8", "<i8", "<i8", "<i8", "<i4", "rest") for r in pdf["raw"]]
        ids, seq, first, count, part, data = (np.concatenate(x) for x in zip(*each, strict=True))
        size = count + least - 1
        begins = np.cumsum(size) - size
        of = np.repeat(np.arange(len(ids)), count)
        at = spread(begins, count)
        old = np.flatnonzero(later(Hashes(data).of(at, least), ids[of], data, at, least))
        where = spread(first, count)[old]
        out = []
        to, docs = (part // block)[of[old]], seq[of[old]]
        for b, own in _by_group(to):
            out.append((b, _pack(*runs(docs[own], where[own]))))
        return pd.DataFrame(out, columns=["block", "raw"])

    return settle


def removed_spans(first: np.ndarray, count: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes that runs of starts cover."""
    out: list[list[int]] = []
    for a, n in sorted(zip(first.tolist(), count.tolist(), strict=True)):
        b = a + n - 1 + least
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(least: int, block: int, path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, table_ = None, {}
    for part, seq, _, data, bounds in _parts(batches):
        if part // block != known:
            known, table_ = part // block, {}
            each = [_unpack(r, "<i8", "<i8", "<i8") for r in _side(path, known)]
            if each:
                d, s, n = (np.concatenate(x) for x in zip(*each, strict=True))
                order = np.argsort(d, kind="stable")
                table_ = {int(d[own[0]]): (s[own], n[own]) for own in np.split(order, np.flatnonzero(np.diff(d[order])) + 1)}
        rows = []
        for i, q in enumerate(seq.tolist()):
            text = data[bounds[i] : bounds[i + 1]].tobytes()
            spans = removed_spans(*table_[q], least) if q in table_ else []
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            rows.append((q, len(text), len(text) - len(left), len(spans), left))
        cols = list(zip(*rows, strict=True))
        digests = [hashlib.sha256(x).hexdigest() for x in cols[4]]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(digests, pa.string())], ["seq", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def remove_repeats(docs: DataFrame, least: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row: what is left of a text (UTF-8; a null is empty)
    without the bytes of any string of `least` bytes that a row with a smaller key holds too.

    Keys are whole numbers; a row without one counts as later than all others, and rows of equal keys do not count
    against each other. Whole copies of an earlier text are settled by their hash. Texts are shuffled once.
    """
    if least <= GRAM:
        raise ValueError(f"least must exceed {GRAM}")
    spark = docs.sparkSession
    ship(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("id"), whole.alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text"), "n_bytes": F.octet_length("text").cast("long")})
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    copies = rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = Staged(copies.select("h1", "h2", "first"), "copies").df
    known = rows.join(small(copies, copies.count(), 200_000), ["h1", "h2"], "left")
    empty = hashlib.sha256().hexdigest()
    again = F.col("first").isNotNull() & (F.col("id") > F.col("first")) & (F.col("n_bytes") >= least)
    settled = known.filter(again).select("key", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"))
    parts, dealt, groups = (max(1, -(-total // size)) for size in (PART, 2 * GROUP, GROUP))
    block = min(BLOCK, max(1, parts // 24))  # parts that are read and told of together; of few texts one, for tasks enough
    blocks = -(-parts // block)
    rest = known.filter(~F.coalesce(again, F.lit(False))).select("key", "id", "text", F.pmod(F.xxhash64("id", "h1"), F.lit(parts)).cast("int").alias("part"))
    rest = rest.repartitionById(blocks, F.floor(F.col("part") / block).cast("int")).sortWithinPartitions("part")
    rest = Staged(rest.withColumn("seq", F.monotonically_increasing_id()), "texts").df
    base = Folder(spark, f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}").path
    texts = rest.select("part", "seq", "id", "text")
    told = texts.mapInArrow(lambda b: _told(least, dealt, b), "g int, raw binary")
    shared = told.groupBy("g").applyInPandas(_shared(block), "block int, raw binary")
    shared.repartition("block").write.partitionBy("block").parquet(f"{base}/anchors")
    found = Staged(texts.mapInArrow(lambda b: _passages(least, groups, block, f"{base}/anchors", b), "kind int, g int, block int, raw binary"), "passages", "none").df
    drop_path(spark, f"{base}/anchors")  # only passages, which are written now, read them
    met = found.filter("kind = 0").groupBy("g").applyInPandas(_settled(least, block), "block int, raw binary")
    met.union(found.filter("kind = 1").select("block", "raw")).repartition("block").write.partitionBy("block").parquet(f"{base}/runs")
    cut = texts.mapInArrow(lambda b: _cut(least, block, f"{base}/runs", b), "seq long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = rest.select("seq", "key").join(cut, "seq").drop("seq")
    return out.unionByName(settled).withColumnRenamed("key", key)


def op8_removed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without what earlier ones hold."""
    return remove_repeats(table(spark, sf_dir, "documents"))
