"""Alignment of two tokenizers' ids of the same texts, by divide and conquer at shared cuts.

An interval of bytes is divided at a token end that both tokenizers have near its middle, found by bisecting one
tokenizer's ends for the other's, and both parts are treated alike; an interval without a common end inside is a leaf, a
group. Texts laid end to end are divided together, all intervals of a depth at once. Each group links every two tokens
that overlap. How many documents hold an id pair is summed over each chunk of documents before it is shuffled, and what
it comes to is told back to the chunks, so a frequent pair costs a row for each chunk, not for each document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.bpe import Encoder, KeyTable, _library
from tallyspark.llm.common import Staged, ship, table

#: Bits of an id of the second tokenizer within a pair's key.
SHIFT = 20
#: Bytes of text that are aligned at once, distinct pairs and bytes of text at which a chunk ends; pieces remembered.
BLOCK, PAIRS, CHUNK, REMEMBERED = 1 << 20, 1 << 20, 48 << 20, 1 << 20

_PIECE = re.compile(rb" +[^ ]*")


def shared_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the ascending ends a are in b, too; the last end of both must be the same.

    An interval is the range lo..hi - 1 of ends between two cuts that may be further ones. From its middle one the search
    leaps to the next end of either list that is not below the other's, up to the first common one; what it has leapt
    over holds no cut, so it is not looked at again.
    """
    cut = np.zeros(len(a), bool)
    if len(a):
        cut[-1] = True
    lo, hi = np.zeros(1, np.int64), np.array([len(a) - 1])
    lo, hi = lo[lo < hi], hi[lo < hi]
    while len(lo):
        mid = (lo + hi) >> 1
        at = mid.copy()
        end = b[np.searchsorted(b, a[at])]
        open_ = np.flatnonzero(end != a[at])
        while len(open_):
            at[open_] = np.searchsorted(a, end[open_])
            open_ = open_[at[open_] < hi[open_]]
            end[open_] = b[np.searchsorted(b, a[at[open_]])]
            open_ = open_[end[open_] != a[at[open_]]]
        found = at < hi
        cut[at[found]] = True
        lo, hi = np.concatenate([lo, at[found] + 1]), np.concatenate([mid, hi[found]])
        lo, hi = lo[lo < hi], hi[lo < hi]
    return cut


class Pieces:
    """Ids of texts under a sentencepiece model whose pieces hold spaces at their beginning only, so that no piece crosses
    into a run of spaces: what a run of spaces begins is encoded by itself, once, then from memory."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("pieces hold spaces inside")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.widths = np.array([len(x) for x in self.bytes], np.int64)
        self.space = [self.model.piece_to_id("▁")]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.whole = np.zeros(0, bool)

    def _learn(self, parts: list[bytes]) -> None:
        # The model itself adds the first space, but to an empty text.
        coded = [c or self.space for c in self.model.encode([p[1:].decode() for p in parts], num_threads=1)]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        whole = [b"".join([self.bytes[i] for i in c]) == p for c, p in zip(coded, parts, strict=True)]
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.size, self.whole = np.concatenate([self.size, size]), np.concatenate([self.whole, np.array(whole, bool)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for c in coded for i in c), np.int64, int(size.sum()))])
        self.held += sum(map(len, parts))
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts that begin with a space, end to end, how many each has, and whether they spell each text."""
        parts = [_PIECE.findall(t) for t in texts]
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = [p for each in parts for p in each]
        if len(self.number) > REMEMBERED or self.held > 32 << 20:
            self._forget()
        fresh = [p for p in set(flat) if p not in self.number]
        if fresh:
            self._learn(fresh)
        row = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        size = self.size[row]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[row] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], np.cumsum(many)])
        faults = np.concatenate([[0], np.cumsum(~self.whole[row])])[upto]
        return ids, np.diff(np.concatenate([[0], ends])[upto]), np.diff(faults) == 0


@lru_cache(2)
def _pieces(content: bytes) -> Pieces:
    return Pieces(content)


@lru_cache(2)
def _plain_encoder(content: bytes) -> Encoder:
    """An encoder to which the strings of special tokens are plain text; kept by the worker."""
    own = Encoder(json.loads(content), _library(content))
    own.special = {}
    return own


class _Aligner:
    """Aligns blocks of texts; numbers the id pairs of a chunk."""

    def __init__(self, first: bytes, second: bytes):
        self.first, self.second = _plain_encoder(first), _pieces(second)
        self.widths = self.first.tokens.pieces[2]
        self.close()

    def close(self) -> None:
        self.pairs, self.df, self.bytes = KeyTable(), np.zeros(0, np.int64), 0

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, each = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for at, part, n, _ in self.first.batches(texts):
            ids.append(part)
            each[at : at + len(n)] += n
        return np.concatenate(ids), each

    def block(self, texts: list[str]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, groups, and pair numbers and times (bytes) of each text, none of them empty."""
        texts = [" " + t for t in texts]
        raw = [t.encode() for t in texts]
        self.bytes += sum(map(len, raw))
        ids_b, n_b, whole = self.second.encode(raw)
        ids_a, n_a = self._encoded(texts)
        # Byte-level ids spell every text; of the second tokenizer's, only texts that they spell go on.
        ids_a, ids_b = ids_a[np.repeat(whole, n_a)], ids_b[np.repeat(whole, n_b)]
        n_a, n_b = np.where(whole, n_a, 0), np.where(whole, n_b, 0)
        ends_a, ends_b = np.cumsum(self.widths[ids_a]), np.cumsum(self.second.widths[ids_b])
        cut_a = shared_cuts(ends_a, ends_b)
        upto_b = np.searchsorted(ends_b, ends_a[cut_a]) + 1  # tokens of the second up to each cut
        upto_a = np.flatnonzero(cut_a) + 1
        last_a = np.cumsum(n_a)
        groups = np.diff(np.searchsorted(upto_a, np.concatenate([[0], last_a]), side="right"))
        written = self._written(ids_a, ids_b, upto_a, upto_b, groups)

        # Between two neighbouring ends of either tokenizer lies exactly one pair of overlapping tokens.
        ends = np.union1d(ends_a, ends_b)
        in_a, in_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        text_of = np.searchsorted(last_a, in_a, side="right")
        keys = ((ids_a[in_a] << SHIFT) | ids_b[in_b]).view(np.uint64)
        links = np.bincount(text_of, minlength=len(texts))
        number = self.pairs.find(keys)
        new = np.unique(keys[number < 0])
        if len(new):
            self.pairs.add(new)
            number[number < 0] = self.pairs.find(keys[number < 0])
            self.df = np.concatenate([self.df, np.zeros(len(new), np.int64)])
        held, times = np.unique((text_of << 32) | number, return_counts=True)
        nth = held & 0xFFFFFFFF
        self.df += np.bincount(nth, minlength=len(self.df))
        at = np.searchsorted(held >> 32, np.arange(len(texts) + 1)).tolist()
        nth, times = nth.astype("<u4"), times.astype("<u4")
        return [(int(a), int(b), int(g), int(n), w, nth[i:j].tobytes(), times[i:j].tobytes()) for a, b, g, n, w, i, j in zip(n_a, n_b, groups, links, written, at, at[1:], strict=False)]

    @staticmethod
    def _written(ids_a: np.ndarray, ids_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, groups: np.ndarray) -> list[str]:
        """The groups of each text: ids by commas, the two sides by a bar, groups by semicolons."""
        size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        place_a = np.arange(len(ids_a)) + np.repeat(upto_b - size_b, size_a)
        place_b = np.arange(len(ids_b)) + np.repeat(upto_a, size_b)
        n = len(ids_a) + len(ids_b)
        ids, mark = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ids[place_a], ids[place_b] = ids_a, ids_b
        both = upto_a + upto_b
        mark[both - 1], mark[both - size_b - 1] = 2, 1
        last = np.cumsum(groups)
        upto = np.concatenate([[0], both])[np.concatenate([[0], last])].tolist()
        mark[[j - 1 for i, j in zip(upto, upto[1:], strict=False) if j > i]] = 3
        spelt = list(map(_spelt().__getitem__, (4 * ids + mark).tolist()))
        return ["".join(spelt[i:j]) for i, j in zip(upto, upto[1:], strict=False)]


class _Spelt(dict):
    """An id's digits with what follows them."""

    def __missing__(self, code: int) -> str:
        self[code] = out = f"{code >> 2}{(',', '|', ';', '')[code & 3]}"
        return out


@lru_cache(1)
def _spelt() -> _Spelt:
    return _Spelt()


_NAMES = ["chunk", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "nth", "times", "pairs", "df"]


def _aligned(first, second, digest: bool, limits: tuple[int, int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; after those of a chunk, a row with its pairs and how many of its documents hold each."""
    own, task, chunk = _Aligner(first.value, second.value), TaskContext.get().partitionId(), 0
    most, pairs, size_of_chunk = limits
    longs = pa.list_(pa.int64())
    name = lambda: f"{task}-{chunk}"

    def closed() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        row = [pa.array([own.pairs.keys.view(np.int64)], longs), pa.array([own.df], longs)]
        out = pa.RecordBatch.from_arrays([pa.array([name()]), *[pa.nulls(1, k) for k in kinds], *row], _NAMES)
        own.close()
        return out

    for batch in batches:
        texts = batch.column("text").to_pylist()
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= most):
                size += len(texts[stop] or "")
                stop += 1
            some = [i for i in range(at, stop) if texts[i]]
            rows = [(0, 0, 0, 0, "", b"", b"")] * (stop - at)
            if some:
                for i, row in zip(some, own.block([texts[i] for i in some]), strict=True):
                    rows[i - at] = row
            n_a, n_b, groups, links, written, nth, times = zip(*rows, strict=True)
            if digest:
                written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
            columns = [[name()] * len(rows), n_a, n_b, groups, links, written, nth, times]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            made.insert(1, batch.column("key")[at:stop])
            yield pa.RecordBatch.from_arrays([*made, pa.nulls(len(rows), longs), pa.nulls(len(rows), longs)], _NAMES)
            at = stop
            if len(own.pairs.keys) >= pairs or own.bytes >= size_of_chunk:
                yield closed()
                chunk += 1
    if len(own.pairs.keys):
        yield closed()


def _told(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of a chunk's documents."""
    nth = pairs.column("at").to_numpy()
    count, best = np.zeros(len(nth), np.int64), np.zeros(len(nth), bool)
    count[nth], best[nth] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    total, firsts = [], []
    for held, times in zip(docs.column("nth").to_pylist(), docs.column("times").to_pylist(), strict=True):
        held, times = np.frombuffer(held, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        total.append(int((count[held] * times).sum()))
        firsts.append(int(times[best[held]].sum()))
    out = docs.select(["key", "n_a", "n_b", "n_groups", "n_links", "groups"])
    return out.append_column("n_best", pa.array(firsts, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). documents: key, n_a, n_b, n_groups, n_links, groups (text, as a1,a2|b1;a3|b2,b3; with `digest`
    its SHA-256), n_best and count_sum of every row. pairs: a, b, count (documents that hold the ids linked) and best
    (whether no other partner of a has a higher count).

    first: a byte-level tokenizer file, which encodes a space and the text; second: a sentencepiece model that itself adds
    the space. Special tokens' strings are plain text. A text that is null or empty, or that the second tokenizer's tokens
    do not spell byte by byte, has no tokens: zeros and an empty string. Repeated rows and null keys are documents of their
    own; an empty table gives empty results. A long text is aligned whole, with memory in proportion to it.
    """
    spark = docs.sparkSession
    ship(spark)
    told = []
    for path in (first, second):
        with open(path, "rb") as f:
            told.append(spark.sparkContext.broadcast(f.read()))  # vocabulary files, of a few MB
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    fixed = "n_a long, n_b long, n_groups long, n_links long, groups string"
    schema = f"chunk string, key {kind}, {fixed}, nth binary, times binary, pairs array<long>, df array<long>"
    limits = BLOCK, PAIRS, CHUNK
    aligned = Staged(rows.mapInArrow(lambda b: _aligned(*told, digest, limits, b), schema), "aligned").df
    held = aligned.filter("pairs IS NOT NULL").select(F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("pairs", "df")).alias("at", "x"))
    held = held.select("of", "at", F.col("x.pairs").alias("pair"), F.col("x.df").alias("df"))
    a = F.shiftright("pair", SHIFT)
    counts = held.groupBy("pair").agg(F.sum("df").alias("count"))
    counts = Staged(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(a))), "pairs").df  # partners of an id
    met = held.join(counts.withColumnRenamed("pair", "same"), F.col("pair") == F.col("same")).select("of", "at", "count", "best")
    texts = aligned.filter("pairs IS NULL").drop("pairs", "df")
    some = texts.filter("n_links > 0").groupBy("chunk").cogroup(met.groupBy("of")).applyInArrow(_told, f"key {kind}, {fixed}, n_best long, count_sum long")
    none = texts.filter("n_links = 0").select("key", "n_a", "n_b", "n_groups", "n_links", "groups", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    pairs = counts.select(a.alias("a"), F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b"), "count", "best")
    return some.unionByName(none).withColumnRenamed("key", key), pairs


def op13_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between the 50k byte-level and the 32k piece vocabulary."""
    import public_tokenizers

    docs, _ = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return docs.withColumnRenamed("groups", "groups_sha256")
