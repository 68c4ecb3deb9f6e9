"""Packing of token sequences into windows by best-fit decreasing.

Only lengths decide where best-fit decreasing puts a piece, and windows of equal remaining room are alike. So the packing
is made for the histogram of lengths, which has a row for each length up to the window's whatever the corpus; it yields
runs: pieces of a length, numbered from `first` on, lie in consecutive windows from `sequence` on, at one offset. Pieces
are numbered within their length by the tasks that encode them, plus what earlier tasks have of that length. So texts are
encoded once, and each piece finds its place from its own number.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.bpe import _NUMBER, _SPACE, _SUFFIXES, Encoder, Merges, _classes, _library, _Memory, byte_letters
from tallyspark.llm.common import Staged, ship, table

#: Suffix of the tokens that end a word.
_END = "</w>"


class EndedMerges(Merges):
    """A merge list in which a word's last byte begins as a token of its own kind."""

    def __init__(self, first: list[int], last: list[int], pairs: list[tuple[int, int, int]], widths: dict[int, int]):
        super().__init__(first, pairs, widths)
        self.last = np.array(last, np.int64)

    def _symbols(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        ids = super()._symbols(words, sizes)
        ids[np.cumsum(sizes) - 1] = self.last[[w[-1] for w in words]]
        return ids


def word_points(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin and how many code points they have, in texts laid end to end, whose beginnings are given.

    Does what the pattern `'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+` finds, by comparing neighbours; what is
    between is dropped.
    """
    kind = _classes()[points]
    start = np.ones(len(points) + 1, bool)
    start[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    start[begins] = True
    opens = np.zeros(len(points) + 1, bool)
    opens[begins], opens[-1] = True, True
    for i in np.flatnonzero(start[:-1] & (points == 39)).tolist():
        for suffix in _SUFFIXES:
            end = i + 1 + len(suffix)
            if end <= len(points) and not opens[i + 1 : end].any() and all(points[i + 1 + k] == ord(c) for k, c in enumerate(suffix)):
                start[i + 1 : end], start[end] = False, True
                break
    at = np.flatnonzero(start)
    solid = kind[at[:-1]] != _SPACE
    return at[:-1][solid], np.diff(at)[solid]


class WordEncoder(Encoder):
    """Encodes texts under a tokenizer that normalises them (NFC, lower case), drops white space and splits into words, the
    last token of each marked as such. Pre-tokens pass the merges once and are remembered, as in the byte-level encoder."""

    def __init__(self, spec: dict, content: bytes):
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        widths = {i: max(len(token.removesuffix(_END)), 1) for token, i in vocab.items()}
        self.merges = EndedMerges([vocab[c] for c in letters], [vocab[c + _END] for c in letters], pairs, widths)
        self.library, self.memory, self.flat = _library(content), _Memory(), self._encoded

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, end to end, and how many each has; the few that are too long for a window by the library."""
        raw = [w.encode() for w in words]
        long = [i for i, w in enumerate(raw) if len(w) >= self.merges.window]
        ids, width = self.merges.encode_flat([b"" if len(w) >= self.merges.window else w for w in raw])
        if not long:
            return ids, width
        others, wide = self.library([words[i] for i in long])
        ids = np.insert(ids, np.repeat(np.concatenate([[0], np.cumsum(width)])[long], wide), others)
        width[long] = wide
        return ids, width

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Letters are made small one by one, whatever stands beside them; so a sigma is never a final one.
        texts = [unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3").lower() for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        points, ends = np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.cumsum(sizes)
        starts, size = word_points(points, (ends - sizes)[sizes > 0])
        ids, width = self._words(whole, points, starts, size)
        upto = np.concatenate([[0], np.cumsum(width)])[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return ids, np.diff(upto)

    def _pieces(self, text: str, block: int) -> Iterator[np.ndarray]:
        """Ids of a text without special tokens, some blocks at a time, cut at spaces, which no pre-token holds."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > block:
                end = text.rfind(" ", at + 1, at + block)
                end = end if end > 0 else text.find(" ", at + block)
                end = end if end > 0 else len(text)
            yield self._plain([text[at:end]])[0]
            at = end


@lru_cache(2)
def word_encoder(content: bytes) -> WordEncoder:
    """An encoder for a tokenizer file's content; kept by the worker."""
    return WordEncoder(json.loads(content), content)


def _whole_texts(own: WordEncoder, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The encoder's runs of texts (index of the first, ids, ids of each), those of a text that comes in several joined."""
    held: list[np.ndarray] = []
    for at, ids, each, more in own.batches(texts):
        if more or held:
            held.append(ids)
            if more:
                continue
            ids, held = np.concatenate(held), []
            each = np.array([len(ids)])
        yield at, ids, each


def _encoded(content, end: int, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of every text with the number of its full windows and of its rest among the task's; at last how many pieces of
    each length the task has."""
    own, task = word_encoder(content.value), TaskContext.get().partitionId()
    kind = np.dtype("<u2" if max(own.size, end + 1) <= 1 << 16 else "<u4")
    tally = np.zeros(window + 1, np.int64)
    names = ["task", "key", "n", "width", "ids", "full", "rest", "lengths", "counts"]
    lists = pa.list_(pa.int32()), pa.list_(pa.int64())
    for batch in batches:
        for at, ids, each in _whole_texts(own, batch.column("text").to_pylist()):
            ids, each = np.insert(ids, np.cumsum(each), end), each + 1
            rest = each % window
            full = each // window
            before = tally[window] + np.cumsum(full) - full
            order = np.argsort(rest, kind="stable")
            size, starts, many = np.unique(rest[order], return_index=True, return_counts=True)
            nth = np.empty(len(rest), np.int64)
            nth[order] = np.arange(len(rest)) - np.repeat(starts, many) + np.repeat(tally[size], many)
            tally[size] += many
            tally[0] = 0
            tally[window] += int(full.sum())
            offsets = np.concatenate([[0], np.cumsum(each) * kind.itemsize]).astype(np.int32)
            n = len(each)
            coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))])
            columns = [pa.array(np.full(n, task, np.int32)), batch.column("key")[at : at + n], pa.array(each), pa.array(np.full(n, kind.itemsize, np.int32)), coded, pa.array(before), pa.array(nth), pa.nulls(n, lists[0]), pa.nulls(n, lists[1])]
            yield pa.RecordBatch.from_arrays(columns, names)
    some = np.flatnonzero(tally)
    last = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), *last, pa.array([some.tolist()], lists[0]), pa.array([tally[some].tolist()], lists[1])], names)


class RoomTree:
    """A segment tree over remaining room: which is the least room of at least so much that some open window has?"""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.held = np.zeros(2 * self.leaves, bool).tolist()

    def set(self, room: int, held: bool) -> None:
        at = room + self.leaves
        self.held[at] = held
        while at > 1:
            at >>= 1
            now = self.held[2 * at] or self.held[2 * at + 1]
            if self.held[at] == now:
                break
            self.held[at] = now

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if at >= 2 * self.leaves:
            return None
        if not self.held[at]:
            while at > 1 and (at & 1 or not self.held[at + 1]):  # up to where a right neighbour holds some
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.held[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(histogram: dict[int, int], window: int) -> np.ndarray:
    """Runs (length, first, count, sequence, offset) that pack histogram[length] pieces of each length: the piece numbers
    first..first+count-1 of a length lie at `offset` of the windows sequence..sequence+count-1.

    Pieces go by falling length, each into the window with the least room that holds it, else into a new one. As a window
    that has just taken a piece is the tightest for the next of that length, windows of equal room are filled together,
    layer by layer: the time depends on the number of lengths, not of pieces.
    """
    tree, windows, runs, opened = RoomTree(window), {}, [], 0
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= window:
            raise ValueError("pieces are longer than nothing and at most as long as a window")
        done, left = 0, histogram[length]

        def fill(sequence: int, count: int, room: int, layers: int, length: int = length) -> None:
            """The next pieces into so many windows, so many layers each."""
            nonlocal done, left
            runs.extend((length, done + k * count, count, sequence, window - room + k * length) for k in range(layers))
            done, left = done + layers * count, left - layers * count
            rest = room - layers * length
            if rest:
                windows.setdefault(rest, []).append((sequence, count))
                tree.set(rest, True)

        while left and (room := tree.tightest(length)) is not None:
            layers = room // length
            sequence, count = windows[room].pop()
            if not windows[room]:
                tree.set(room, False)
            whole = min(count, left // layers)
            if whole:
                fill(sequence, whole, room, layers)
            if whole < count:
                some = left if left < layers else 0  # fewer than fill a window: all into one
                if some:
                    fill(sequence + whole, 1, room, some)
                spare = count - whole - (some > 0)
                if spare:
                    windows.setdefault(room, []).append((sequence + count - spare, spare))
                    tree.set(room, True)
        if left:
            layers = window // length
            whole = left // layers
            if whole:
                fill(opened, whole, window, layers)
                opened += whole
            if left:
                fill(opened, 1, window, left)
                opened += 1
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def _placed(runs, width: int):
    """Sequence and offset of pieces from their length and number."""

    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        of, first, _, sequence, offset = runs.value.T
        size, nth = length.to_numpy(zero_copy_only=False).astype(np.int64), number.to_numpy(zero_copy_only=False)
        at = np.searchsorted(of * width + first, size * width + nth, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence[at] + nth - first[at]), pa.array(offset[at])], ["sequence", "offset"])

    return place


def _widened(ids: pa.Array, width: pa.Array) -> pa.Array:
    """Binary ids of 2 or 4 bytes as lists."""
    each = [np.frombuffer(r, "<u2" if w == 2 else "<u4") for r, w in zip(ids.to_pylist(), width.to_pylist(), strict=True)]
    offsets = np.cumsum([0, *map(len, each)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *each]).astype(np.int32)))


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all texts, packed: key, start (the document's ids before the piece), length, ids, doc_tokens, sequence_id
    and offset in the sequence; sequences hold at most `window` ids, without gaps.

    tokenizer: a file, on the driver, of a tokenizer that white space always splits. Each text's ids are followed by the id
    `end`, so that a null or empty text is a piece of one id. Texts of more than `window` ids are cut into full windows
    and a rest. Repeated rows and null keys are documents of their own; an empty table has no pieces. Words of any length
    are encoded whole, and a long text takes memory in proportion to itself. Reruns on the same files pack alike.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary file, of a few MB
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "task int, key long, n long, width int, ids binary, full long, rest long, lengths array<int>, counts array<long>"
    coded = Staged(rows.mapInArrow(lambda b: _encoded(content, end, window, b), schema), "packed-ids").df
    tallies = coded.filter("lengths IS NOT NULL").select("task", F.explode(F.arrays_zip("lengths", "counts")).alias("x"))
    tallies = Staged(tallies.select(F.col("task").alias("of"), F.col("x.lengths").alias("size"), F.col("x.counts").alias("many")), "lengths").df
    histogram = {r["size"]: r["n"] for r in tallies.groupBy("size").agg(F.sum("many").alias("n")).collect()}  # window rows at most
    runs = spark.sparkContext.broadcast(best_fit_decreasing(histogram, window))
    earlier = Window.partitionBy("size").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # over tasks, not pieces
    base = tallies.select("of", "size", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("base"))

    wide = F.lit(window).cast("long")
    whole = F.floor(F.col("n") / wide).cast("int")
    full = F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.struct((i * wide).alias("start"), wide.alias("length"), (F.col("full") + i).alias("nth")))
    none = F.filter(full, lambda p: F.lit(False))
    rest = F.when(F.col("n") % wide > 0, F.array(F.struct((whole * wide).alias("start"), (F.col("n") % wide).alias("length"), F.col("rest").alias("nth")))).otherwise(none)
    pieces = coded.filter("n IS NOT NULL").select("task", "key", "n", "width", "ids", F.explode(F.concat(F.when(whole > 0, full).otherwise(none), rest)).alias("p"))
    cut = F.substring(F.col("ids"), (F.col("p.start") * F.col("width") + 1).cast("int"), (F.col("p.length") * F.col("width")).cast("int"))
    pieces = pieces.select("task", "key", "n", "width", "p.*", cut.alias("ids"))
    met = pieces.join(base, (F.col("task") == F.col("of")) & (F.col("length") == F.col("size")))
    width = max(histogram.values(), default=0) + 1
    place = F.arrow_udf(_placed(runs, width), "struct<sequence:long,offset:long>")(F.col("length"), F.col("base") + F.col("nth"))
    out = met.select("key", "start", "length", F.arrow_udf(_widened, "array<int>")("ids", "width").alias("ids"), F.col("n").alias("doc_tokens"), place.alias("at"))
    return out.select(F.col("key").alias(key), "start", "length", "ids", "doc_tokens", F.col("at.sequence").alias("sequence_id"), F.col("at.offset").alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and begins (offsets at which pieces begin) of the sequences that pack()'s pieces make up."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("x")).select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.offset").alias("begins"))


def _crc32(ids: pa.Array) -> pa.Array:
    flat = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
    ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return pa.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else [], pa.int64())


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.arrow_udf(_crc32, "long")("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
