"""Token ids in binary files: frequency ranks in byte-aligned variable length, with control bytes apart from the data.

A rank takes 1 to 4 little-endian bytes. Four ranks share a control byte of 2-bit lengths (less one). A file is a head
(magic, number of ids in the rank table, the table itself) and blocks of whole documents; a block has its numbers of
documents, ids and data bytes, the documents' keys, whether each key is null, their numbers of ids, the control bytes
and the data.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.bpe import encoder
from tallyspark.llm.common import Folder, Staged, made_dir, shared_dir, ship, small, table

MAGIC = b"TLYTOK1\n"
#: Ids of a block (more only where one document has more), encoded bytes at which a file ends, ids for one writing task.
BLOCK_IDS = 1 << 20
FILE_BYTES = 32 << 20
TASK_IDS = 16 << 20

_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int64) + 1
_KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of an array of ranks."""
    r = ranks.astype("<u4")
    long = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = long - 1
    control = (codes.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1, dtype=np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < long[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control bytes and data, by looking lengths up in a table."""
    long = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(long) - long
    padded = bytes(data) + b"\0\0\0"
    four = np.ndarray(len(data), "<u4", padded, strides=(1,))  # the four bytes from each byte on
    return four[at] & _KEEP[long]


def block(keys: np.ndarray, null: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = np.array([len(keys), len(ranks), len(data)], "<u8").tobytes()
    known = keys.astype("<i8").tobytes() + null.astype(np.uint8).tobytes()
    return head + known + sizes.astype("<u4").tobytes() + control + data


def blocks(content) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, which are null, numbers of ids, ids) of each block of a file's bytes."""
    content = memoryview(content)
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC) + 8
    n = int(np.frombuffer(content, "<u8", 1, len(MAGIC))[0])
    by_rank = np.frombuffer(content, "<u4", n, at)
    at += 4 * n
    while at < len(content):
        docs, ids, size = (int(x) for x in np.frombuffer(content, "<u8", 3, at))
        at += 24
        keys = np.frombuffer(content, "<i8", docs, at)
        null = np.frombuffer(content, np.uint8, docs, at + 8 * docs) > 0
        sizes = np.frombuffer(content, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        mid = at + -(-ids // 4)
        ranks = unpack(content[at:mid], content[mid : mid + size], ids)
        at = mid + size
        yield keys, null, sizes.astype(np.int64), by_rank[ranks]


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), urlparse(path).path
    return pa.fs.FileSystem.from_uri(path)


def _encoded(content, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of every text, and in a last row how often the task met each id."""
    own = encoder(content.value, True)
    most = max(len(own.tokens.pieces[2]), end + 1)
    kind = np.dtype("<u2" if most <= 1 << 16 else "<u4")
    tally = np.zeros(most, np.int64)
    names = ["key", "n", "width", "ids", "tally"]
    for batch in batches:
        parts, counts = [], np.zeros(len(batch), np.int64)
        for at, ids, each, more in own.batches(batch.column("text").to_pylist()):
            counts[at : at + len(each)] += each
            ends = np.cumsum(each)[: len(each) - more]
            ids = np.insert(ids, ends, end)
            counts[at : at + len(ends)] += 1
            tally += np.bincount(ids, minlength=most)
            parts.append(ids.astype(kind))
        flat = np.concatenate([np.zeros(0, kind), *parts])
        offsets = np.concatenate([[0], np.cumsum(counts) * kind.itemsize]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        width = pa.array(np.full(len(batch), kind.itemsize, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts), width, coded, pa.nulls(len(batch), pa.binary())], names)
    none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
    yield pa.RecordBatch.from_arrays([*none, pa.array([tally.astype("<i8").tobytes()], pa.binary())], names)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    all_ = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column("tally").to_pylist():
            here = np.frombuffer(raw, "<i8")
            all_ = here + (all_ if len(all_) else 0)
    some = np.flatnonzero(all_)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(all_[some], pa.int64())], ["id", "n"])


def _flat(column: pa.Array, width: int) -> np.ndarray:
    """The ids of all rows of a binary column, end to end."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view("<u2" if width == 2 else "<u4")


def _written(path: str, ranking, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes the rows of a task, in their order, to files of its own; tells their names."""
    by_rank = ranking.value
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    store, folder = _file_system(path)
    task = TaskContext.get()
    head = MAGIC + np.array([len(by_rank)], "<u8").tobytes() + by_rank.astype("<u4").tobytes()
    names: list[str] = []
    out, size, held = None, 0, 0
    waiting: list[tuple[np.ndarray, ...]] = []

    def close() -> None:
        nonlocal out, size
        if out is not None:
            out.close()
            name = f"{folder}/part-{task.partitionId():07d}-{len(names):05d}.tok"
            store.move(f"{folder}/.try-{task.taskAttemptId()}", name)  # a repeated task replaces the file by an equal one
            names.append(name)
            out, size = None, 0

    def flush() -> None:
        nonlocal out, size, held
        if waiting:
            if out is None:
                out = store.open_output_stream(f"{folder}/.try-{task.taskAttemptId()}")
                out.write(head)
            data = block(*[np.concatenate(x) for x in zip(*waiting, strict=True)])
            out.write(data)
            size += len(data)
            waiting.clear()
            held = 0
            if size >= FILE_BYTES:
                close()

    for batch in batches:
        if not len(batch):
            continue
        width = batch.column("width")[0].as_py()
        keys, null = batch.column("key").fill_null(0).to_numpy(), batch.column("key").is_null().to_numpy(zero_copy_only=False)
        sizes, ranks = batch.column("n").to_numpy(), rank[_flat(batch.column("ids"), width)]
        ends = np.cumsum(sizes)
        at = 0
        while at < len(keys):
            begin = int(ends[at] - sizes[at])
            stop = int(np.searchsorted(ends, begin + BLOCK_IDS - held, side="right"))
            if stop <= at:
                if held:
                    flush()
                    continue
                stop = at + 1  # a document of more ids than a block
            waiting.append((keys[at:stop], null[at:stop], sizes[at:stop], ranks[begin : int(ends[stop - 1])]))
            held += int(ends[stop - 1]) - begin
            at = stop
    flush()
    close()
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2) -> None:
    """Encode every whole text, append the id `end`, and write the ids in ascending order of key (nulls last) to files
    under path, a folder that executors share. Names sort as the keys do. A null text is empty and leaves only its end
    id; rows that repeat a key stand side by side in no set order. Texts are encoded once; only ids are shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary file, of a few MB
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    coded = Staged(rows.mapInArrow(lambda b: _encoded(content, end, b), "key long, n long, width int, ids binary, tally binary"), "ids")
    tally = coded.df.select("tally").filter("tally IS NOT NULL").mapInArrow(_tallied, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(((-r["n"], r["id"]) for r in tally.collect()))  # a row for each id of the vocabulary at most
    ranking = spark.sparkContext.broadcast(np.array([i for _, i in ranked], np.int64))
    tasks = max(1, -(-int(coded.df.agg(F.sum("n")).first()[0] or 0) // TASK_IDS), spark.sparkContext.defaultParallelism)
    order = F.col("key").asc_nulls_last()
    path = made_dir(spark, path)
    dealt = coded.df.filter("n IS NOT NULL").select("key", "n", "width", "ids").repartitionByRange(tasks, order).sortWithinPartitions(order)
    dealt.mapInArrow(lambda b: _written(path, ranking, b), "file string").write.format("noop").mode("overwrite").save()
    coded.drop()


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "nth", "doc_id", "before", "n_tokens", "ids_crc32"]
    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            before = nth = 0
            for keys, null, sizes, ids in blocks(content.as_buffer()):
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array([file] * len(keys)), np.arange(nth, nth + len(keys)), pa.array(keys, pa.int64(), mask=null), before + ends - sizes, sizes, pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)
                before, nth = before + int(ends[-1]), nth + len(keys)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens and ids_crc32 of each document of the files under path."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select("path", "content")
    rows = files.mapInArrow(_decoded, "file string, nth long, doc_id long, before long, n_tokens long, ids_crc32 long")
    rows = Staged(rows, "decoded").df
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("all"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    base = totals.select("file", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    joined = rows.join(small(base, totals.count()), "file")
    return joined.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_ranked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back."""
    import public_tokenizers

    path = Folder(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").path
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
