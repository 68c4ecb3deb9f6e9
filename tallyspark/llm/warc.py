"""WARC archives: writing, reading, and assembling transactions.

A capture is written as a request, a response (or a revisit, if an equal payload is stored elsewhere) and a metadata
record; request and metadata name the capture's record in WARC-Concurrent-To. Reading joins them by that identifier
into one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Folder, Staged, made_dir, shared_dir, ship, small, table
from tallyspark.llm.tokenfiles import _file_system

#: Compressed bytes at which an archive ends, and parsed bytes at which a batch of records does.
FILE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20

# Fixed values of the format.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, content: bytes, **headers: str | None) -> bytes:
    """One record; underscores in header names stand for hyphens."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(content)}", "", ""]).encode() + content + b"\r\n\r\n"


def capture(page: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool, salt: str) -> list[bytes]:
    """The three records of a capture."""
    name = lambda what, p: uuid.uuid5(uuid.NAMESPACE_URL, f"{what}/{p}{salt if p == page else ''}").urn
    uri = "".join(c for c in url or "about:blank" if c > " ")
    own = name("capture", page)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shared = {"WARC_Target_URI": uri}
    if revisit:
        main = record(
            "revisit", own, http, **shared, WARC_Payload_Digest=f"sha1:{digest(payload)}", WARC_Profile=PROFILE,
            WARC_Refers_To=f"<{name('capture', refers)}>", Content_Type="application/http;msgtype=response",
        )
    else:
        main = record("response", own, http + payload, **shared, WARC_Payload_Digest=f"sha1:{digest(payload)}", Content_Type="application/http;msgtype=response")
    ask = record(
        "request", name("request", page), f"GET {uri} HTTP/1.1\r\n\r\n".encode(), **shared,
        WARC_Concurrent_To=f"<{own}>", Content_Type="application/http;msgtype=request",
    )
    fields = {"pageId": page}
    about = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode()
    more = record("metadata", name("metadata", page), about, **shared, WARC_Concurrent_To=f"<{own}>", Content_Type="application/warc-fields")
    return [ask, main, more]


def _written(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, folder = _file_system(path)
    task = TaskContext.get()
    names: list[str] = []
    out, size, nth = None, 0, 0

    def close() -> None:
        nonlocal out, size
        if out is not None:
            out.close()
            names.append(f"{folder}/part-{task.partitionId():07d}-{len(names):05d}.warc.gz")
            store.move(f"{folder}/.try-{task.taskAttemptId()}", names[-1])  # a repeated task replaces the file
            out, size = None, 0

    def zipped(data: bytes) -> bytes:
        z = zlib.compressobj(3, zlib.DEFLATED, 31)  # a member for each record, as archives have it
        return z.compress(data) + z.flush()

    for batch in batches:
        for page, url, html, last, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if out is None:
                out = store.open_output_stream(f"{folder}/.try-{task.taskAttemptId()}")
                size += out.write(zipped(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"software: tallyspark\r\n", Content_Type="application/warc-fields"))) or 0
            revisit = bool(copies) and last is not None and page != last
            nth += 1
            # Rows that repeat a page have names of their own; the row that others refer to has the plain one.
            salt = "" if not copies or page == last else f"/{task.partitionId()}-{nth}"
            for data in map(zipped, capture(page, url, html or b"", last, revisit, salt)):
                out.write(data)
                size += len(data)
            if size >= FILE_BYTES:
                close()
    close()
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write a capture for every row of pages to archives under path, a folder that executors share.

    Of the rows whose payloads (UTF-8; a null is empty) are equal and have at least `least` bytes, those with the
    largest key hold the payload and all others revisit it; a null key counts as the smallest.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    long_enough = F.octet_length("html") >= least
    digests = rows.filter(long_enough).select(F.sha1("html").alias("d"), "page")
    twice = Staged(digests.groupBy("d").agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("d", "last"), "payloads").df
    joined = rows.join(small(twice, twice.count(), 200_000), long_enough & (F.sha1("html") == F.col("d")), "left")
    dealt = joined.select("page", "url", F.col("html").cast("binary").alias("html"), "last", F.col("d").isNotNull().alias("copies"))
    path = made_dir(spark, path)
    dealt.mapInArrow(lambda b: _written(path, b), "file string").write.format("noop").mode("overwrite").save()


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, content) of each record of an archive, compressed or not."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


_FIELDS = {
    "record_id": "string", "type": "string", "concurrent_to": "string", "uri": "string", "date": "string",
    "payload_digest": "string", "refers_to": "string", "payload_bytes": "long", "payload_sha1": "string", "content": "binary",
}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string() for t in _FIELDS.values()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(_FIELDS))

    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for h, body in records(content.as_py()):
                head, gap, payload = body.partition(b"\r\n\r\n")
                http = gap and h.get("content-type", "").startswith("application/http")
                body_of = payload if http else body
                name = lambda k, h=h: h[k].strip("<>") if k in h else None
                rows.append((
                    name("warc-record-id"), h.get("warc-type"), name("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"),
                    h.get("warc-payload-digest"), name("warc-refers-to"), len(body_of), digest(body_of), body,
                ))
                size += len(body) + 300
                if size >= BATCH_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under path: identifiers, headers and content."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("content")
    return files.mapInArrow(_parsed, ", ".join(f"{k} {t}" for k, t in _FIELDS.items()))


def transactions(read: DataFrame) -> DataFrame:
    """One row per capture: its record (response or revisit), and as structs its request and its metadata, null where
    there is none. Of several, that with the smallest record id is taken; n_requests and n_metadata count them."""

    def side(kind: str) -> DataFrame:
        rest = F.struct("record_id", "uri", "date", "content")
        return (
            read.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
            .groupBy(F.col("concurrent_to").alias(f"{kind}_of"))
            .agg(F.min(rest).alias(kind), F.count(F.lit(1)).alias(f"{kind}_n"))
        )

    main = read.filter(F.col("type").isin("response", "revisit")).drop("concurrent_to")
    joined = main.join(side("request"), F.col("record_id") == F.col("request_of"), "left")
    joined = joined.join(side("metadata"), F.col("record_id") == F.col("metadata_of"), "left")
    counts = {f"n_{n}": F.coalesce(f"{k}_n", F.lit(0)) for k, n in (("request", "requests"), ("metadata", "metadata"))}
    return joined.withColumns(counts).drop("request_of", "metadata_of", "request_n", "metadata_n")


def field(metadata: str, name: str) -> F.Column:
    """A field of application/warc-fields content."""
    got = F.regexp_extract(F.col(f"{metadata}.content").cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(got != "", got)


def with_payloads(captures: DataFrame) -> DataFrame:
    """transactions() with full_bytes and full_sha1: those of the payload itself, computed from what was read. A revisit
    has them from the response that it refers to, with that one's row as `original` (null where there is none)."""
    first = captures.filter(F.col("type") == "response").select(F.col("record_id").alias("r_"), F.struct("payload_bytes", "payload_sha1", "metadata").alias("original"))
    first = first.dropDuplicates(["r_"])  # repeated rows of a page have one name
    both = captures.join(first, (F.col("type") == "revisit") & (F.col("refers_to") == F.col("r_")), "left").drop("r_")
    own = F.col("type") == "response"
    return both.withColumns({
        "full_bytes": F.when(own, F.col("payload_bytes")).otherwise(F.col("original.payload_bytes")),
        "full_sha1": F.when(own, F.col("payload_sha1")).otherwise(F.col("original.payload_sha1")),
    })


def op7_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and assembled. digest_agrees: whether the header's digest is the payload's."""
    path = Folder(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").path
    write_warc(table(spark, sf_dir, "pages"), path)
    read = Staged(read_warc(spark, path).withColumn("content", F.when(F.col("type") == "metadata", F.col("content"))), "records").df
    rows = with_payloads(transactions(read))
    return rows.select(
        field("metadata", "pageId").cast("long").alias("page_id"),
        F.col("full_bytes").alias("payload_bytes"),
        F.col("full_sha1").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", field("original.metadata", "pageId")).cast("long").alias("refers_to"),
        (F.col("payload_digest") == F.concat(F.lit("sha1:"), F.col("full_sha1"))).alias("digest_agrees"),
    )
