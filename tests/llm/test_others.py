"""Vectors, pages and the pipeline."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import neighbours, warc


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(1, 8)), 100, axis=0)])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20).collect()
    hits = 0
    for q in range(0, 1000, 20):
        d = neighbours.distances(v[q], v)
        d[q] = np.inf
        best = np.lexsort((np.arange(1000), d))[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == d[m[1]] for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & set(best.tolist()))
    assert hits >= 0.9 * 500


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [3.0]), (None, [4.0, 4.0]), (200, [inf, 1.0]), (7, [1.5, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.nearest(frame).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 7, 0.5), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 7, 0.5)]
    assert neighbours.nearest(frame.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a b", None), (2, None, ""), (3, "u", "é"), (3, "u", "é"), (None, "u", "x"), (5, "u", "x\r\nWARC/1.1\r\n\r\n"), (9, "u", "é")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(frame, f"{tmp_path}/w")
    got = warc.transactions(warc.read_warc(spark, f"{tmp_path}/w"))
    mine = [(r["type"], r["payload_bytes"] if r["type"] == "response" else None, r["payload_digest"]) for r in got.collect()]
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        last = max((x for x in groups[h or ""] if x is not None), default=None)
        response = i == last or len(groups[h or ""]) == 1
        want.append(("response" if response else "revisit", len(body) if response else None, "sha1:" + warc.digest(body)))
    assert Counter(mine) == Counter(want)
    assert got.filter("request IS NULL OR metadata IS NULL").count() == 0
    plain = warc.record("metadata", "urn:x", b"a: b\r\n", WARC_Concurrent_To="<urn:y>")
    assert [(h["warc-type"], b) for h, b in warc.records(plain)] == [("metadata", b"a: b\r\n")]


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, sizes = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        sizes.append(out.count())
        if k < 4:
            assert out.columns == columns
        docs = out
    assert sizes[0] >= sizes[1] == sizes[2] and sizes[3] == sizes[4] > 0
