"""Clashing columns, empty tables, nulls, repeated rows, and whole queries against brute force."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, graph, language, mixing, neighbours, quality, repeats, secrets, similar, simhash, tokenfiles, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string"
NAMES = ["row", "key", "k", "all", "rows", "n", "i", "__n", "__k", "__strong", "__all", "__d", "__linked", "__assign", "id", "d1", "d2", "group", "stays", "s0", "host", "k1", "g1", "node", "fp", "size", "copies", "sk"]


def wide(spark, rows):
    return spark.createDataFrame([(*r, *NAMES) for r in rows], SCHEMA + "".join(f", `{n}` string" for n in NAMES))


def test_clashing_columns_stay(spark):
    prose = " ".join(f"word{k}" for k in range(40))
    rows = [(1, prose, "s"), (2, prose, "s"), (3, 'password = "abcdefgh1234" ' + prose[::-1], None), (None, None, "s"), (4, "", "t")]
    frame = wide(spark, rows)
    for out in (mixing.mixed_rows(frame), similar.keep_one(frame), secrets.redact_secrets(frame), quality.pass_quality(frame)):
        got = out.collect()
        assert out.columns == frame.columns and got and all(tuple(r)[3:] == tuple(NAMES) for r in got)
    texts = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(frame).collect()}
    assert texts[3].startswith("[SECRET]") and texts[None] is None and texts[4] == ""
    assert sorted(str(r["doc_id"]) for r in similar.keep_one(frame).collect()) == ["1", "3", "4"]
    clash = frame.select(F.col("doc_id").alias("key"), F.col("text").alias("row"), F.col("source").alias("k"))
    assert secrets.scan_secrets(clash, "key", "row").count() == 5 and mixing.mixed_rows(clash, key="key", size=mixing.words("row"), source="k").count() > 0


@pytest.mark.parametrize("n", range(10))
def test_empty_tables(spark, tmp_path, n):
    docs = spark.createDataFrame([], SCHEMA)

    def files():
        tokenfiles.write_token_files(docs, f"{tmp_path}/t", PATH)
        return tokenfiles.read_token_files(spark, f"{tmp_path}/t") if list((tmp_path / "t").glob("*.tok")) else docs

    def archives():
        warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
        return warc.transactions(warc.read_warc(spark, f"{tmp_path}/w")) if list((tmp_path / "w").glob("*.warc.gz")) else docs

    made = [
        lambda: mixing.mix(docs, mixing.words()), lambda: simhash.near_duplicates(docs), lambda: quality.line_verdicts(docs), lambda: language.lm_scores(docs), files,
        lambda: neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")), archives, lambda: repeats.remove_repeats(docs),
        lambda: bpe.token_digests(docs, PATH), lambda: secrets.scan_secrets(docs),
    ]
    assert made[n]().count() == 0


def test_pipeline_of_an_empty_table(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_targets_by_filling_up(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60) * (1 + 9 * (i % 4 == 0)))), f"s{i % 9 if i % 5 else 0}") for i in range(900)] + [(5000, "a " * 50, None), (5001, None, "s1"), (7, "b " * 9, "s2")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:  # fill those that would exceed their bound, and share out the rest again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in over or open_:
            goal[s] = min(2.0 * sizes[s], weight[s] * level)
        left -= sum(goal[s] for s in over)
        open_ = open_ - over if over else set()
    got = mixing.op1_entropy_balanced_mix(spark, str(tmp_path)).collect()
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    # Whole documents: no source is off by more than half of its longest one.
    longest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in order}
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1 for s in order)


def test_archives_against_brute_force(spark, tmp_path):
    rows = [(1, "http://a b", None), (2, None, ""), (3, "u", "é"), (3, "u", "é"), (None, "u", "x"), (5, "u", "x\r\nWARC/1.1\r\n\r\n"), (9, "u", "é"), (10, "v", "x"), (12, "u", "y" * 3_000_000), (11, "u", "y" * 3_000_000)]
    rows += [(100 + i, "w", "much copied") for i in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    last = defaultdict(lambda: -1)
    for i, _, h in rows:
        last[h or ""] = max(last[h or ""], -1 if i is None else i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = i != last[h or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None, True))
    got = [tuple(r) for r in warc.op7_warc_transactions(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want)


def test_least_bytes_of_revisits(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w", least=3)
    got = warc.transactions(warc.read_warc(spark, f"{tmp_path}/w"))
    assert Counter(r["type"] for r in got.collect()) == {"response": 3, "revisit": 1}


def test_equal_hashes_of_different_strings(monkeypatch):
    data = np.frombuffer(b"abcdefabcdefabcxef" * 3, np.uint8)
    starts = np.arange(len(data) - 5)
    ids = (starts // 18).astype(np.int64)
    want = [any(data[s : s + 6].tobytes() == data[r : r + 6].tobytes() and ids[r] < ids[s] for r in starts) for s in starts]
    for keys in (repeats.Hashes(data).of(starts, 6), np.zeros(len(starts), np.uint64)):
        assert repeats.later(keys, ids, data, starts, 6).tolist() == want


@pytest.mark.parametrize("crowd", [32768, 3])
def test_components_of_crowded_nodes(spark, crowd):
    edges = [(1, k) for k in range(2, 40)] + [(k, k + 1) for k in range(100, 120)] + [(39, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), crowd=crowd).collect()}
    assert got == {k: 1 for k in [*range(1, 40), 200]} | {k: 100 for k in range(100, 121)}


def test_null_keys_come_last_in_repeats(spark):
    text = "".join(chr(97 + k % 26) for k in range(70))
    rows = [(None, text), (5, text), (9, text)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {None: 70, 5: 0, 9: 70}
