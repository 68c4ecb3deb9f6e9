"""Alignment against comparing every two tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  two  spaces\n\n and\ttabs ", "café naïve ß 日本語 한국어 🙂👩‍👩‍👧", "▁ looks like a space", "<|endoftext|> plain <s> </s> <unk> <0x41>",
    "don't we'll non breaking", "x" * 3000, "a\x00b\x1f", "Same text here.", "Same text here.", "́combining", "1234567890 3.14", "ﬁ ligature ①",
]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(61, 64))
def test_cuts_are_the_common_ends(a, b, last):
    a, b = np.array(sorted(a) + [last]), np.array(sorted(b) + [last])
    assert np.array_equal(alignment.shared_cuts(a, b), np.isin(a, b))


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in enumerate(alignment.Encoder.__init__.__globals__["byte_letters"]())}

    def piece(i):
        name = second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode()

    out, linked = [], []
    for key, text in rows:
        ids_a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = second.encode(text or "")
        spelt_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in ids_a]
        spelt_b = [piece(i) for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
            ids_a, ids_b, spelt_a, spelt_b = [], [], [], []
        ends_a, ends_b = np.cumsum([0, *map(len, spelt_a)]).tolist(), np.cumsum([0, *map(len, spelt_b)]).tolist()
        links, j0 = Counter(), 0
        for i in range(len(ids_a)):
            while ends_b[j0 + 1] <= ends_a[i]:
                j0 += 1
            j = j0
            while j < len(ids_b) and ends_b[j] < ends_a[i + 1]:
                links[ids_a[i], ids_b[j]] += 1
                j += 1
        both = sorted(set(ends_a[1:]) & set(ends_b[1:]))
        groups, i, j = [], 0, 0
        for cut in both:
            u, v = ends_a.index(cut), ends_b.index(cut)
            groups.append(",".join(map(str, ids_a[i:u])) + "|" + ",".join(map(str, ids_b[j:v])))
            i, j = u, v
        out.append([key, len(ids_a), len(ids_b), len(groups), sum(links.values()), ";".join(groups)])
        linked.append(links)
    count = Counter(p for links in linked for p in links)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for row, links in zip(out, linked, strict=True):
        row += [sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items())]
    return sorted(map(tuple, out), key=str), count, most


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_equals_comparing_all_tokens(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "PAIRS", 1 << 20 if block > 40 else 30)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null key"), (3, "again"), (3, "again")] + [(1000 + r["doc_id"], r["text"]) for r in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)
    got, pairs = alignment.align(frame, A, B)
    want, count, most = brute(rows)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == want
    assert {(r["a"], r["b"]): (r["count"], r["best"]) for r in pairs.collect()} == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_empty_table_and_a_long_text(spark):
    docs, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert docs.count() == 0 and pairs.count() == 0
    rows = [(1, "some words, " * 250_000), (2, None)]
    got = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B, digest=True)[0].collect()}
    assert got[1]["n_a"] == 750_001 and got[1]["n_links"] >= got[1]["n_b"] and got[2]["n_a"] == 0 and got[2]["groups"] == ""


def test_query(spark):
    want, _, _ = brute([(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
    got = alignment.op13_shared_cuts(spark, "/root/testdata/sf0.001").withColumnRenamed("groups_sha256", "groups").select(*COLUMNS).collect()
    hashed = [(*w[:5], hashlib.sha256(w[5].encode()).hexdigest() if w[5] else "", *w[6:]) for w in want]
    assert sorted(map(tuple, got), key=str) == sorted(hashed, key=str)
