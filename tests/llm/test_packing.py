"""Best-fit decreasing by histogram against piece by piece, packed texts against the library's ids."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "don't STOP's 'RE  café é ẞ Σας ΑΣ İstanbul <|endoftext|>x <|startoftext|> a<|endoftext|>b", "a\x1cb\x85c d e",
    "x" * 5000, "12ab''s's", "́a é", " ́z", "​foo﻿", "한국어 日本語", "\t\n \x0b", "Same words here", "Same words here",
]


def one_by_one(histogram, window):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            best = min((i for i in range(len(rooms)) if rooms[i] >= length), key=lambda i: rooms[i], default=None)
            if best is None:
                rooms.append(window - length)
            else:
                rooms[best] -= length
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda w: st.tuples(st.just(w), st.dictionaries(st.integers(1, w), st.integers(0, 9), max_size=12))))
def test_runs_are_best_fit_decreasing(case):
    window, histogram = case
    taken, held = set(), Counter()
    for length, first, count, sequence, offset in packing.best_fit_decreasing(histogram, window).tolist():
        for k in range(count):
            held[length, first + k] += 1
            cells = {(sequence + k, offset + x) for x in range(length)}
            assert not cells & taken
            taken |= cells
    assert held == Counter({(size, i): 1 for size, n in histogram.items() for i in range(n)})
    fill = Counter(s for s, _ in taken)
    assert sorted(window - n for n in fill.values()) == one_by_one(histogram, window)
    assert all((s, x) in taken for s, n in fill.items() for x in range(n)) and set(fill) == set(range(len(fill)))


def test_many_pieces_cost_no_more():
    rng = np.random.default_rng(0)
    runs = packing.best_fit_decreasing({k: int(n) for k, n in enumerate(rng.integers(0, 1 << 40, 4097)) if k}, 4096)
    assert len(runs) < 20_000


def check(rows, pieces, window):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = Counter((key, tuple(library.encode(text or "", add_special_tokens=False).ids) + (2,)) for key, text in rows)
    of, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p["doc_id"], p["doc_tokens"]].append(p)
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        assert len(p["ids"]) == p["length"] and 0 < p["length"] <= window
    if len({k for k, _ in rows}) == len(rows):
        got = Counter()
        for (key, n), parts in of.items():
            parts.sort(key=lambda p: p["start"])
            ids = tuple(i for p in parts for i in p["ids"])
            assert len(ids) == n and [p["start"] for p in parts] == [sum(q["length"] for q in parts[:i]) for i in range(len(parts))]
            got[key, ids] += 1
        assert got == want
    histogram = Counter(p["length"] for p in pieces)
    assert sum(n * k for k, n in histogram.items()) == sum(len(ids) * n for (_, ids), n in want.items())
    rooms = []
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        rooms.append(window - at)
    assert sorted(rooms) == one_by_one(histogram, window)


@pytest.mark.parametrize("window", [7, 64, 4096])
def test_packs_every_id_once(spark, window):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(f"w{j * i}" for j in range(i))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("key", F.lit(1)).repartition(5)
    check(rows, packing.pack(docs, PATH, window).collect(), window)


def test_repeated_rows_null_keys_and_a_long_text(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "c d"), (3, "c d"), (4, "long words " * 300_000), (5, "y" * 200_000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    check(rows, pieces, 4096)
    long = [p for p in pieces if p["doc_id"] == 4]
    assert {p["doc_tokens"] for p in long} == {600_001} and len(long) == 147 and sum(p["doc_id"] is None for p in pieces) == 2


def test_empty_table_and_sequences(spark):
    empty = packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert empty.count() == 0 and packing.sequences(empty).count() == 0
    pieces = packing.pack(spark.createDataFrame([(i, "a b c") for i in range(10)], "doc_id long, text string"), PATH, 9)
    made = packing.sequences(pieces).collect()
    assert len(made) == 5 and all(len(s["ids"]) == 8 and s["begins"] == [0, 4] and s["ids"][3] == 2 for s in made)


def test_query(spark):
    got = packing.op11_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    spans = Counter()
    for r in got:
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        spans[r["doc_id"]] += r["length"]
    assert set(spans) == set(texts)
