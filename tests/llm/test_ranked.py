"""Best positions against scoring everything."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def scored(docs, items, k=50):
    tf = [(key, Counter(terms(t))) for key, t in docs]
    n, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        found = []
        for key, c in tf:
            m = 50 + 50 * sum(c.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if s > 0:
                found.append((-s, key is None, key))
        out += [(item, r + 1, key, -s) for r, (s, _, key) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=lambda x: (str(x[0]), x[1]))


def got(frame):
    return sorted(map(tuple, frame.collect()), key=lambda x: (str(x[0]), x[1]))


def texts(rng, n, words=40):
    return [" ".join(f"t{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.choice([0, 1, 5, 30, 200]))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_scoring_everything(spark, monkeypatch, seed):
    rng = random.Random(seed)
    docs = list(enumerate(texts(rng, 300))) + [(7, "T1 t2"), (7, "T1 t2"), (None, "t1 t2"), (None, None), (900, "")]
    items = list(enumerate(texts(rng, 20))) + [(50, None), (51, "!?"), (52, "nowhere"), (53, "t3"), (53, "t4 t3"), (None, "t5")]
    frame = spark.createDataFrame(docs, DOCS).withColumn("key", F.lit("x")).withColumn("m", F.lit(0)).repartition(3)
    want = scored(docs, items)
    assert got(ranked.search(frame, spark.createDataFrame(items, ITEMS))) == want
    monkeypatch.setattr(ranked, "ITEM_BYTES", 100)
    monkeypatch.setattr(ranked, "SHARD", 50)
    assert got(ranked.search(frame, spark.createDataFrame(items, ITEMS))) == want


def made(docs, k, items, shards, step=4):
    """best() over shards, with how many documents each met."""
    tf = [Counter(terms(t)) for t in docs]
    words = sorted({w for c in tf for w in c})
    number = {w: i for i, w in enumerate(words)}
    n, total = sum(map(bool, tf)), sum(sum(c.values()) for c in tf)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * sum(w in c for c in tf) + 1))) for w in words], np.int64)
    met = []
    for item in items:
        own = np.array([number[w] for w in set(terms(item)) if w in number], np.int64)
        scores, keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for some in np.array_split(np.arange(len(docs)), shards):
            rows = [sorted((number[w], x) for w, x in tf[i].items()) for i in some]
            flat = np.array([p for r in rows for p in r], np.int64).reshape(-1, 2)
            m = np.array([50 + 50 * sum(tf[i].values()) * n // total for i in some], np.int64)
            shard = ranked.Shard(weight, some.astype(np.int64), m, np.array([len(r) for r in rows], np.int64), flat[:, 0], flat[:, 1])
            count, direct = [0], shard.direct
            shard.direct = lambda d, c=count, f=direct: (c.__setitem__(0, c[0] + len(d)), f(d))[1]
            scores, keys = shard.best(own, k, scores, keys)
            assert not shard.seen.any() and not shard.met.any() and not shard.wanted.any()
            met.append(count[0])
        yield keys.tolist(), scores.tolist(), met


def test_stops_early_and_right(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(ranked, "STEP", 4)
    docs = [" ".join(rng.choices([f"c{i}" for i in range(200)], k=30)) for _ in range(3000)]
    docs[1234] = docs[2500] = " ".join(f"c{i}" for i in range(20)) + " rare"
    items = [" ".join(f"c{i}" for i in range(20)) + " rare"]
    want = [(key, s) for _, _, key, s in scored(list(enumerate(docs)), [(0, items[0])], 2)]
    for shards in (1, 4):
        ((keys, scores, met),) = made(docs, 2, items, shards)
        assert list(zip(keys, scores, strict=True)) == want
        assert met[-1] < 400 if shards > 1 else met[0] < 2000


def test_ties_at_the_kth_go_by_key(spark):
    docs = [(i, "alpha beta") for i in range(200, 0, -1)] + [(1000, "gamma")]
    rows = got(ranked.search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame([(1, "alpha")], ITEMS), k=5))
    assert [r[2] for r in rows] == [1, 2, 3, 4, 5] and [r[1] for r in rows] == [1, 2, 3, 4, 5]


def test_empty_tables_and_a_long_text(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b " * 400_000 + "c"), (2, "c")], DOCS)
    items = spark.createDataFrame([(1, "c"), (2, "a")], ITEMS)
    assert ranked.search(none, items).count() == 0 and ranked.search(some, spark.createDataFrame([], ITEMS)).count() == 0
    assert [r[:3] for r in got(ranked.search(some, items))] == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
        want = sorted(db.execute(f"SELECT item_id, rank, doc_id, score FROM ({ranked.ORACLE})").fetchall())
    assert sorted(map(tuple, ranked.op12_best_positions(spark, sf).select("item_id", "rank", "doc_id", "score").collect())) == want
