"""Neighbour search against brute force on whole tables, and what it defines of odd rows."""

import numpy as np
import pytest

from tallyspark.llm import neighbours


def recall(found, ids, vectors, every):
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    best, hits, all_ = {}, 0, 0
    for r in found:
        best.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = np.flatnonzero(ids % every == 0)
    assert set(best) == set(ids[queries].tolist())
    for q in queries.tolist():
        d = neighbours.distances(vectors[q], vectors)
        d[q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        mine = sorted(best[int(ids[q])])
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        at = {int(i): k for k, i in enumerate(ids.tolist())}
        assert all(s == d[at[v]] for _, v, s in mine) and [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits, all_ = hits + len({v for _, v, _ in mine} & set(want)), all_ + len(want)
    return hits / all_


@pytest.mark.parametrize("copies", [0, 400])
def test_recall_on_a_whole_table(spark, copies):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = frame.collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    if copies:
        ids, vectors = np.concatenate([ids, ids.max() + 1 + np.arange(copies)]), np.concatenate([vectors, np.repeat(vectors[:1], copies, axis=0)])
        frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    assert recall(neighbours.nearest(frame).collect(), ids, vectors, 100) >= 0.9


def test_steps_come_in_the_order_of_their_cost():
    rng = np.random.default_rng(1)
    for f in (1, 3, 5):
        part = rng.random(f).tolist()
        got = neighbours.steps(part, 10_000).tolist()
        cost = lambda s: sum((x if k < 0 else 1 - x) ** 2 * abs(k) for x, k in zip(part, s, strict=True))
        assert len(got) == len({tuple(s) for s in got}) == 3**f and not any(got[0])
        assert all(cost(a) <= cost(b) + 1e-12 for a, b in zip(got, got[1:], strict=False))


def test_keys_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [5.0, 5.0]), (100, [1.0, 1.0]), (1, [1.0, 0.5]), (1, [9.0, 9.0]), (2, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    first = sorted(map(tuple, neighbours.nearest(frame).collect()))
    assert first == sorted(map(tuple, neighbours.nearest(frame.repartition(3)).collect()))
    assert [(q, v) for q, _, v, _ in first if q == 100] != [] and len({(q, v) for q, _, v, _ in first}) == len(first) == 6


def test_blocks_of_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 4))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert recall(neighbours.nearest(frame, every=10).collect(), np.arange(300), v, 10) >= 0.9
