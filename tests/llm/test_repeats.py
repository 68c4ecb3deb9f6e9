"""What documents tell each other about repeats grows with the input, not faster."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import repeats

WORDS = "the of and in to a is was for as on with by he that it his at from her an were are which this be had or not but".split()


def common(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n)).encode()


def told(data, least=50):
    return np.unique(repeats.anchors(repeats.Hashes(np.frombuffer(data, np.uint8)), np.array([0, len(data)]), least)[0])


def test_texts_of_common_words_share_few_anchors():
    """op8 fails by time at 6 GB. Texts that share no string of 50 bytes exchanged most of theirs in large inputs."""
    a, b = told(common(1, 60_000)), told(common(2, 60_000))
    assert len(a) > 10_000 and np.isin(a, b).mean() < 0.01
    passage = common(3, 20)
    assert len(passage) >= 50 and np.isin(told(passage), told(common(1, 500) + passage + common(2, 500))).any()


def test_a_task_tells_a_group_once():
    """messages were as many as parts times groups."""
    n = 40
    batch = pa.RecordBatch.from_pydict({"part": pa.array(range(n), pa.int32()), "seq": [*range(n)], "id": [*range(n)], "text": [common(i, 400).decode() for i in range(n)]})
    rows = [r for out in repeats._told(50, 3, iter([batch])) for r in out.to_pylist()]
    assert sorted(r["g"] for r in rows) == [0, 1, 2]


@pytest.mark.parametrize("n,wide", [(5, 5), (300, 7), (70_000, 18), (140_000, 40), (200_000, 70_000)])
def test_least_of_neighbours(n, wide):
    low = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    low[n // 2 :: 3] = low[0]
    got = repeats._first_least(low, wide)
    assert len(got) == n - wide + 1
    for i in [0, 1, len(got) // 2, len(got) - 1, *range(0, len(got), 997), *range(65_500, min(len(got), 65_560))]:
        if i < len(got):
            assert got[i] == i + np.argmin(low[i : i + wide])


@pytest.mark.parametrize("least", [17, 90])
def test_other_lengths_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(repeats, "PART", 400)
    monkeypatch.setattr(repeats, "GROUP", 900)
    rnd = random.Random(least)
    passages = ["".join(rnd.choice("ab é") for _ in range(rnd.randrange(least - 5, least + 60))) for _ in range(8)]
    rows = [(i, "".join(rnd.choice([rnd.choice(passages), common(i + j, 6).decode()]) for j in range(rnd.randrange(1, 6)))) for i in range(90)]
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = t.encode()
        for j in range(len(b) - least + 1):
            first.setdefault(b[j : j + least], i)
    want = {}
    for i, t in rows:
        b = t.encode()
        gone = {k for j in range(len(b) - least + 1) if first[b[j : j + least]] < i for k in range(j, j + least)}
        want[i] = (len(b), len(gone))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in got} == want
    assert sum(x for _, x in want.values()) > 1000
