"""Near copies against comparing all pairs: templates, chains, growing texts; and how many pairs a template costs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import similar
from tallyspark.llm.common import Staged


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"e{rng.randrange(10**9)}"
    return out


def groups_of(texts, least=0.8, size=5):
    sets = [similar.shingles(t.encode(), size) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar.similarity(sets[i], sets[j]) >= least - 1e-12:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def made(rng, kind):
    base = [f"w{rng.randrange(5000)}" for _ in range(220)]
    if kind == "template":  # all pairs lie below the similarity, some lie above it by chance
        return [" ".join(edited(rng, base, rng.choice([3, 5, 6, 7, 8]))) for _ in range(60)]
    if kind == "chain":  # each is alike to the next one only
        out = [base]
        for _ in range(40):
            out.append(edited(rng, out[-1], 3))
        return [" ".join(t) for t in out]
    if kind == "growing":  # texts of different lengths
        return [" ".join(base[: rng.randrange(120, 220)] + edited(rng, base, 0)[: rng.randrange(30)]) for _ in range(40)]
    families = [edited(rng, base, 6) for _ in range(4)]  # copies of copies
    return [" ".join(edited(rng, rng.choice(families), rng.choice([1, 2, 4, 6]))) for _ in range(60)]


@pytest.mark.parametrize("kind", ["template", "chain", "growing", "families"])
def test_one_of_each_group_stays(spark, kind):
    rng = random.Random(kind)
    texts = made(rng, kind)
    order = list(range(len(texts)))
    rng.shuffle(order)
    want = set(groups_of(texts))
    frame = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in similar.keep_one(frame).collect()} == want


def test_recall_near_the_similarity():
    """Pairs at just over 0.8 that share a bucket of the index, by the fingerprints alone."""
    rng = random.Random(8)
    met = total = 0
    while total < 300:
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        a, b = (similar.shingles(" ".join(t).encode(), 5) for t in (base, edited(rng, base, rng.choice([3, 4]))))
        if not 0.8 <= similar.similarity(a, b) <= 0.87:
            continue
        total += 1
        sums = [similar.signed_sums(x) for x in (a, b)]
        keys = [similar.ball(np.abs(s), similar.packed(s), 24, 3) for s in sums]
        met += bool(np.intersect1d(*keys).size)
    assert met >= 0.98 * total


@pytest.mark.parametrize("n_texts", [150, 600])
def test_a_template_costs_no_pairs(spark, monkeypatch, n_texts):
    rng = random.Random(n_texts)
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(edited(rng, base, 8))) for i in range(n_texts)]
    staged = {}

    class Kept(Staged):
        def __init__(self, df, label, codec="zstd"):
            super().__init__(df, label, codec)
            staged[label] = self.df

    monkeypatch.setattr(similar, "Staged", Kept)
    assert similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count() >= n_texts - 5
    compared = Counter()
    texts = staged["shared"].collect()
    grade = lambda size: math.floor(math.log(size) / math.log(1.1))
    for mark, reach in (("f", 8), ("m", 4)):
        for r in texts:
            for i, z in enumerate((r["y"] or [])[: max(0, r["size"] // reach + 1 - r["alone"])]):
                for other in range(grade(r["size"] * 0.8), grade(r["size"] / 0.8) + 1):
                    m = (r["size"] + min(1.1 ** (other + 1), r["size"] / 0.8)) / 9
                    at, n, w = r["alone"] + i, r["n"], r["w"]
                    low, high = (n, m + n - 2 * at) if mark == "f" else (max(n - m, 0), min(n, m + n - 2 * at))
                    for k in range(int(low // w), int(high // w) + 1) if low <= high else ():
                        key = (n // w, k, grade(r["size"]), other) if mark == "f" else (k, n // w, other, grade(r["size"]))
                        compared[mark, r["loose"], z["t"], *key] += 1
    pairs = sum(c * compared[("m", *k[1:])] for k, c in compared.items() if k[0] == "f")
    assert len(texts) >= n_texts / 2 and pairs <= 0.01 * n_texts**2  # of texts with few edits of their own


def test_texts_that_meet_by_chance_are_not_compared(spark, monkeypatch):
    """F pipeline: in a narrow index unrelated texts share buckets, by the square of their number."""
    for name, value in (("NARROW", 14), ("SPARE", 0)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(400)]
    texts += [" ".join(edited(rng, t.split(), 1)) for t in texts[:20]]
    compared, near = [], similar._near
    monkeypatch.setattr(similar, "_near", lambda pairs, sets: compared.append(pairs.count()) or near(pairs, sets))
    kept = {r["doc_id"] for r in similar.keep_one(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert kept == set(groups_of(texts)) and compared[0] <= len(texts) and compared[1] <= 5 * len(texts)


def test_sets_are_read_where_they_lie():
    import pyarrow as pa

    sets = [np.array(x, "<i8") for x in ([1, 2, 3], [], [2, 9], [5])]
    raw = pa.array([x.tobytes() for x in sets], pa.binary())
    usual = pa.array([[7], [1, 2], [3], [2, 4], [5]], pa.list_(pa.int64())).slice(1)  # rows of a batch may begin anywhere
    assert similar._differences(raw, usual).to_pylist() == [[3], [3], [4, 9], []]
    assert similar._listed(raw.slice(2)).to_pylist() == [[2, 9], [5]]
    assert similar._alike(raw, raw.take(pa.array([0, 2, 2, 2]))).to_pylist()[2:] == [1.0, 0.0]


def test_fingerprints_are_compared_once(spark, monkeypatch):
    """A filter that is pushed below the comparison makes it again, in Python workers of its own."""
    plans = []

    class Planned(Staged):
        def __init__(self, df, label, codec="zstd"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            super().__init__(df, label, codec)

    monkeypatch.setattr(similar, "Staged", Planned)
    sets = spark.createDataFrame([(1, b"a"), (2, b"b")], "node long, fp binary")
    assert similar._near(spark.createDataFrame([(1, 2)], "a long, b long"), sets).count() == 1
    assert plans[0].count("ArrowEvalPython") == 1


def test_wider_indexes_find_as_much_and_meet_less_by_chance():
    """F pipeline: rows of the index that share a bucket by chance grew with the square of the texts below 2^18 of them."""
    rng = random.Random(18)
    near = []
    while len(near) < 300:
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        a, b = (similar.shingles(" ".join(t).encode(), 5) for t in (base, edited(rng, base, rng.choice([3, 4]))))
        if 0.8 <= similar.similarity(a, b) <= 0.83:
            near.append([similar.signed_sums(x) for x in (a, b)])
    width = lambda n: min(similar.WIDE, max(similar.NARROW, n.bit_length() + similar.SPARE))
    chance = {}
    for n in (41_000, 205_000, 1_000_000, 12_000_000):
        keys = lambda s, n=n: similar.keyed(np.abs(s), similar.packed(s), width(n))
        met = sum(bool(np.intersect1d(keys(a), keys(b)).size) for a, b in near)
        assert met >= 0.985 * len(near)
        own = keys(near[0][0])
        by_segment = np.bincount((own.astype(np.uint64) >> np.uint64(32)).astype(int), minlength=similar.SEGMENTS)
        assert len(np.unique(own)) == len(own)
        chance[n] = (by_segment.astype(float) ** 2).sum() * n / 2 ** width(n)  # buckets that a text shares with an unrelated one
    assert all(chance[n] <= chance[41_000] * (n / 41_000) ** 0.6 for n in chance)  # of each text; before in proportion to n
