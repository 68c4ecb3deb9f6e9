"""The maximum-entropy model against plain loops."""

import math
import random

import numpy as np
import pytest

from tallyspark.llm import language

M = (1 << 64) - 1


def plain_row(values, at, place, distances, salt, rows):
    h = salt * 0x9E3779B97F4A7C15 & M
    for d in distances:
        h = (h ^ (values[at - d] if place >= d else 1)) * 0xD6E8FEB86659FD93 & M
        h ^= h >> 32
    return h % rows


def small_model(rng, rows):
    outer = rng.normal(size=(len(language.WORD_FEATURES) + len(language.CLASS_FEATURES), rows, language.CLASSES))
    inner = rng.normal(size=(len(language.SLOT_FEATURES), rows, language.SLOTS))
    return language.Model(rng.normal(size=language.CLASSES), rng.normal(size=(language.CLASSES, language.SLOTS)), outer, inner)


def test_leaf_scores_equal_plain_loops():
    rng, rows = np.random.default_rng(1), 64
    model = small_model(rng, rows)
    texts = [5, 1, 9, 2]
    n = sum(texts)
    hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    classes, slots = rng.integers(0, language.CLASSES, n), rng.integers(0, language.SLOTS, n)
    place = np.concatenate([np.arange(k) for k in texts])
    first, second = language.feature_rows(hashes, classes, place, rows)
    got = model.leaf_scores(first, second, classes, slots)
    words, named, own = [int(h) for h in hashes], [int(c) + 2 for c in classes], rows // language.CLASSES
    for i in range(n):
        z = model.bias.copy()
        for f, d in enumerate(language.WORD_FEATURES):
            z += model.outer_weights[f][plain_row(words, i, place[i], d, f + 1, rows)]
        for f, d in enumerate(language.CLASS_FEATURES):
            z += model.outer_weights[f + len(language.WORD_FEATURES)][plain_row(named, i, place[i], d, f + 11, rows)]
        y = model.inner[classes[i]].copy()
        for f, d in enumerate(language.SLOT_FEATURES):
            y += model.inner_weights[f][classes[i] * own + plain_row(words, i, place[i], d, f + 21, own)]
        want = math.log(math.exp(z[classes[i]]) / np.exp(z).sum()) + math.log(math.exp(y[slots[i]]) / np.exp(y).sum())
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_observed_less_expected_is_the_gradient():
    rng, rows, n = np.random.default_rng(2), 64, 40
    model = small_model(rng, rows)
    hashes, classes = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, language.CLASSES, n)
    first, _ = language.feature_rows(hashes, classes, np.arange(n), rows)
    seen, expected = (np.zeros_like(model.outer_weights.transpose(0, 2, 1)) for _ in range(2))
    language._observed(first, classes, seen)
    language._counts(first, language.shares(model.bias, model.outer_weights, first), expected)
    seen, expected = seen.transpose(0, 2, 1), expected.transpose(0, 2, 1)
    total = lambda: language.log_scores(model.bias, model.outer_weights, first, classes).sum()
    for f, i, c in [(0, first[0][3], classes[3]), (1, first[1][5], 7), (5, first[5][0], classes[0])]:
        before = total()
        model.outer_weights[f, i, c] += 1e-6
        assert (total() - before) / 1e-6 == pytest.approx(seen[f, i, c] - expected[f, i, c], abs=1e-3)
        model.outer_weights[f, i, c] -= 1e-6
    better = language.Model(model.bias, model.inner, language.stepped(model.outer_weights, seen, expected), model.inner_weights)
    assert language.log_scores(better.bias, better.outer_weights, first, classes).sum() > total()


def test_chunks_hold_whole_texts():
    import pyarrow as pa

    texts = ["a b a", None, "", "c " * 40, "A\tb\n", "d"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array([False] * (b - a)), pa.array(texts[a:b], pa.string())], ["key", "held", "text"]) for a, b in ((0, 2), (2, 6))]
    rows = [r for b in language._coded(iter(batches), 6) for r in b.to_pylist()]
    assert len(rows) == 3 and [k for r in rows for k in r["keys"]] == list(range(6))
    names = {np.uint64(language.word_hash(w.encode())): w for w in ["a", "b", "c", "d", "\n"]}
    words = []
    for r in rows:
        ids, of, place, _ = language._laid(r)
        for k in range(len(r["keys"])):
            hashes = np.frombuffer(r["hashes"], np.uint64)
            words.append([names[hashes[i]] for i in ids[of == k]])
            assert place[of == k].tolist() == list(range((of == k).sum()))
    assert words == [[*(t or "").lower().split(), "\n"] for t in texts]


def test_scores_do_not_depend_on_splits_and_use_word_order(spark):
    rnd = random.Random(8)
    grammar = {"the": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["sat", "ran"], "sat": ["the"], "ran": ["the"]}
    rows = []
    for i in range(300):
        w = ["the"]
        for _ in range(60):
            w.append(rnd.choice(grammar[w[-1]]))
        if i >= 250:
            rnd.shuffle(w)
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1000, None), (None, "the cat"), (1001, "unseen " * 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({(r["doc_id"], r["score"].__round__(3)) for r in language.lm_scores(frame.repartition(k)).collect()} for k in (1, 7))
    assert one == many
    got = [r for r in language.lm_scores(frame).collect() if r["held_out"] and (r["doc_id"] or 1000) < 1000]
    in_order, shuffled = ([r["score"] / r["n_tokens"] for r in got if (r["doc_id"] < 250) is k] for k in (True, False))
    assert min(in_order) > max(shuffled) and min(in_order) > -0.4
    assert all(r["score"] > r["base_score"] for r in got if r["doc_id"] < 250)


@pytest.mark.parametrize("named", [1 << 16, 1])
def test_frequent_words_are_counted_everywhere(spark, named):
    """a word that no chunk lists, as it is rare in each, may be among the most frequent of all."""
    rng = random.Random(3)
    chunks = [{1: 500, 2: 400, 10 + k: 20, 30: 9} for k in range(6)]  # 30 is rare in each chunk, and the third most frequent
    for c in chunks:
        c.update({100 + rng.randrange(50): rng.randrange(1, 4) for _ in range(20)})
    rows = []
    for c in chunks:
        listed = [w for w in c if c[w] >= 10]
        rows.append((np.array([*c], "<i8").tobytes(), np.array([*c.values()], "<i4").tobytes(), listed, [c[w] for w in listed]))
    total = {}
    for c in chunks:
        for w, n in c.items():
            total[w] = total.get(w, 0) + n
    coded = spark.createDataFrame(rows, "hashes binary, n binary, often array<long>, often_n array<long>")
    for most in (2, 3, 5, 1000):
        want = sorted(total, key=lambda w: (-total[w], w))[:most]
        assert language.frequent(coded, most, named).view(np.int64).tolist() == want
    assert sorted(total, key=lambda w: (-total[w], w))[2] == 30


def test_products_of_powers_score_as_sums_of_weights():
    rng, rows, n = np.random.default_rng(5), 64, 3 * language.BLOCK + 7
    model = small_model(rng, rows)
    hashes, classes = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, language.CLASSES, n)
    slots = rng.integers(0, language.SLOTS, n)
    first, second = language.feature_rows(hashes, classes, np.arange(n), rows)
    settled = model.settled()
    assert settled.powers == (True, True)
    assert settled.leaf_scores(first, second, classes, slots) == pytest.approx(model.leaf_scores(first, second, classes, slots), abs=1e-9)
    room = np.empty((language.CLASSES, n + 8))
    a, b = ([x.copy() for x in m.expected(first, second, classes, room)] for m in (model, settled))
    assert all(x == pytest.approx(y, abs=1e-12) for x, y in zip(a, b, strict=True))
    model.outer_weights[0, 0, 0] = 1e3  # exp() of which is beyond any float
    assert model.settled().powers == (False, True) and np.isfinite(model.settled().leaf_scores(first, second, classes, slots)).all()
