"""Results that are whole: cases that an earlier round cut."""

import random

import pytest

from tallyspark.llm import neighbours, quality, repeats, similar

SCHEMA = "doc_id long, text string, source string"


def groups_of(sets, least):
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(a) for a in range(len(sets))]


def test_near_copies_with_edited_words_go(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(25):
        words = [rnd.choice("abcdefgh") + str(rnd.randrange(400)) for _ in range(rnd.randrange(8, 400))]
        for _ in range(6):
            copy = list(words)
            for _ in range(rnd.randrange(1 + len(words) // 40)):
                copy[rnd.randrange(len(copy))] = "edited" + str(rnd.randrange(9))
            rows.append((len(rows), " ".join(copy).upper() if g % 2 else "\n ".join(copy), "s"))
    rows += [(900, None, "s"), (901, " \t", "s"), (902, "One two", "s"), (903, "one two", "s"), (904, "two one", "s")]
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    of = groups_of(sets, 0.8)
    least = {}
    for (i, _, _), g in zip(rows, of, strict=True):
        least[g] = min(least.get(g, i), i)
    assert 25 < len(least) < len(rows) - 60
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["doc_id"] for r in similar.keep_one(frame).collect()) == sorted(least.values())
    assert similar.keep_one(frame.limit(0)).count() == 0


def test_pipeline_drops_a_text_with_two_edited_words(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"w{k}" for k in range(300))
    pair = spark.createDataFrame([(1, text, "s"), (2, text.replace("w40 ", "x ").replace("w90 ", "y "), "s")], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, pair, "").collect()] == [1]


def test_long_lines_of_many_documents_are_removed(spark):
    notice = " ".join(f"licence{k}" for k in range(40))
    rows = [(i, f"{notice}\nmy{i} own{i}", "h") for i in range(25)] + [(100, f"{notice}\nmine", "other")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in quality.line_verdicts(frame).collect()}
    assert got == {i: (40, False) for i in range(25)} | {100: (0, True)}
    assert [r["doc_id"] for r in quality.pass_quality(frame).collect()] == [100]


def test_repeats_in_one_part_across_arrow_batches(spark):
    rnd = random.Random(7)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(80))
    rows = [(i, f"{i} own {i * 7919} {passage if i % 3 == 0 else ''} end {i}") for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == 0 and all((got[i] >= 80) == (i % 3 == 0) for i in range(1, 40))


def test_repeated_rows_do_not_take_neighbours_places(spark):
    rows = [(i, [1.0, 2.0]) for i in range(20) for _ in range(2)] + [(50 + i, [3.0 + i, 2.0]) for i in range(20)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1000).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, i, i, 0.0) for i in range(1, 11)]


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a, "s"), (5, b, "s"), (3, b, "t"), (7, a, "s"), (5, a, "s"), (None, c, "s"), (None, c, "s"), (None, a, "s"), (9, None, "s")]
    kept = similar.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(5, a, "s"), (3, b, "t"), (None, c, "s"), (9, None, "s")]))


def test_lines_are_counted_by_documents_of_a_host(spark):
    shared = " ".join(f"shared{k}" for k in range(15))
    rows = [(i, shared, "copied") for i in range(40)] + [(7, shared, "repeated")] * 40 + [(None, shared, "keyless")] * 40
    rows += [(i, f"{shared}\n" + " ".join(f"own{i}x{k}" for k in range(30)), None) for i in range(21)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r["source"], r["removed_words"], r["kept"]) for r in quality.line_quality(frame).collect()}
    assert got == {("copied", 15, False), ("repeated", 0, True), ("keyless", 0, True), (None, 15, True)}
    once = quality.pass_quality(frame, quality.LineRules(distinct_texts=True))
    assert once.count() == len(rows) and quality.pass_quality(frame).count() == len(rows) - 40


def test_quality_with_clashing_columns(spark):
    names = ["host", "k1", "k2", "d", "g1", "removed", "row", "stats", "lines", "failed", "__s"]
    rows = [(1, "w " * 3 + " ".join(f"x{k}" for k in range(20)), "s", *names), (2, None, None, *names)]
    frame = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in names))
    assert [tuple(r) for r in quality.pass_quality(frame).collect()] == rows[:1]
    got = {r["doc_id"]: r.asDict() for r in quality.line_quality(frame).collect()}
    assert all(got[i][n] == n for i in (1, 2) for n in names) and got[1]["kept"] and not got[2]["kept"]
    assert quality.line_verdicts(frame).count() == 2 and quality.line_verdicts(frame.limit(0)).count() == 0
