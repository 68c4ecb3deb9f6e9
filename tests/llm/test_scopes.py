"""Staged tables belong to the scope that is open in their thread."""

import glob
import threading

import pytest

from tallyspark.llm import common, graph


def here(spark):
    return {p for p in glob.glob(f"{common.shared_dir(spark)}/*")}


def test_threads_keep_to_their_own(spark):
    before, wrong = here(spark), []

    def work(n):
        try:
            with common.Scope():
                mine = common.Staged(spark.range(n), f"mine-{n}")
                chain = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
                roots = graph.components(chain)
                assert {r["root"] for r in roots.collect()} == {0} and mine.df.count() == n
        except BaseException as error:  # noqa: BLE001
            wrong.append(error)

    threads = [threading.Thread(target=work, args=(n,)) for n in (3, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and here(spark) == before


def test_scopes_nest_and_keep(spark):
    before = here(spark)
    with common.Scope() as outer:
        with common.Scope() as inner:
            kept, lost = common.Staged(spark.range(2), "kept"), common.Staged(spark.range(2), "lost")
            inner.keep(kept)
        assert kept.df.count() == 2 and kept in outer.held and lost.path not in {p for p in here(spark)}
        common.Folder(spark, common.made_dir(spark, f"{common.shared_dir(spark)}/by-hand"))
    assert here(spark) == before
    with pytest.raises(RuntimeError), common.Scope():
        common.Staged(spark.range(1), "failed")
        raise RuntimeError
    assert here(spark) == before
    loose = common.Staged(spark.range(1), "loose")
    with common.Scope() as scope:
        scope.keep(common.Staged(spark.range(1), "outward"))
    assert len(here(spark) - before) >= 2
    common.drop_staged()
    assert not any("loose" in p or "outward" in p for p in here(spark)) and loose.path
