"""Answers in JSON, failures among them, and annotation files."""

import json

import pytest

from tallyspark.operators.model import FitConfig
from tallyspark.plans import answers as A
from tallyspark.sources import matrices as D
from tallyspark.sources.context import Context
from tallyspark.sources.matrices import Matrix


@pytest.fixture(scope="module")
def m(spark):
    rows = [(c, f"g{g}", (c * g) % 4) for c in range(12) for g in range(1, 4) if (c * g) % 4]
    cells = [(c, "a" if c < 7 else "b") for c in range(12)]
    return Matrix(spark.createDataFrame(rows, "cell_id long, gene_id string, value long"), spark.createDataFrame(cells, "cell_id long, label string"), spark.createDataFrame([(f"g{g}",) for g in range(1, 5)], "gene_id string"))


@pytest.mark.parametrize(
    ("error", "status", "code"),
    [
        (KeyError("gene 'x' is not in the dataset"), 404, "gene_not_found"), (FileNotFoundError("f"), 400, "file_not_found"), (A.DatasetNotLoaded("dataset is not loaded"), 409, "dataset_not_loaded"),
        (ValueError("kBulk needs cells"), 400, "invalid_kbulk_request"), (ValueError("checkpoint 2 differs"), 400, "invalid_checkpoint_request"), (ValueError("no label"), 400, "invalid_label_request"),
        (ValueError("pages count from 1"), 400, "invalid_request"), (RuntimeError("x"), 400, "runtime_error"), (ZeroDivisionError(), 500, "internal_error"),
    ],
)
def test_failures(error, status, code):
    got, body = A.failure(error)
    told = json.loads(body)
    assert got == status and told["error"]["code"] == code and told["error"]["message"] and told["ok"] is False and told["data"] is None


def test_answers(m):
    status, body = A.answered(lambda: A.dataset(m, "p"))
    assert status == 200 and json.loads(body)["data"] | {"totalCountMean": 0, "totalCountMedian": 0, "totalCountP99": 0} == {
        "nCells": 12, "nGenes": 4, "layer": "(X)", "path": "p", "labelKeys": ["label"], "totalCountMean": 0, "totalCountMedian": 0, "totalCountP99": 0,
    }
    page = json.loads(A.answered(lambda: A.genes(m, " G", 2, 3))[1])["data"]
    assert [i["geneName"] for i in page["items"]] == ["g4"] and page["totalItems"] == 4 and page["totalPages"] == 2 and page["items"][0]["detectedFraction"] == 0
    raw = json.loads(A.answered(lambda: A.gene(m, "g1"))[1])
    assert raw["ok"] and raw["data"]["posterior"] is None and raw["data"]["rawSummary"]["totalCount"] == 18 and raw["meta"] == {}
    assert A.answered(lambda: A.gene(m, "none"))[0] == 404 and A.answered(lambda: A.genes(m, page=0))[0] == 400
    assert json.loads(A.answered(lambda: A.kbulk(m, "g1", None, FitConfig(), 0, 1, 0))[1])["error"]["code"] == "invalid_kbulk_request"


def test_checkpoint_answer(spark, m):
    kind = "scope string, gene_id string, scale double, support array<double>, prob array<double>"
    priors = spark.createDataFrame([(s, g, 2.0, [0.0, 0.5], [0.5, 0.5]) for s in ("global", "label:a", "label:b") for g in ("g1", "gx")], kind)
    got = json.loads(A.answered(lambda: A.checkpoint(priors, {"likelihood": "binomial", "mean_reference": 4.5}, m))[1])["data"]
    assert got["geneCount"] == 2 and got["nOverlapReferenceGenes"] == 1 and got["labelPreview"] == ["a", "b"] and got["suggestedLabelKey"] == "label"
    assert got["scale"] == 2.0 and got["meanReferenceCount"] == 4.5 and got["supportDomain"] == "probability" and got["hasGlobalPrior"] is True


def test_annotations(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gene,label,score,note,n\ng1,x,1.234,0.5,3\ng1,NA,2,word,4\ng1,x,,late,5\n")
    (tmp_path / "b.csv").write_text("gene,checkpoint,label,v\ng2,c1,,7\ng2,c1,y,8\n")
    got = D.read_annotations(spark, {"one": str(tmp_path / "a.csv"), "two": str(tmp_path / "b.csv")}).collect()
    assert {(r["name"], r["gene_id"], r["source"]): r["text"] for r in got} == {
        ("one", "g1", "label:x"): "score=NA, note=late, n=5", ("one", "g1", "global"): "score=2.00, note=word, n=4",
        ("two", "g2", "c1/global"): "v=7", ("two", "g2", "c1/label:y"): "v=8",
    }
    for name, text in (("none", "gene\ng1\n"), ("blank", "gene,source,v\ng1,,2\n"), ("lost", "x,v\n1,2\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(ValueError):
            D.read_annotations(spark, {name: str(tmp_path / f"{name}.csv")}).collect()


def test_context_keeps_the_last_ones(spark):
    held = Context(2)
    make = lambda n: lambda: spark.range(n)
    first = held.held(spark, "a", make(1))
    assert held.held(spark, "a", make(9)) is first and first.is_cached and (held.hits, held.misses) == (1, 1)
    held.held(spark, "b", make(2))
    held.held(spark, "a", make(9))
    held.held(spark, "c", make(3))
    assert [k[1] for k in held.tables] == ["a", "c"] and held.held(spark, "b", make(2)).count() == 2
    held.forget(spark)
    assert not held.tables and not first.is_cached
    with pytest.raises(ValueError):
        Context(0)
