"""Whole evaluations, vision answers and scans of parsed documents."""

import pytest

from graphloom.operators import corpus as C
from graphloom.operators import evaluate as V
from graphloom.operators import vision as I

UNITS = "qid string, units array<struct<nodes:array<struct<doc:string,cid:string>>>>"
QUESTIONS = "qid string, question string, answers array<string>, evidences array<struct<modality:string,doc:string,cid:string,score:double>>"


def ev(doc, cid=None):
    return (None, doc, cid, None)


def test_retrieval(spark):
    asked = spark.createDataFrame([("a", "?", ["x"], [ev("d1", "p_1"), ev("d2", "t_1")]), ("b", "?", ["y"], [ev("d3", "i_1")])], QUESTIONS)
    got = spark.createDataFrame([("a", [([("d1.json", "p_1_s3"), ("d9.json", "p_1")],), ([("d2.json", "t_1")],)])], UNITS)
    web = V.retrieval_accuracy(asked, got, "web").first()
    assert (web.recall, web.mrr, web.questions) == (0.5, 0.5, 2)
    page = V.retrieval_accuracy(asked, got, "page").first()
    assert (page.recall, page.mrr) == (1.0, 1.0)
    base = spark.createDataFrame([("a", [([("d1.jpeg", "x")],)]), ("b", [([("d0.jpg", "x")],), ([("d3.jpg", "x")],)])], UNITS)
    page = V.retrieval_accuracy(asked, base, "page", baseline=True).first()
    assert (page.recall, page.mrr) == (0.75, 0.75)
    pages = spark.createDataFrame([("a", "?", [], [ev("d", "d_1"), ev("d", "d_2")])], QUESTIONS)
    web = V.retrieval_accuracy(pages, spark.createDataFrame([("a", [([("d_2.png", "x")],)])], UNITS), "web", baseline=True).first()
    assert (web.recall, web.mrr) == (0.5, 1.0)
    with pytest.raises(ValueError):
        V.retrieval_accuracy(asked, got, "book")


def test_answers(spark):
    asked = spark.createDataFrame([("a", "?", ["10"], []), ("b", "?", ["blue", "red"], []), ("c", "?", ["z"], [])], QUESTIONS)
    said = spark.createDataFrame([("a", ["10.3"], 1), ("b", ["red", "blue"], 1)], "qid string, answers array<string>, line int")
    web = V.answer_accuracy(asked, said, "web").first()
    assert web.em == pytest.approx(1 / 3) and web.questions == 3
    assert V.answer_accuracy(asked, said, "page").first().em == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        V.answer_accuracy(asked, said, "book")


def test_tables(spark):
    f = spark.createDataFrame([("m", "s", "recall", 0.5), ("m", "t", "recall", 1.0), ("n", "s", "mrr", 0.25)], "algorithm string, dataset string, metric string, value double")
    assert [r[:] for r in V.result_table(f, ["s", "t"]).collect()] == [("m", 0.5, 1.0, 0.75)]
    assert sorted(r[:] for r in V.set_table(f, "s", ["mrr", "recall"]).collect()) == [("m", None, 0.5), ("n", 0.25, None)]


def test_vision(spark):
    said = spark.createDataFrame([("i", '[{"bbox_2d": [1, 2, 3, 4], "class": "t"}, {"bbox_2d": [1]}, {"bbox_2d": [5, 6, 7, 8]}, {"bb'), ("j", None)], "image string, raw string")
    assert [(r.k, r["class"], r.x1, r.name) for r in I.detections(said).collect()] == [(1, "t", 1.0, "1_t.png"), (3, "object", 5.0, "3_object.png")]
    files = spark.createDataFrame([("1_figure.png",), ("2_table.png",), ("x.json",), ("3_text.png",)], "name string")
    model = lambda: lambda p: p.split("\n")[0][:10]
    assert sorted((r.name, r.step) for r in I.read_texts(files, model).collect()) == [("1_figure.png", "description"), ("1_figure.png", "figure_ocr"), ("2_table.png", "table_ocr"), ("3_text.png", "ocr")]
    assert [r.name for r in I.summarize(files, files.where("name <> '3_text.png'"), model).collect()] == ["3_text.png"]
    assert I.summarize(files, files, model, overwrite=True).count() == 4


def test_document_scan_needs_all_kinds(spark):
    df = spark.createDataFrame([("d", {"p_1": ("x",)})], "file string, text map<string,struct<text:string>>")
    with pytest.raises(KeyError, match="sentence"):
        C.document_components(df)
