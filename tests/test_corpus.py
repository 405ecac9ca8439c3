"""Corpus operators on small tables, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.operators import corpus as C
from graphloom.operators import layout


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ids(spark):
    df = spark.createDataFrame([("po_1",), ("po_1_s2",), ("t_3_s1",), ("i_4_s2",), ("x_1",)], "cid string")
    c = F.col("cid")
    got = rows(df.select("cid", ids.is_top(c), ids.highest(c), ids.modality(c)))
    assert got == sorted([("po_1", True, "po_1", "text"), ("po_1_s2", False, "po_1", "text"), ("t_3_s1", False, "t_3", "table"), ("i_4_s2", False, "i_4", "image"), ("x_1", True, "x_1", None)], key=str)
    assert rows(df.where("cid like '%s%'").select(ids.low_kind(c))) == [("s",), ("s",), ("s",)]
    with pytest.raises(Exception, match="not a lower component"):
        df.where("cid = 'po_1'").select(ids.low_kind(c)).collect()


def test_dereference(spark):
    links = spark.createDataFrame([(1, "/wiki/Caf%C3%A9"), (2, "https://en.wikipedia.org/wiki/C++"), (3, "/wiki/Gone"), (4, "/wiki/Nodoc"), (5, ""), (6, None), (7, "/wiki/%ZZ")], "k int, hyperlink string")
    titles = spark.createDataFrame([(C.SITE + "/wiki/Café", "Café"), (C.SITE + "/wiki/C++", "C++"), (C.SITE + "/wiki/Nodoc", "Nodoc"), (C.SITE + "/wiki/%ZZ", "Z")], "url string, title string")
    docs = spark.createDataFrame([("Café",), ("C++",), ("Z",), ("Z",)], "title string")
    assert rows(C.dereference(links, titles, docs).select("k", "edge")) == [(1, "Café.json"), (2, "C++.json"), (7, "Z.json")]


def test_sentences_and_their_edges(spark):
    text = "One a. Two bb!? One a. no end"
    paras = spark.createDataFrame([(1, "p_1", text), (1, "p_2", "..."), (2, "p_1", ""), (2, "p_2", None)], "doc bigint, cid string, text string")
    sents = C.sentences(paras)
    assert [(r.cid, r.text) for r in sents.where("doc = 1 and cid like 'p_1%'").orderBy("pos").collect()] == [("p_1_s1", "One a. "), ("p_1_s2", "Two bb!? "), ("p_1_s3", "One a. "), ("p_1_s4", "no end")]
    assert rows(sents.where("cid like 'p_2%'").select("doc", "text")) == [(1, "...")]
    placed = C.located(sents, paras)
    assert [r.start for r in placed.where("doc = 1 and cid like 'p_1%'").orderBy("pos").collect()] == [0, 7, 0, 23]
    edges = spark.createDataFrame([(1, "p_1", 0, 3, "a"), (1, "p_1", 0, 3, "a"), (1, "p_1", 5, 9, "crosses"), (1, "p_1", 23, 29, "end"), (1, "p_1", 7, 16, "whole"), (9, "p_1", 0, 1, "no document")], "doc bigint, para string, start int, end int, edge string")
    assert rows(C.edges_to_sentences(placed, edges)) == [(1, "p_1_s1", 0, 3, "a"), (1, "p_1_s1", 0, 3, "a"), (1, "p_1_s2", 0, 9, "whole"), (1, "p_1_s4", 0, 6, "end")]


def test_edges_of_a_long_paragraph(spark):
    words = [f"w{k}" * (k % 90 + 1) + ". " for k in range(60)]
    text = "".join(words)
    paras = spark.createDataFrame([(1, "p_1", text)], "doc int, cid string, text string")
    spans = [(a, a + n) for a in range(0, len(text), 37) for n in (1, 20, 300)]
    edges = spark.createDataFrame([(1, "p_1", a, b, f"{a}-{b}") for a, b in spans], "doc int, para string, start int, end int, edge string")
    placed = C.located(C.sentences(paras), paras)
    want, at = [], 0
    for k, w in enumerate(words):
        want += [(f"p_1_s{k + 1}", a - at, b - at, f"{a}-{b}") for a, b in spans if at <= a and b <= at + len(w)]
        at += len(w)
    assert rows(C.edges_to_sentences(placed, edges).select("cid", "start", "end", "edge")) == sorted(want, key=str)


def test_trimmed_sentences_are_found(spark):
    paras = spark.createDataFrame([(1, "p_1", "x  (a\n b) \\E y")], "doc int, cid string, text string")
    ok = spark.createDataFrame([(1, "p_1_s1", 0, "(a b) \\E"), (1, "p_1_s2", 1, " y ")], "doc int, cid string, pos int, text string")
    assert rows(C.located(ok, paras).select("cid", "start")) == [("p_1_s1", 3), ("p_1_s2", 13)]
    bad = spark.createDataFrame([(1, "p_1_s1", 0, "zz")], "doc int, cid string, pos int, text string")
    with pytest.raises(Exception, match="sentence not in its paragraph"):
        C.located(bad, paras).collect()


def test_propositions(spark):
    props = spark.createDataFrame([(1, "p_1_p1", "The Blue lake"), (1, "p_1_p2", "Green hill"), (1, "p_2_p1", "blue")], "doc int, cid string, text string")
    edges = spark.createDataFrame([(1, "p_1", "blue Lake", "e", "h"), (1, "p_1", "--", "f", "h"), (1, "p_1", "blue hill", "g", "h")], "doc int, para string, text string, edge string, hyperlink string")
    assert rows(C.edges_to_propositions(props, edges).select("cid", "edge")) == [("p_1_p1", "e"), ("p_1_p1", "f"), ("p_1_p2", "f")]


def test_segments(spark):
    tables = spark.createDataFrame([(1, "t_1", [["h"], ["a"], ["b"]]), (1, "t_2", [["h"]]), (1, "t_3", []), (1, "t_4", None)], "doc int, cid string, cells array<array<string>>")
    assert rows(C.table_segments(tables)) == [(1, "t_1_s1", [["h"], ["a"]]), (1, "t_1_s2", [["h"], ["b"]])]


def test_images(spark):
    images = spark.createDataFrame([(1, "i_1", "a.b.png"), (1, "i_2", None), (1, "i_3", "c.png")], "doc int, cid string, filename string")
    files = spark.createDataFrame([("a.b", "1_x.png"), ("a.b", "boxed.png"), ("a.b", "2.png"), ("q", "1_x.png")], "folder string, name string")
    assert rows(C.subimages(images, files)) == [(1, "i_1_s1", "a.b/1_x.png"), (1, "i_1_s2.png", "a.b/2.png")]


def test_boxes(spark):
    made = [
        ("p", 0, "title", 0.9, 0, 0, 10, 10), ("p", 2, "text", 0.9, 0, 0, 10, 10), ("p", 2, "text", 0.9, 2, 2, 5, 5), ("p", 1, "figure", 0.9, 0, 20, 50, 60),
        ("p", 2, "text", 0.9, 5, 25, 9, 30), ("p", 1, "figure", 0.5, 6, 26, 8, 28), ("p", 2, "text", 0.1, 70, 70, 90, 90), ("q", 2, "text", 0.3, 2, 2, 5, 5),
    ]
    df = spark.createDataFrame(made, "image string, class_id int, class string, confidence double, x1 int, y1 int, x2 int, y2 int")
    assert rows(layout.filter_boxes(df).select("image", "idx", "class", "x1", "y1")) == [("p", 0, "title", 0, 0), ("p", 2, "figure", 0, 20), ("p", 3, "text", 5, 25), ("q", 0, "text", 2, 2)]
    w, h = layout.fit(F.lit(1280), F.lit(320))
    assert spark.range(1).select(w, h).first()[:] == (640, 160)


def test_pending(spark):
    work, done = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    assert rows(C.pending(work, done, "k")) == [(2,), (2,)] and C.pending(work, done, "k", overwrite=True).count() == 3


def test_containing(spark):
    docs = spark.createDataFrame([(1, "xx the cat yy the cat"), (2, None), (3, ""), (4, "the ca"), (None, "cat")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "the cat"), (2, "cat"), (3, ""), (4, None), (5, "cat")], "item_id bigint, passage string")
    assert rows(C.containing(docs, items)) == sorted([(1, 1), (1, 2), (1, 5), (None, 2), (None, 5)], key=str)
    assert C.containing(docs, items.limit(0)).count() == 0 and C.containing(docs.limit(0), items).count() == 0
    for most in (1, 4, 9):  # as many rounds as it takes
        assert rows(C.containing(docs, items, most=most)) == rows(C.containing(docs, items))
