"""Page parsing on a hand-made page with every kind of block."""

from graphloom.operators import corpus as C
from graphloom.sources import html as H

WIKI = """<html><body><h1 class="firstHeading mw-first-heading"><i>Lake</i> <span>Dora</span></h1>
<div class="mw-content-ltr mw-parser-output"><meta><p>Before <a href="/wiki/One">the
 one</a>, then<sup>[1]</sup> more.</p></meta>
<div class="mw-heading mw-heading3"><h3>Deep</h3></div>
<ul><li>first <a href="/wiki/A">A</a></li><li>second <a href="/wiki/B">B b</a></li></ul>
<div class="mw-heading mw-heading2"><h2>Wide</h2></div>
<table class="wikitable"><caption> Sizes </caption>
<tr><th rowspan="2">Name</th><th colspan="2">Size</th></tr>
<tr><td>km</td><td><img src="/x.png">m</td></tr>
<tr><td>Dora</td><td>12</td><td><a href="/wiki/C">c</a></td></tr></table>
<table><tr><td><table><tr><td>in</td></tr></table></td><td>out</td></tr></table>
<table class="box-More_citations_needed_section"><tr><td>no</td></tr></table>
<figure><img src="/pic.jpg"><figcaption>See <a href="/wiki/D">D</a></figcaption></figure>
<div class="mw-heading mw-heading2"><h2>Deep</h2></div><p>again</p>
<div class="mw-heading mw-heading2"><h2>References</h2></div><p>never</p></div></body></html>"""


def by_cid(url="https://en.wikipedia.org/wiki/Dora", html=WIKI):
    return {b["cid"]: b for b in H.blocks(url, html)}


def test_order_and_sections():
    blocks = H.blocks("https://en.wikipedia.org/wiki/Dora", WIKI)
    assert [b["cid"] for b in blocks] == ["h1_1", "po_1", "h1_1", "pl_2", "h0_2", "t_1", "t_2", "i_1", "h0_3", "po_3", "h0_4"]
    assert blocks[0]["title"].split() == ["Lake", "Dora"]
    sections = {b["cid"]: b["section"] for b in blocks if b["kind"] not in ("heading", "title")}
    assert sections == {"po_1": [], "pl_2": ["Deep"], "t_1": ["Wide"], "t_2": ["Wide"], "i_1": ["Wide"], "po_3": ["Deep"]}


def test_links_have_the_offsets_of_their_text():
    for b in by_cid().values():
        for link in b["links"]:
            assert b["text"][link["start"] : link["end"]] == link["text"]
    p = by_cid()["po_1"]
    assert "[1]" not in p["text"] and p["links"][0]["text"] == "the one"
    assert by_cid()["pl_2"]["text"].split("\n") == ["-  first A", "-  second B b"]


def test_spans_become_references():
    t = by_cid()["t_1"]
    assert t["text"] == "Sizes" and t["n_columns"] == 3
    shape = [[c["ref"] for c in row] for row in t["cells"]]
    assert shape == [["1", "2", "2"], ["1", None, None], [None, None, None]]
    refs = dict(t["refs"])
    assert refs["1"]["text"].strip() == "Name" and refs["1"]["header"]
    assert t["cells"][1][2]["image"] == "https://en.wikipedia.org/x.png"
    assert by_cid()["t_2"]["cells"][0][0]["text"].strip() == "in"


def test_images_and_sites():
    i = by_cid()["i_1"]
    assert i["image"] == "https://en.wikipedia.org/pic.jpg" and i["text"].split() == ["See", "D"]
    mobile = WIKI.replace("<meta>", "<section>").replace("</meta>", "</section>")
    assert [b["cid"] for b in H.blocks("https://en.m.wikipedia.org/wiki/Dora", mobile)][:2] == ["h1_1", "po_1"]
    commons = '<h1 class="firstHeading mw-first-heading">File</h1><div class="fullImageLink"><a><img src="/f.png"></a></div><table class="a vevent"><tr><td>x</td></tr></table>'
    assert [b["cid"] for b in H.blocks("https://commons.wikimedia.org/wiki/File:F", commons)] == ["h1_1", "i_1", "t_1"]


def test_broken_pages():
    assert H.blocks("u", None) == [] and H.blocks(None, "") == []
    assert [b["cid"] for b in H.blocks(None, "<p>a <b>b<p>c</div>")] == ["h1_1", "po_1"]
    deep = "<div>" * 5000 + "<p>x</p>"
    assert H.blocks("u", deep)[0]["kind"] == "title"
    page = H.blocks("u", "<article><h2>S</h2><p>x</p><h3>T</h3><p>y &amp; z</p><p></p></article>")
    assert [(b["cid"], b["section"], b["text"].strip()) for b in page if b["kind"] == "passage"] == [("po_1", ["S"], "x"), ("po_2", ["S", "T"], "y & z"), ("po_3", ["S", "T"], "")]


def test_as_a_table(spark):
    pages = spark.createDataFrame([(1, "https://en.wikipedia.org/wiki/Dora", WIKI), (2, "u", None), (3, None, "<p>x")], "page_id bigint, url string, html string")
    parsed = H.parse_pages(pages)
    assert parsed.where("page_id = 1").count() == len(H.blocks("https://en.wikipedia.org/wiki/Dora", WIKI))
    assert parsed.where("page_id = 2").count() == 0
    assert {r.hyperlink for r in H.links(parsed).collect()} == {f"/wiki/{x}" for x in ("One", "A", "B", "C", "D")}
    assert [(r.modality, r.n) for r in C.component_statistics(C.components(parsed)).orderBy("n").collect()][-1] == ("all", 7)
    assert H.anchors(pages).count() == 5
    assert H.parse_pages(pages.limit(0)).count() == 0
