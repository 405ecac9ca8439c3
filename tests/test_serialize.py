"""Serialisation, chunks and prompts."""

from graphloom.operators import serialize as S

CELL = "struct<text:string,header:boolean,image:string,ref:string>"
SCHEMA = f"doc int, cid string, title string, section array<string>, cells array<array<{CELL}>>, refs map<string,{CELL}>"


def cell(text, image=None, ref=None):
    return (text, False, image, ref)


def table(rows, refs=None, cid="t_1"):
    return (1, cid, "T", ["A", "B"], rows, refs or {})


def test_tables(spark):
    rows = [[cell("n,o"), cell(None, ref="1")], [cell(" x ", "d/i.png"), cell("y\nz", "d/j.png")], [cell("w", "d/i.png"), cell(None, ref="9")]]
    df = spark.createDataFrame([table(rows, {"1": cell("ref", "d/j.png")}), table([], cid="t_2")], SCHEMA)
    got = {r.cid: r for r in S.serialize_tables(df, ("image",)).collect()}
    assert got["t_1"].target == "T [SEP] A, B [SEP] n , o, ref <Image 1> [SEP] x  <Image 2>, y z <Image 1> [SEP] w <Image 2>,  [SEP] <Image 1> j.png [SEP] <Image 2> i.png [SEP] "
    assert got["t_1"].target_images == ["d/j.png", "d/i.png"]
    assert got["t_2"].target == "T [SEP] A, B [SEP] " and got["t_2"].target_images == []
    said = spark.createDataFrame([("i", "seen"), ("zz", "other")], "stem string, summary string")
    from pyspark.sql import functions as F

    both = S.with_summaries(df, said, F.filter(F.transform(F.flatten("cells"), lambda c: c["image"]), lambda x: x.isNotNull()), ["doc", "cid"])
    line = {r.cid: r for r in S.serialize_tables(both, ("summary",)).collect()}["t_1"]
    assert line.target.endswith("<Image 1> [SEP] <Image 2> seen [SEP] ") and line.target_images == []


def test_chunks_lose_no_row():
    header, lines = "T [SEP] h [SEP] ", ["<Image 1> a.png [SEP] ", "<Image 2> b.png [SEP] "]
    rows = [f"r{k} " + "w " * n + "[SEP] " for k, n in enumerate([3, 3, 50, 2, 3])]
    images = [[0], [], [1], [], [], []]
    for size in (5, 12, 20, 100):
        made = S.chunked(header, rows, images, lines, size)
        assert all(t.startswith("T [SEP] h") for t, _ in made)
        for k in range(5):
            assert sum(f"r{k} " in t for t, _ in made) == 1
        assert sum("<Image 1>" in t for t, _ in made) == 1 and sum("<Image 2>" in t for t, _ in made) == 1
        assert all(i[0] == 0 for _, i in made)
    assert S.chunked(header, [], [[0]], lines, 10) == [("T [SEP] h [SEP]<Image 1> a.png [SEP]", [0])]


def test_chunk_table(spark):
    df = spark.createDataFrame([table([[cell("h")], *[[cell(f"v{k}", "i.png" if k == 3 else None)] for k in range(6)]]), table([], cid="t_2"), table([[cell("h")]], cid="t_3")], SCHEMA)
    got = sorted((r.cid, r.target, r.images) for r in S.table_chunks(df, 12).collect())
    assert [g[0] for g in got if g[0].startswith("t_1")] == [f"t_1_c{k + 1}" for k in range(len([g for g in got if g[0].startswith("t_1")]))]
    assert "".join(g[1] for g in got).count("v") == 6
    assert [g for g in got if g[0].startswith("t_2")] == [] and [g[0] for g in got if g[0].startswith("t_3")] == ["t_3_c1"]


def test_images(spark):
    df = spark.createDataFrame([(1, "T", ["S"], "cap\n", None, "sum", "f.png"), (2, "T", None, None, "o", None, None), (3, "T", [], "c", None, None, "g.png")], "k int, title string, section array<string>, text string, ocr string, summary string, image string")
    got = {r.k: r for r in S.serialize_images(df).collect()}
    assert got[1].target == "T [SEP] S [SEP]  [SEP] cap  [SEP] sum" and got[1].target_images == ["f.png"]
    assert got[2].target == "T [SEP]  [SEP]   [SEP]  " and got[2].target_images == []
    assert got[3].target == "T [SEP]  [SEP]  [SEP] c"


def test_prompts(spark):
    none = None
    comps = [
        ("d", "p_1", "T", ["S"], "hello", none, none),
        ("d", "i_1", "T", [], "cap", "x.png", none),
        ("d", "t_1", "T", ["S", "U"], none, none, [[("a,b", none), ("", "t.png")], [("c", "u.png"), ("d", none)]]),
        ("d", "i_2", "T", [], none, "y.png", none),
    ]
    df = spark.createDataFrame(comps, "doc string, cid string, title string, section array<string>, text string, image string, rows array<array<struct<text:string,image:string>>>")
    ranked = spark.createDataFrame([(1, 1, "d", "i_1"), (1, 2, "d", "t_1"), (1, 3, "d", "p_1"), (1, 4, "d", "i_2"), (1, 5, "d", "gone"), (2, 1, "d", "p_1")], "qid int, rank int, doc string, cid string")
    asked = spark.createDataFrame([(1, "Why?"), (2, "How?"), (3, "unranked")], "qid int, question string")
    got = {r.qid: r for r in S.build_prompts(asked, ranked, df).collect()}
    assert sorted(got) == [1, 2] and got[1].images == ["x.png", "t.png", "y.png"]
    assert "Caption: cap\n*/" in got[1].prompt and "a , b | <Image 2>\nc | d\n*/" in got[1].prompt and "<Image 3>\n*/" in got[1].prompt
    assert got[1].prompt.startswith(S.WITH_IMAGES) and got[2].prompt.startswith(S.WITHOUT_IMAGES)
    assert got[2].prompt.endswith("/*\n[Passage]\nTitle: T\nSection: S\n\nhello\n*/\n\n\nQuestion = How?\nThe answer is: ")
    assert {r.qid: r.images for r in S.build_prompts(asked, ranked, df, 1, text_only=True).collect()} == {1: [], 2: []}


def test_page_prompts(spark):
    pages = spark.createDataFrame([("a", "a.png", "one"), ("b", "b.png", None)], "doc string, image string, summary string")
    ranked = spark.createDataFrame([(1, 2, "a"), (1, 1, "b")], "qid int, rank int, doc string")
    asked = spark.createDataFrame([(1, "Why?")], "qid int, question string")
    got = S.build_page_prompts(asked, ranked, pages).first()
    assert got.images == ["b.png", "a.png"] and got.prompt.count("Image summary") == 1 and "Why?" in got.prompt
    assert S.build_page_prompts(asked, ranked, pages, last_image_only=True).first().images == ["a.png"]
