"""Queries over documents, pages and tables as components, with their SQL.

Documents' lines are paragraphs; orders with their lines are tables, and
suppliers are what these link to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import models
from ..operators import corpus as C
from ..operators import evaluate, layout, questions, serialize, validate, vision
from ..operators import rank_eval as E
from ..sources import html, sinks
from ..streaming.ingest import ingest, paragraphs


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paragraphs(spark, sf_dir):
    return paragraphs(_read(spark, sf_dir, "documents"))


def sentence_split(spark, sf_dir):
    return C.sentences(_paragraphs(spark, sf_dir))


def text_serialize(spark, sf_dir):
    """Documents under their language and source, on one line each."""
    docs = _read(spark, sf_dir, "documents")
    title = F.concat(F.lit("Doc "), F.col("doc_id"))
    return docs.select("doc_id", serialize.text_line(title, F.array_compact(F.array("lang", "source")), F.col("text")).alias("target"))


def _edges(paragraphs):
    """Links of a paragraph by rule: seven characters from each 40th on, to the document that the offset names."""
    at = paragraphs.where("length(text) >= 7").select("doc", F.col("cid").alias("para"), "text", F.explode(F.sequence(F.lit(0), F.length("text") - 7, F.lit(40))).alias("start"))
    return at.select("doc", "para", "start", (F.col("start") + 7).alias("end"), F.expr("substring(text, start + 1, 7)").alias("text"), F.concat(F.lit("d"), F.col("start") % 100, F.lit(".json")).alias("edge"), F.concat(F.lit("/wiki/d"), F.col("start") % 100).alias("hyperlink"))


def edge_to_sentence(spark, sf_dir):
    paras = _paragraphs(spark, sf_dir)
    return C.edges_to_sentences(C.located(C.sentences(paras), paras), _edges(paras))


def edge_to_proposition(spark, sf_dir):
    """Propositions are all sentences."""
    paras = _paragraphs(spark, sf_dir)
    return C.edges_to_propositions(C.sentences(paras), _edges(paras))


def text_edge_counts(spark, sf_dir):
    edges = _edges(_paragraphs(spark, sf_dir))
    return C.edge_counts(C.inter_edges(edges.select("doc", F.col("para").alias("cid"), "edge")))


def text_component_stats(spark, sf_dir):
    paras = _paragraphs(spark, sf_dir).select("doc", "cid")
    return C.component_statistics(paras.unionByName(sentence_split(spark, sf_dir).select("doc", "cid")))


def sentence_children(spark, sf_dir):
    """Paragraphs with their number of sentences."""
    paras = _paragraphs(spark, sf_dir)
    found = C.children_of(paras.select("doc", "cid"), C.sentences(paras).select("doc", "cid"))
    return found.groupBy("doc", "top").agg(F.count("*").alias("n"))


def _tables(spark, sf_dir):
    """Orders as tables: a header row and a row for each line, the first column of a row shared with the row before by reference where the part's number is even."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    none = F.lit(None).cast("string")
    cell = lambda text, image=None, ref=None: F.struct(text.alias("text"), F.lit(False).alias("header"), (none if image is None else image).alias("image"), (none if ref is None else ref).alias("ref"))
    name = F.concat(F.lit("Part, no "), F.col("l_partkey"))
    picture = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("img/p"), F.col("l_partkey") % 7, F.lit(".png")))
    shared = F.when(F.col("l_returnflag") == "R", F.lit("1"))
    row = F.array(cell(name, picture), cell(F.concat(F.lit(" S"), F.col("l_suppkey")), None, shared), cell(F.col("l_linestatus")))
    head = F.array(*[cell(F.lit(x)) for x in ("Part", "Supplier,code", "Status")])
    rows = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    refs = F.create_map(F.lit("1"), cell(F.lit("returned,\nboth"), F.lit("img/r.png")))
    return rows.select("doc", F.lit("t_1").alias("cid"), F.concat(F.lit("Order "), F.col("doc")).alias("title"), F.array(F.lit("Orders"), F.lit("Lines")).alias("section"), F.concat(F.array(head), "rows").alias("cells"), refs.alias("refs"))


def _summaries(spark):
    return spark.createDataFrame([(f"p{k}", f"picture {k}") for k in range(0, 7, 2)] + [("r", "")], "stem string, summary string")


def table_segments(spark, sf_dir):
    """Segments of tables, serialised like tables."""
    return serialize.serialize_tables(C.table_segments(_tables(spark, sf_dir)), ("image",)).select("doc", "cid", "target", F.array_join("target_images", "|").alias("images"))


def table_serialize(spark, sf_dir):
    t = _tables(spark, sf_dir)
    paths = F.filter(F.transform(F.flatten("cells"), lambda c: c["image"]), lambda x: x.isNotNull())
    t = serialize.with_summaries(t, _summaries(spark), F.concat(paths, F.array(F.lit("img/r.png"))), ["doc", "cid"])
    return serialize.serialize_tables(t).select("doc", "cid", "target", F.array_join("target_images", "|").alias("images"))


def table_chunks(spark, sf_dir):
    return serialize.table_chunks(_tables(spark, sf_dir), 40, ("image",))


def _image_rows(spark, sf_dir):
    """Suppliers as images, some without a file, a caption or OCR text."""
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("doc"), F.lit("i_1").alias("cid"), F.col("s_name").alias("title"), F.array(F.lit("Pictures")).alias("section"),
        F.when(k % 3 > 0, F.concat(F.lit("caption\n"), k)).alias("text"), F.when(k % 4 > 0, F.concat(F.lit("ocr "), k)).alias("ocr"),
        F.when(k % 5 > 0, F.concat(F.lit("f"), k % 11, F.lit("/x.png"))).alias("image"),
    )


def image_serialize(spark, sf_dir):
    rows = _image_rows(spark, sf_dir).withColumn("stem", serialize.summary_stem(F.col("image")))
    known = spark.createDataFrame([(f"f{k}", f"summary {k}") for k in range(8)], "stem string, summary string")
    made = serialize.serialize_images(rows.join(F.broadcast(known), "stem", "left"), ("image", "summary", "ocr"))  # the fixture has eight summaries
    return made.select("doc", "target", F.array_join("target_images", "|").alias("images"))


def subimage_ids(spark, sf_dir):
    """Sub-images registered from a listing of files by rule."""
    images = _image_rows(spark, sf_dir).select("doc", "cid", F.concat(F.lit("f"), F.col("doc") % 11, F.lit(".png")).alias("filename"), "text")
    names = [(f"f{k}", n) for k in range(9) for n in ("1_table.png", "2_figure_x.png", "boxed.png", "detections.json")]
    return C.subimages(images, spark.createDataFrame(names, "folder string, name string"))


def prompt_build(spark, sf_dir):
    """Prompts of customers from their orders' tables, their own line of text and a picture."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    t = _tables(spark, sf_dir)
    rows = t.select("doc", "cid", "title", "section", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("image"), serialize.resolved(F.col("cells"), F.col("refs")).alias("rows"))
    none = F.lit(None).cast(rows.schema["rows"].dataType)
    texts = orders.select(F.col("o_orderkey").alias("doc"), F.lit("p_1").alias("cid"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.array(F.lit("Text")).alias("section"), F.concat(F.lit("Of customer "), F.col("o_custkey")).alias("text"), F.lit(None).cast("string").alias("image"), none.alias("rows"))
    pictures = texts.select("doc", F.lit("i_1").alias("cid"), "title", "section", "text", F.when(F.col("doc") % 2 == 0, F.concat(F.lit("o"), F.col("doc"), F.lit(".png"))).alias("image"), "rows")
    components = rows.unionByName(texts).unionByName(pictures)
    placed = orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc"), F.explode(F.array(F.lit("i_1"), F.lit("p_1"), F.lit("t_1"))).alias("cid"))
    ranked = C.first_seen(placed, ["qid", "doc", "cid"], ["doc", "cid"]).withColumnRenamed("pos", "rank")
    asked = orders.select(F.col("o_custkey").alias("qid")).distinct().withColumn("question", F.concat(F.lit("What did customer "), F.col("qid"), F.lit(" order?")))
    return serialize.build_prompts(asked, ranked, components, 5).select("qid", "prompt", F.array_join("images", "|").alias("images"))


def page_prompt_build(spark, sf_dir):
    s = _image_rows(spark, sf_dir)
    pages = s.select(F.col("doc").cast("string").alias("doc"), "image", F.col("ocr").alias("summary"))
    ranked = s.select((F.col("doc") % 10).alias("qid"), ((F.col("doc") - F.col("doc") % 10) / 10 + 1).cast("int").alias("rank"), F.col("doc").cast("string").alias("doc"))
    asked = spark.range(10).select(F.col("id").alias("qid"), F.concat(F.lit("Q"), F.col("id")).alias("question"))
    return serialize.build_page_prompts(asked, ranked, pages).select("qid", "prompt", F.array_join("images", "|").alias("images"))


def layout_containment(spark, sf_dir):
    """Parts as boxes on their brand's image, by rule."""
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    x1, y1 = k * 7 % 40, k * 11 % 40
    boxes = p.select(
        F.concat(F.col("p_brand"), (k % 9).cast("string")).alias("image"), (k % 3).cast("int").alias("class_id"), F.element_at(F.array(F.lit("title"), F.lit("figure"), F.lit("text")), (k % 3 + 1).cast("int")).alias("class"),
        (k % 10 / 10.0).cast("double").alias("confidence"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("p_size") % 20 + 1).alias("x2"), (y1 + F.col("p_size") % 15 + 1).alias("y2"),
    )
    return layout.filter_boxes(boxes)


def image_fit(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    w, h = F.col("p_partkey") * 13 % 2000 + 1, F.col("p_size") * 40
    fw, fh = layout.fit(w, h)
    return p.select("p_partkey", fw.alias("w"), fh.alias("h"))


def reading_plan(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("figure", "table", "table_caption", "figure_caption", "plain text")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    ending = F.when(F.col("p_partkey") % 11 == 0, ".json").when(F.col("p_partkey") % 13 == 0, "_result.png").otherwise(".png")
    return layout.reading_plan(p.select(F.concat(F.col("p_partkey").cast("string"), F.lit("_"), kinds, ending).alias("name")))


def pending_antijoin(spark, sf_dir):
    """Documents without a label."""
    return C.pending(_read(spark, sf_dir, "documents").select("doc_id", "lang"), _read(spark, sf_dir, "labels"), "doc_id")


def validate_dataset(spark, sf_dir):
    """Documents against rules, a row for each rule that one fails."""
    rules = {"text": "length(text) > 50", "lines": "instr(text, chr(10)) > 0", "source": "source like 'src%'", "count": "n_chars = length(text)"}
    return validate.rule_problems(_read(spark, sf_dir, "documents"), "doc_id", rules)


def html_blocks(spark, sf_dir):
    parsed = html.parse_pages(_read(spark, sf_dir, "pages"))
    return parsed.select("page_id", "pos", "cid", "kind", "title", F.array_join("section", " > ").alias("section"), "text")


def html_links(spark, sf_dir):
    """All links of pages."""
    return html.anchors(_read(spark, sf_dir, "pages"))


def html_titles(spark, sf_dir):
    return html.parse_pages(_read(spark, sf_dir, "pages")).where("kind = 'title'").select("page_id", "title")


def page_components(spark, sf_dir):
    return C.component_statistics(C.components(html.parse_pages(_read(spark, sf_dir, "pages")), "page_id"))


def link_dereference(spark, sf_dir):
    """Links by rule, written in three ways, to nations that have customers."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    kind, at = F.col("o_orderkey") % 4, (F.col("o_custkey") % 30).cast("string")
    link = F.when(kind == 0, F.concat(F.lit("/wiki/N"), at)).when(kind == 1, F.concat(F.lit(C.SITE + "/wiki/N"), at)).when(kind == 2, F.concat(F.lit("/wiki/%4E"), at)).otherwise("")
    titles = nation.select(F.concat(F.lit(C.SITE + "/wiki/N"), F.col("n_nationkey")).alias("url"), F.col("n_name").alias("title"))
    documents = _read(spark, sf_dir, "customer").select((F.col("c_nationkey") % 20).alias("k")).distinct().join(nation, F.col("k") == F.col("n_nationkey")).select(F.col("n_name").alias("title"))
    return C.dereference(orders.select("o_orderkey", link.alias("hyperlink")), titles, documents)


def image_resolution(spark, sf_dir):
    """Thumbnails by rule, with files that are known, gone and unknown."""
    p = _read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "https://elsewhere.org/a.png").otherwise(F.concat(F.lit("https:" + C.THUMBS + "/"), F.col("p_partkey") % 10, F.lit(".png"))).alias("image"))
    thumbs = spark.createDataFrame([(f"{C.THUMBS}/{k}.png", f"file{k}.png") for k in range(8)], "url string, name string")
    files = spark.createDataFrame([(f"file{k}.png",) for k in range(6)], "name string")
    return C.resolve_images(p, thumbs, files)


def benchmark_evidence(spark, sf_dir):
    """Benchmark passages with the number of documents that contain them, and the first one."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    items = _read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    found = C.containing(docs, items)
    return found.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def document_scan(spark, sf_dir):
    """Documents as parsed ones: paragraphs, sentences and a picture each, all seven kinds scanned."""
    docs = _read(spark, sf_dir, "documents")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t, i: F.struct(F.concat(F.lit("p_"), i + 1), F.struct(t.alias("text"))))
    none = F.create_map().cast("map<string,struct<text:string>>")
    picture = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("i_1"), F.struct(F.struct(F.col("lang").alias("text")).alias("caption")))).otherwise(F.create_map().cast("map<string,struct<caption:struct<text:string>>>"))
    parsed = docs.select(F.col("doc_id").alias("file"), F.map_from_entries(lines).alias("text"), *[none.alias(k) for k in ("table", "sentence", "proposition", "table_segment", "subimage")], picture.alias("image"))
    return C.document_components(parsed)


def cell_images(spark, sf_dir):
    """Orders' tables with addresses of pictures in cells, of which some have files; serialised."""
    t = _tables(spark, sf_dir)
    web = lambda c: c.withField("image", F.when(c["image"].isNotNull(), F.concat(F.lit("https://x.org/?u=" + C.THUMBS + "/"), c["image"])))
    t = t.withColumn("cells", F.transform("cells", lambda r: F.transform(r, web))).withColumn("refs", F.transform_values("refs", lambda _, c: web(c)))
    names = [f"img/p{k}.png" for k in range(0, 7, 2)] + ["img/r.png"]
    thumbs = spark.createDataFrame([(f"{C.THUMBS}/{n}", n) for n in names], "url string, name string")
    bound = C.with_cell_images(t, thumbs, thumbs.select("name").where("name <> 'img/p4.png'"), ["doc", "cid"])
    return serialize.serialize_tables(bound, ("image",)).select("doc", F.array_join("target_images", "|").alias("images"))


def serialize_everything(spark, sf_dir):
    """Rows and characters of all components' lines."""
    docs = _paragraphs(spark, sf_dir).select(F.col("doc").cast("string").alias("doc"), "cid", F.lit("T").alias("title"), F.array(F.lit("S")).alias("section"), "text")
    t = _tables(spark, sf_dir).withColumn("doc", F.col("doc").cast("string"))
    images = _image_rows(spark, sf_dir).withColumn("doc", F.col("doc").cast("string")).withColumn("summary", F.lit(None).cast("string"))
    made = serialize.serialize_all(docs, t, images, ("image",))
    return made.groupBy(F.substring("cid", 1, 1).alias("letter")).agg(F.count("*").alias("n"), F.sum(F.length("target")).alias("chars"), F.sum(F.size("images")).cast("bigint").alias("images"))


def detected_boxes(spark, sf_dir):
    """Boxes in made-up answers, some cut off."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    one = lambda k: F.concat(F.lit('{"bbox_2d": ['), (F.col("p_size") + k), F.lit(', 2, 30, 4.5], "class": "'), F.lit("ab"[k % 2]), F.lit('"}'))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("```json\n["), one(0), F.lit(", "), one(1), F.lit("]"))).when(F.col("p_partkey") % 3 == 1, F.concat(one(0), F.lit(', {"bbox_2d": [1, 2'))).otherwise("none")
    return vision.detections(p.select(F.col("p_partkey").cast("string").alias("image"), raw.alias("raw")))


def result_tables(spark, sf_dir):
    """Customers' balances by segment as if they were figures of algorithms on sets."""
    c = _read(spark, sf_dir, "customer")
    figures = c.groupBy(F.col("c_mktsegment").alias("algorithm"), F.concat(F.lit("set"), F.col("c_nationkey") % 3).alias("dataset")).agg(F.max("c_acctbal").alias("value"))
    return evaluate.result_table(figures.withColumn("metric", F.lit("recall")), ["set0", "set1", "set2", "set3"])


def _echo():
    """A stand-in for a language model: the words of the question of over five letters as requests."""
    import json
    import re

    def ask(prompt: str) -> str:
        question = prompt.split("Question: ")[-1].split("\n")[0]
        words = re.findall(r"[A-Za-z]{6,}", question)
        return "```json\n" + json.dumps(words) + "\n```" if words else question

    return ask


def decompose_questions(spark, sf_dir):
    """Users' whole first turns as questions, by a stand-in model; done ones left out."""
    conv = _read(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("qid"), F.col("text").alias("question"))
    conv = conv.withColumn("question", F.regexp_replace("question", r"[^A-Za-z ]", " "))
    return questions.decompose(conv, _echo, conv.where("qid % 5 = 0").select("qid"))


def encode_components(spark, sf_dir):
    """The hashing encoder's vectors of the benchmark, as lengths and places of the largest value."""
    made = models.encode(_read(spark, sf_dir, "benchmark"), models.HashingEncoder)
    return made.select("item_id", F.size("vec").alias("dim"), F.array_position("vec", F.array_max("vec")).alias("at"))


def encoding_plan(spark, sf_dir):
    """Lengths and batches by set: own parameters before those of the type."""
    parameters = {("hashing", "page", "text"): (256, 32), ("hashing", "web", "text"): (1024, 16), ("hashing", "web", "table"): (512, 10), ("hashing", "set2", "text"): (64, 8), ("other", "page", "table"): (1, 1)}
    return models.encoding_plan(spark, [("set1", "page"), ("set2", "web"), ("set3", "none")], ["text", "table"], parameters, "hashing")


def stream_sentences(spark, sf_dir):
    """The sentences of documents by a stream that ends when all files are read."""
    from ..checkpoints import shared_folder

    out = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path = f"{sf_dir}/documents.parquet"
    # A table is one file or a folder of files.
    folder, pattern = (path, "*") if sinks.is_folder(spark, path) else (sf_dir, "documents.parquet")
    ingest(spark, folder, spark.read.parquet(path).schema, out, pattern).awaitTermination()
    return spark.read.parquet(f"{out}/sentences").drop("batch")


def baseline_pages(spark, sf_dir):
    """Orders' lines as ranked page images."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    unit = F.struct(F.array(F.struct(F.concat(F.lit("doc_x_"), F.col("l_partkey"), F.lit(".jpeg")).alias("doc"), F.lit("i_1").alias("cid"))).alias("nodes"))
    results = lines.groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", unit.alias("u")))), lambda x: x["u"]).alias("units"))
    return E.parse_baseline(results, (".jpeg", ".jpg"))


_P = r"""with para as (select doc_id as doc, 'p_' || k as cid, t as text from (select doc_id, unnest(range(1, len(l) + 1)) as k, unnest(l) as t from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)) where t <> ''),
sent as (select doc, cid as para, cid || '_s' || k as cid, (k - 1)::int as pos, s as text from (select doc, cid, unnest(range(1, len(l) + 1)) as k, unnest(l) as s from (select doc, cid,
    case when len(regexp_extract_all(text, '[^.!?]+[.!?]*\s*')) > 0 then regexp_extract_all(text, '[^.!?]+[.!?]*\s*') else [text] end as l from para)) where s <> ''),
edge as (select doc, cid as para, o as start, o + 7 as "end", substr(text, o + 1, 7) as text, 'd' || o % 100 || '.json' as edge, '/wiki/d' || o % 100 as hyperlink
    from (select *, unnest(range(0, length(text) - 6, 40))::int as o from para where length(text) >= 7))"""
def _unescaped(x):
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


_PAGES = rf"""with t as (select page_id, {_unescaped("x")} as x, {_unescaped("y")} as y from (
    select page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) as x, regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)(?:</article>|$)', 1), '<[^>]*>', ' ', 'g') as y from pages)),
p as (select page_id, trim(x) as title, trim(regexp_replace(y, '[ \n\t]+', ' ', 'g')) as said from t)"""
_TBL = """with line as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, {full}) as k, ('Part , no ' || l_partkey) as part,
    case when l_partkey % 3 = 0 then 'img/p' || l_partkey % 7 || '.png' end as img, 'S' || l_suppkey as supp, l_returnflag = 'R' as ret, l_linestatus as st from lineitem),
cell as (select doc, k, 2 * k as o, img as path from line where img is not null union all select doc, k, 2 * k + 1, 'img/r.png' from line where ret)"""
_TBL = _TBL.format(full="l_partkey::varchar, l_suppkey::varchar, l_returnflag = 'R', l_linestatus")
_ROW = "part || case when i.n is not null then ' <Image ' || i.n || '>' else '' end || ', ' || case when ret then 'returned , both <Image ' || r.n || '>' else supp end || ', ' || st || ' [SEP] '"
_HEAD = "'Order ' || l.doc || ' [SEP] Orders, Lines [SEP] Part, Supplier , code, Status [SEP] '"


def _sql(text):
    """Text as SQL, line ends written out."""
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n"))


_PAGE_A, _PAGE_B = (_sql(x) for x in serialize.PAGE.split("{}"))
_LINE = """case when f.o = 2 * k then '<Image ' || num || '> , ' else '' end || part || ' | ' || case when ret then case when f.o = 2 * k + 1 then '<Image ' || num || '> , ' else '' end || 'returned , both' else ' ' || supp end || ' | ' || st || chr(10)"""

QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, text_serialize, edge_to_sentence, edge_to_proposition, text_edge_counts, text_component_stats, sentence_children, table_segments, table_serialize, table_chunks, image_serialize, subimage_ids, prompt_build, page_prompt_build,
        layout_containment, image_fit, reading_plan, pending_antijoin, validate_dataset, html_blocks, html_links, html_titles, page_components, link_dereference, image_resolution, benchmark_evidence, decompose_questions, encode_components,
        encoding_plan, stream_sentences, baseline_pages, document_scan, cell_images, serialize_everything, detected_boxes, result_tables,
    )
}

ORACLES = {
    "sentence_split": f"{_P} select doc, cid, pos, text from sent",
    "stream_sentences": f"{_P} select doc, cid, pos, text from sent",
    "text_serialize": "select doc_id, translate('Doc ' || doc_id || ' [SEP] ' || concat_ws(', ', lang, source) || ' [SEP] ' || coalesce(text, ''), chr(10) || chr(9), '  ') as target from documents",
    "edge_to_sentence": f"""{_P}, placed as (select s.*, instr(p.text, s.text) - 1 as o from sent s join para p on p.doc = s.doc and p.cid = s.para)
select e.doc, s.cid, (start - o)::int as start, ("end" - o)::int as "end", e.text, edge, hyperlink from edge e join placed s on s.doc = e.doc and s.para = e.para and o <= start and "end" <= o + length(s.text)
qualify row_number() over (partition by e.doc, e.para, start order by o, pos) = 1""",
    "edge_to_proposition": f"""{_P} select e.doc, s.cid, e.text, edge, hyperlink from edge e join sent s on s.doc = e.doc and s.para = e.para
where list_has_all(regexp_extract_all(lower(s.text), '[a-z0-9]+'), regexp_extract_all(lower(e.text), '[a-z0-9]+'))""",
    "text_edge_counts": f"{_P} select 'text' as modality, count(*) as n from (select distinct doc, para, edge from edge)",
    "text_component_stats": f"""{_P}, c as (select doc from para union all select doc from sent), s as (select count(*) as n, count(*) / count(distinct doc) as per_doc from c)
select 'text' as modality, * from s union all select 'all', * from s""",
    "sentence_children": f"{_P} select doc, para as top, count(*) as n from sent group by all",
    "table_segments": f"""{_TBL} select l.doc, 't_1_s' || k as cid, replace({_HEAD} || {_ROW.replace("i.n", "case when img is not null then 1 end").replace("r.n", "case when img is not null then 2 else 1 end")}
    || case when img is not null then '<Image 1> ' || img[5:] || ' [SEP] ' else '' end || case when ret then '<Image ' || case when img is not null then 2 else 1 end || '> r.png [SEP] ' else '' end, chr(10), ' ') as target,
    concat_ws('|', img, case when ret then 'img/r.png' end) as images from line l""",
    "table_serialize": f"""{_TBL}, num as (select doc, path, row_number() over (partition by doc order by o) as n from (select doc, path, min(o) as o from cell group by doc, path)),
pics as (select doc, string_agg('<Image ' || n || '> ' || path[5:] || case when path[6:6]::varchar in ('0', '2', '4', '6') then ' picture ' || path[6:6] else '' end || ' [SEP] ', '' order by n) as t, string_agg(path, '|' order by n) as images from num group by doc),
body as (select l.doc, string_agg({_ROW}, '' order by k) as t from line l left join num i on i.doc = l.doc and i.path = l.img left join num r on r.doc = l.doc and r.path = 'img/r.png' group by l.doc)
select l.doc, 't_1' as cid, {_HEAD} || l.t || coalesce(pics.t, '') as target, coalesce(images, '') as images from body l left join pics on pics.doc = l.doc""",
    "serialize_everything": f"""{_TBL}, num as (select doc, path, row_number() over (partition by doc order by o) as n from (select doc, path, min(o) as o from cell group by doc, path)),
pics as (select doc, sum(length('<Image ' || n || '> ' || path[5:] || ' [SEP] ')) as c, count(*) as images from num group by doc),
body as (select l.doc, sum(length({_ROW})) as c from line l left join num i on i.doc = l.doc and i.path = l.img left join num r on r.doc = l.doc and r.path = 'img/r.png' group by l.doc),
para as (select t from (select unnest(string_split(text, chr(10))) as t from documents where text is not null) where t <> '')
select 'p' as letter, count(*) as n, sum(16 + length(t))::bigint as chars, 0::bigint as images from para
union all select 't', count(*), sum(length({_HEAD}) + l.c + coalesce(pics.c, 0))::bigint, coalesce(sum(images), 0)::bigint from body l left join pics on pics.doc = l.doc
union all select 'i', count(*), sum(length(s_name || ' [SEP] Pictures [SEP] ' || case when s_suppkey % 3 > 0 then ' [SEP] caption' || chr(10) || s_suppkey else ' ' end))::bigint, count(case when s_suppkey % 5 > 0 then 1 end) from supplier""",
    "image_serialize": """select s_suppkey as doc, replace(s_name || ' [SEP] Pictures [SEP] ' || case when s_suppkey % 3 > 0 then ' [SEP] caption' || chr(10) || s_suppkey else ' ' end
    || case when s_suppkey % 5 = 0 then ' [SEP]  ' when s_suppkey % 11 < 8 then ' [SEP] summary ' || s_suppkey % 11 else '' end
    || ' [SEP] ' || case when s_suppkey % 4 > 0 then ' [SEP] ocr ' || s_suppkey else ' ' end, chr(10), ' ') as target, case when s_suppkey % 5 > 0 then 'f' || s_suppkey % 11 || '/x.png' else '' end as images from supplier""",
    "subimage_ids": """select s_suppkey as doc, 'i_1_s' || n as cid, 'f' || s_suppkey % 11 || '/' || case n when 1 then '1_table.png' else '2_figure_x.png' end as path,
    case when s_suppkey % 3 > 0 then 'caption' || chr(10) || s_suppkey end as text from supplier, (values (1), (2)) v(n) where s_suppkey % 11 < 9""",
    "layout_containment": """with b as (select p_brand || p_partkey % 9 as image, (p_partkey % 3)::int as class_id, ['title', 'figure', 'text'][p_partkey % 3 + 1] as class, (p_partkey % 10 / 10.0)::double as confidence,
    p_partkey * 7 % 40 as x1, p_partkey * 11 % 40 as y1, p_partkey * 7 % 40 + p_size % 20 + 1 as x2, p_partkey * 11 % 40 + p_size % 15 + 1 as y2 from part where p_partkey % 10 >= 2),
u as (select * from b qualify row_number() over (partition by image, x1, y1, x2, y2 order by class_id, confidence desc, class) = 1),
n as (select *, (row_number() over (partition by image order by y1, x1, x2, y2) - 1)::int as idx from u)
select * from n a where not exists (select 1 from u b where b.image = a.image and b.x1 <= a.x1 and b.y1 <= a.y1 and b.x2 >= a.x2 and b.y2 >= a.y2 and (b.x1, b.y1, b.x2, b.y2) <> (a.x1, a.y1, a.x2, a.y2) and (a.class = 'figure') = (b.class = 'figure'))""",
    "image_fit": "with d as (select p_partkey, (p_partkey * 13 % 2000 + 1)::double as w, (p_size * 40)::double as h from part) select p_partkey, greatest(trunc(w * least(640.0::double / w, 640.0::double / h)), 1)::int as w, greatest(trunc(h * least(640.0::double / w, 640.0::double / h)), 1)::int as h from d",
    "reading_plan": """select p_partkey || '_' || ['figure', 'table', 'table_caption', 'figure_caption', 'plain text'][p_partkey % 5 + 1] || '.png' as name, ['figure_ocr,description', 'table_ocr', 'table_ocr', 'figure_ocr,description', 'ocr'][p_partkey % 5 + 1] as steps
from part where p_partkey % 11 <> 0 and p_partkey % 13 <> 0""",
    "pending_antijoin": "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "validate_dataset": """select doc_id, problem from (select doc_id, unnest(['text', 'lines', 'source', 'count']) as problem,
    unnest([coalesce(length(text) > 50, false), coalesce(instr(text, chr(10)) > 0, false), coalesce(source like 'src%', false), coalesce(n_chars = length(text), false)]) as good from documents) where not good""",
    "html_titles": r"select page_id, trim(replace(replace(replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as title from pages",
    "html_links": r"""with m as (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as l from pages), a as (select page_id, unnest(range(0, len(l))) as k, unnest(l) as x from m)
select page_id, k::int as k, regexp_extract(x, '>([^<]*)<', 1) as text, regexp_extract(x, 'href="([^"]*)"', 1) as hyperlink from a""",
    "link_dereference": """with o as (select o_orderkey, o_custkey % 30 as n, o_orderkey % 4 as k from orders)
select o_orderkey, case k when 0 then '/wiki/N' || n when 1 then 'https://en.wikipedia.org/wiki/N' || n else '/wiki/%4E' || n end as hyperlink, n_name || '.json' as edge
from o join nation on n_nationkey = n where k < 3 and n in (select c_nationkey % 20 from customer)""",
    "image_resolution": """select p_partkey, case when p_partkey % 7 = 0 then 'https://elsewhere.org/a.png' else 'https:https://upload.wikimedia.org/' || p_partkey % 10 || '.png' end as image,
    case when p_partkey % 7 <> 0 and p_partkey % 10 < 6 then 'file' || p_partkey % 10 || '.png' end as filename from part""",
    "benchmark_evidence": "select item_id, count(*) as n, min(doc_id) as first_doc from benchmark b join documents d on contains(d.text, b.text) group by item_id",
    "encoding_plan": "select * from (values ('set1', 'text', 256::int, 32::int), ('set2', 'text', 64, 8), ('set2', 'table', 512, 10)) v(dataset, component, max_length, batch_size)",
    "document_scan": """with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l, lang from documents)
select doc_id as doc, 'p_' || k as cid, 'text' as kind, 'top' as level, t as text from (select doc_id, unnest(range(1, len(l) + 1)) as k, unnest(l) as t from l)
union all select doc_id, 'i_1', 'image', 'top', lang from l where doc_id % 3 = 0""",
    "cell_images": f"{_TBL}, num as (select doc, path, min(o) as o from cell where path in ('img/p0.png', 'img/p2.png', 'img/p6.png', 'img/r.png') group by doc, path) select doc, coalesce(string_agg(path, '|' order by o) filter (where path is not null), '') as images from (select distinct doc from line) left join num using (doc) group by doc",
    "detected_boxes": """select p_partkey::varchar as image, k::int as k, ['a', 'b'][k] as class, (p_size + k - 1)::double as x1, 2::double as y1, 30::double as x2, 4.5::double as y2, k || '_' || ['a', 'b'][k] || '.png' as name
from part, (values (1), (2)) v(k) where p_partkey % 3 = 0 or p_partkey % 3 = 1 and k = 1""",
    "result_tables": """with f as (select c_mktsegment as algorithm, c_nationkey % 3 as s, max(c_acctbal) as v from customer group by all)
select algorithm, max(v) filter (where s = 0) as set0, max(v) filter (where s = 1) as set1, max(v) filter (where s = 2) as set2, null::double as set3, avg(v order by s) as mean from f group by algorithm""",
    "page_prompt_build": f"""with s as (select s_suppkey as doc, s_suppkey % 10 as qid, (s_suppkey - s_suppkey % 10) // 10 + 1 as r from supplier)
select qid, coalesce(string_agg({_sql("/* " + chr(10) + chr(10) + " Image summary: ocr ")} || doc || {_sql(chr(10) + chr(10) + " */" + chr(10))}, '' order by r) filter (where doc % 4 > 0), '') || {_PAGE_A} || 'Q' || qid || {_PAGE_B} as prompt,
    coalesce(string_agg('f' || doc % 11 || '/x.png', '|' order by r) filter (where doc % 5 > 0), '') as images from s where r <= 3 group by qid""",
    "prompt_build": f"""{_TBL}, placed as (select o_custkey as qid, o_orderkey as doc, cid, row_number() over (partition by o_custkey order by o_orderkey, cid) as r from orders, (values ('i_1'), ('p_1'), ('t_1')) v(cid) qualify r <= 5),
f as (select doc, arg_min(path, o) as path, min(o) as o from cell group by doc),
c as (select p.*, case when cid = 't_1' then f.path when cid = 'i_1' and p.doc % 2 = 0 then 'o' || p.doc || '.png' end as shown from placed p left join f on f.doc = p.doc where cid <> 't_1' or p.doc in (select doc from line)),
n as (select *, 1 + coalesce(count(shown) over (partition by qid order by r rows between unbounded preceding and 1 preceding), 0) as num from c),
t as (select n.qid, n.doc, string_agg({_LINE}, '' order by k) as body from n join line l on l.doc = n.doc left join f on f.doc = n.doc where cid = 't_1' group by n.qid, n.doc),
x as (select n.*, case cid when 'p_1' then {_sql("/*" + chr(10) + "[Passage]" + chr(10) + "Title: Order ")} || n.doc || {_sql(chr(10) + "Section: Text" + chr(10) + chr(10) + "Of customer ")} || n.qid || {_sql(chr(10) + "*/" + chr(10) + chr(10))}
    when 'i_1' then {_sql("/*" + chr(10) + "[Image]" + chr(10) + "Title: Order ")} || n.doc || {_sql(chr(10) + "Section: Text" + chr(10) + chr(10))} || case when shown is not null then '<Image ' || num || '>' || chr(10) else '' end || 'Caption: Of customer ' || n.qid || {_sql(chr(10) + "*/" + chr(10) + chr(10))}
    else {_sql("/*" + chr(10) + "[Table]" + chr(10) + "Title: Order ")} || n.doc || {_sql(chr(10) + "Section: Orders, Lines" + chr(10) + chr(10) + "Part | Supplier , code | Status" + chr(10))} || t.body || {_sql("*/" + chr(10) + chr(10))} end as part from n left join t on t.qid = n.qid and t.doc = n.doc)
select qid, case when count(shown) > 0 then {_sql(serialize.WITH_IMAGES)} else {_sql(serialize.WITHOUT_IMAGES)} end || {_sql(serialize.EXAMPLE + chr(10))} || string_agg(part, chr(10) order by r) || {_sql(chr(10) + "Question = What did customer ")} || qid || {_sql(" order?" + chr(10) + "The answer is: ")} as prompt,
    coalesce(string_agg(shown, '|' order by r) filter (where shown is not null), '') as images from x group by qid""",
    "decompose_questions": """with q as (select conv_id as qid, regexp_replace(text, '[^A-Za-z ]', ' ', 'g') as question from conversations where turn = 0 and conv_id % 5 <> 0),
w as (select *, regexp_extract_all(question, '[A-Za-z]{6,}') as w from q), r as (select qid, case when len(w) > 0 then w else [question] end as w from w)
select qid, (k - 1)::int as sq_pos, qid || '___' || (k - 1) as sqid, w[k] as subquery from (select *, unnest(range(1, len(w) + 1)) as k from r)""",
    "baseline_pages": "select l_orderkey as qid, 'doc_x' as doc, 'doc_x_' || l_partkey as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey || '.jpeg')::int as rank from lineitem",
    "table_chunks": f"""{_TBL.replace("with line", "with recursive line", 1)}, num as (select doc, path, min(o) as o, row_number() over (partition by doc order by min(o)) as n from cell group by doc, path),
fresh as (select doc, o // 2 as k, list(n order by n) as ns, string_agg('<Image ' || n || '> ' || path[5:] || ' [SEP] ', '' order by n) as lines from num group by doc, o // 2),
body as (select l.doc, l.k, {_ROW} as t, {_HEAD} as head from line l left join num i on i.doc = l.doc and i.path = l.img left join num r on r.doc = l.doc and r.path = 'img/r.png'),
cost as (select body.*, ns, lines, len(list_filter(string_split(head, ' '), lambda x: x <> '')) as base, len(list_filter(string_split(t, ' '), lambda x: x <> '')) + 4 * coalesce(len(ns), 0) as n from body left join fresh using (doc, k)),
dealt as (select doc, k, 1 as chunk, base + n as used from cost where k = 1
    union all select c.doc, c.k, case when used + n > 40 then chunk + 1 else chunk end, case when used + n > 40 then base + n else used + n end from dealt d join cost c on c.doc = d.doc and c.k = d.k + 1)
select doc, 't_1_c' || chunk as cid, trim(any_value(head) || string_agg(t, '' order by k)) || coalesce(trim(string_agg(lines, '' order by k)), '') as target,
    array_to_string(coalesce(flatten(list(ns order by k) filter (where ns is not null)), []), ',') as images from cost join dealt using (doc, k) group by doc, chunk""",
    "html_blocks": f"{_PAGES} select page_id, 0 as pos, 'h1_1' as cid, 'title' as kind, title, '' as section, title as text from p union all select page_id, 1, 'po_1', 'passage', title, '', ' ' || said from p where said <> ''",
    "page_components": f"{_PAGES}, c as (select count(*) as n, count(*) / count(distinct page_id) as per_doc from p where said <> '') select 'text' as modality, * from c union all select 'all', * from c",
    "encode_components": """with w as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from benchmark), h as (select item_id, ('0x' || substr(md5(w), 1, 12))::bigint as h from w),
v as (select item_id, h // 2 % 64 as d, sum(case when h % 2 = 1 then 1 else -1 end) as n from h group by all),
a as (select item_id, d, coalesce(n, 0) as n from (select item_id, unnest(range(64)) as d from benchmark) left join v using (item_id, d))
select item_id, 64::int as dim, min(d + 1) as at from a join (select item_id, max(n) as n from a group by item_id) using (item_id, n) group by item_id""",
}
