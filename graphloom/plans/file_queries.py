"""Queries that write to the shared folder what readers read back, and those of the entries to whole runs, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types

from .. import config
from ..checkpoints import shared_folder, spread
from ..functions import models, pixels
from ..operators import corpus as C
from ..operators import evaluate, questions, steps, validate, vision
from ..operators import retrieve as R
from ..operators import text_eval as T
from ..sources import html, readers, sinks, vectors
from ..validate_set import report
from . import corpus_queries as Q
from . import eval_queries, vector_queries
from .vector_queries import _G, BEAM, K


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def json_lines(spark, sf_dir):
    """Orders appended as JSON lines by two writers and read back."""
    out = f"{_folder(spark)}/orders.jsonl"
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for rest in (0, 1):
        sinks.append_lines(orders.where(F.col("o_orderkey") % 2 == rest), out)
    return readers.read_json(spark, out, orders.schema)


def json_overwrite(spark, sf_dir):
    """Regions written over nations."""
    out = f"{_folder(spark)}/names.jsonl"
    sinks.overwrite_json(_read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), out)
    sinks.overwrite_json(_read(spark, sf_dir, "region").select(F.col("r_name").alias("name")), out)
    return readers.read_json(spark, out, "name string")


def documents_folder(spark, sf_dir):
    """Nations as a folder of documents, a file each; what a document lacks is null."""
    out = _folder(spark)
    nation = _read(spark, sf_dir, "nation")
    image = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("i_1"), F.col("n_name")))
    docs = nation.select(F.col("n_name").alias("title"), F.create_map(F.lit("p_1"), F.concat(F.lit("Nation "), "n_nationkey")).alias("text"), image.alias("image"), "n_nationkey")
    docs.repartitionById(25, F.col("n_nationkey").cast("int")).drop("n_nationkey").write.json(out)
    got = readers.read_documents(spark, out, "title string, text map<string,string>, image map<string,string>")
    return got.select("title", F.element_at("text", "p_1").alias("text"), F.try_element_at("image", F.lit("i_1")).alias("image"), F.col("file").endswith(".json").alias("json"))


def document_problems(spark, sf_dir):
    """What the documents of documents_folder lack, as a numbered report's problems."""
    docs = documents_folder(spark, sf_dir).withColumnRenamed("title", "file").withColumn("title", F.lit("t"))
    return validate.document_problems(docs)


def optional_shards(spark, sf_dir):
    """Shards of which both tables are there, and the number that one table alone gives."""
    both = readers.optional_table(spark, f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet")
    alone = readers.optional_table(spark, f"{sf_dir}/region.parquet", f"{sf_dir}/no_such_table.parquet")
    rows = both[0].select("r_regionkey").join(both[1].select("n_regionkey"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.agg(F.count("*").alias("rows")).withColumn("alone", F.lit(alone is not None))


def run_settings(spark, sf_dir):
    """A run's settings written and read back, ${REPO_ROOT} replaced."""
    out = _folder(spark)
    sinks.save_config(spark, config.run_config(run_name="${REPO_ROOT}/x", beam_width=7), out)
    read = sinks.read_settings(spark, out, "/root")
    return spark.createDataFrame(sorted((k, str(v)) for k, v in read.items()), "name string, value string")


def parsed_pages_cache(spark, sf_dir):
    """Parsed pages kept as tables and loaded again; a second guarded write is refused."""
    out = _folder(spark)
    parsed = html.parse_pages(_read(spark, sf_dir, "pages"))
    sinks.guarded(parsed.where("kind = 'title'").select("page_id", "title"), f"{out}/titles")
    try:
        sinks.guarded(parsed.select("page_id"), f"{out}/titles")
        refused = False
    except FileExistsError:
        refused = True
    return sinks.load_graph(spark, out, ["titles"])["titles"].withColumn("refused", F.lit(refused))


def images_as_pages(spark, sf_dir):
    """Files by nation, pictures and others, as input of an encoder for pages: readable images only."""
    out = _folder(spark)
    heads = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"broken"]
    for k in range(12):
        sinks.write_file(spark, f"{out}/{'deep/' if k % 2 else ''}n{k}.{('png', 'JPG', 'jpeg', 'txt')[k % 4]}", heads[k % 3] + b"rest")
    made = readers.page_targets(readers.read_images(spark, out))
    return made.select("file", "target", F.size("images").alias("images"))


def _raw_questions(spark, sf_dir, evidence):
    c = _read(spark, sf_dir, "customer")
    answers = F.array(F.struct(F.col("c_nationkey").alias("answer"), F.lit("text").alias("modality")))
    return c.select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("question"), answers.alias("answers"), F.array(evidence).alias("evidences"))


def _flat(parsed):
    return parsed.select("qid", "question", F.array_join("answers", "|").alias("answers"), F.explode("evidences").alias("e")).select("qid", "question", "answers", "e.*")


def qa_pages(spark, sf_dir):
    """Questions whose evidence is an image of a page."""
    image = F.concat(F.lit("d_"), F.col("c_custkey"), F.element_at(F.array(*[F.lit(x) for x in (".jpeg", ".jpg", ".png")]), (F.col("c_custkey") % 3 + 1).cast("int")))
    return _flat(readers.parse_questions(_raw_questions(spark, sf_dir, F.struct(image.alias("gold_image"))), "vqa_evidence"))


def qa_components(spark, sf_dir):
    """Questions whose evidence is a component; what records lack is null."""
    e = F.struct(F.lit("table").alias("mmqa_doc_modality"), F.col("c_mktsegment").alias("gold_webpage_title"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("t_"), F.col("c_custkey"))).alias("gold_component_id"))
    return _flat(readers.parse_questions(_raw_questions(spark, sf_dir, e), "mmqa_component"))


def qa_files(spark, sf_dir):
    """Questions whose evidence is a page of a file, with a score."""
    e = F.struct(F.lit("text").alias("mmqa_doc_modality"), F.col("c_mktsegment").alias("gold_pdf_name"), F.concat(F.col("c_mktsegment"), F.lit("_"), F.col("c_custkey"), F.lit(".png")).alias("gold_page"), (F.col("c_custkey") % 4).alias("gold_page_score"))
    return _flat(readers.parse_questions(_raw_questions(spark, sf_dir, e), "mmqa_page"))


def latest_answers(spark, sf_dir):
    """The last event of each user as if it were the last answer to a question."""
    lines = _read(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.array("event_type", F.col("event_id").cast("string")).alias("answers"), F.col("event_id").alias("line"))
    return readers.latest_answers(lines).select("qid", F.array_join("answers", "|").alias("answers"))


def merged_answers(spark, sf_dir):
    """Answers of three writers merged in the writers' order, the last one to a question counting."""
    ev = _read(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.array(F.col("event_type")).alias("answers"), "event_id")
    shards = [ev.where(F.col("event_id") % 3 == k).select("qid", "answers", F.floor(F.col("event_id") / 3).cast("bigint").alias("line")) for k in (2, 0, 1)]
    merged = readers.merged_lines(shards)
    return readers.latest_answers(merged).select("qid", F.get("answers", 0).alias("answer"))


def index_inversion(spark, sf_dir):
    return readers.inverted(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey")


def shard_merge(spark, sf_dir):
    """Vectors and their names in three shards of equal sizes each, put together."""
    emb = _read(spark, sf_dir, "embeddings").select((F.col("vec_id") / 3).cast("bigint").alias("row"), F.col("vec_id") % 3, "vec_id", "embedding").toDF("row", "shard", "vec_id", "vec")
    parts = [(emb.where(F.col("shard") == k).select("row", "vec"), emb.where(F.col("shard") == k).select("row", F.lit(f"d{k}").alias("doc"), F.concat(F.lit("p_"), "vec_id").alias("cid"))) for k in range(3)]
    return readers.checked_shards(parts).select("doc", "cid", F.get("vec", 0).cast("double").alias("first"))


def seeded_artifact(spark, sf_dir):
    """A working copy of nations, changed in place twice; its source stays."""
    path = f"{_folder(spark)}/nation"
    for _ in range(2):
        copy = sinks.artifact(spark, f"{sf_dir}/nation.parquet", path)
        sinks.replaced(copy.withColumn("n_name", F.concat("n_name", F.lit("+"))), path)
    return sinks.artifact(spark, f"{sf_dir}/nation.parquet", path).select("n_nationkey", "n_name")


def report_format(spark, sf_dir):
    """Largest values by type of event, as a report shows them."""
    return sinks.formatted(_read(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value").alias("value"), F.count("*").alias("n")))


def saved_index(spark, sf_dir):
    """The nearest vectors in an index that was saved and loaded."""
    out = _folder(spark)
    g = vectors.load(spark, sf_dir)
    sinks.save_graph({"low": g.low, "tops": g.tops}, out)
    held = sinks.load_graph(spark, out, ["low", "tops"])
    return R.single_knn(g.questions, held["tops"], held["low"], "low", K).drop("level")


def subimage_paths(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    path = F.concat(F.lit("/data/"), F.when(F.col("p_partkey") % 2 == 0, C.SUBIMAGES).otherwise(""), F.lit("img"), F.col("p_partkey"), F.lit("/1_table.png"))
    return p.select("p_partkey", C.subimage_path(path).alias("path"))


def _told():
    """A stand-in for a vision model: the name of the image it is shown; it fails at names that end in 7.png."""

    def tell(prompt: str) -> str:
        name = prompt.split("<image> ")[1]
        if name.endswith("7.png"):
            raise ValueError("too large")
        return f"seen {name}"

    return tell


def image_summaries(spark, sf_dir):
    """Summaries of parts' images that have none yet."""
    names = _read(spark, sf_dir, "part").select(F.concat(F.lit("img"), F.col("p_partkey"), F.lit(".png")).alias("name"), "p_partkey")
    return vision.summarize(names, names.where("p_partkey % 5 = 0").select("name"), _told)


def failed_prompts(spark, sf_dir):
    """Answers of the stand-in with its errors."""
    names = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.concat(F.lit("<image> img"), F.col("p_partkey"), F.lit(".png")).alias("prompt"))
    return questions.answer_questions(names, _told).select("qid", F.get("predicted_answer", 0).alias("answer"), "error")


def encoding_subset(spark, sf_dir):
    """The plan of one set and one kind of component."""
    parameters = {("hashing", "page", "text"): (256, 32), ("hashing", "web", "text"): (1024, 16), ("hashing", "web", "table"): (512, 10)}
    return models.encoding_plan(spark, [("set1", "page"), ("set2", "web"), ("set4", "web")], ["text", "table"], parameters, "hashing", ["set2"], ["table"])


def encode_vectors(spark, sf_dir):
    """Vectors of whole texts by the hashing encoder: the number of words counted, with signs, in each dimension."""
    made = models.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), models.HashingEncoder)
    return made.select("doc_id", F.posexplode("vec").alias("dim", "x")).where("x <> 0").select("doc_id", F.col("dim").cast("bigint").alias("dim"), "x")


def _assembled(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    sub = g.subqueries.select("qid", "sq_pos", F.concat(F.col("qid").cast("string"), F.lit("___"), F.col("sq_pos")).alias("sqid"), F.concat(F.lit("s"), F.col("sq_pos")).alias("subquery"), "vec")
    aware = sub.where("sq_pos < 2 or qid % 2 = 0").select("sqid", F.transform("vec", lambda x: -x).alias("vec"))
    return questions.assemble(g.questions.select("qid", F.concat(F.lit("q"), "qid").alias("question")), g.questions, sub.drop("vec"), sub.select("sqid", "vec"), aware)


def question_assembly(spark, sf_dir):
    """Questions with their sub-queries in order; those without both vectors are left out."""
    q, s = _assembled(spark, sf_dir)
    both = questions.collected(s).join(q.select("qid", "question"), "qid")
    return both.select("qid", "question", F.array_join(F.transform("subqueries", lambda x: F.concat(x["sqid"], F.lit("="), x["subquery"])), "|").alias("subqueries"))


def vectors_of_modes(spark, sf_dir):
    """First numbers of sub-queries' vectors in either mode."""
    _, s = _assembled(spark, sf_dir)
    out = [questions.vectors_of_mode(s, m).select("qid", "sq_pos", F.lit(m).alias("mode"), F.get("vec", 0).alias("x")) for m in ("aware", "agnostic")]
    return out[0].unionByName(out[1])


def decompose_limited(spark, sf_dir):
    """The first seven questions by id, decomposed."""
    conv = _read(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("qid"), F.regexp_replace("text", r"[^A-Za-z ]", " ").alias("question"))
    return questions.decompose(conv, Q._echo, limit=7)


def run_names(spark, sf_dir):
    return spark.createDataFrame([(m, R.run_name("m", m, 50, 7, 2, "0_hop", "low")) for m in R.MODES], "mode string, name string")


def registries(spark, sf_dir):
    """Names known, and what a second registration of one says."""
    try:
        models.QA_SCHEMAS.register("mmqa_page")(print)
        again = "registered"
    except ValueError:
        again = "refused"
    known = [("schema", n) for n in models.QA_SCHEMAS.names()] + [("encoder", n) for n in models.ENCODERS.names()]
    return spark.createDataFrame([(*r, again) for r in known], "kind string, name string, again string")


def _retrieved(mode, **more):
    def query(spark, sf_dir):
        g = vectors.load(spark, sf_dir)
        return R.retrieve(g.questions, g.subqueries, g.tops, g.low, g.links, mode, k=K, beam=BEAM, **more)

    return query


def retrieve_paths(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    found = R.retrieve(g.questions, g.subqueries, g.tops, g.low, g.links, "decomposed_topdown", beam=BEAM, neighbours=vector_queries.low_neighbours(spark, sf_dir))
    return found.select("qid", F.array_join("path", ">").alias("path"), "score", "rank")


def generate_answers(spark, sf_dir):
    """Answers of a stand-in model, that repeats the question, to customers' prompts."""
    prompts = Q.prompt_build(spark, sf_dir)
    return questions.answer_questions(prompts, _repeat).select("qid", F.array_join("predicted_answer", "|").alias("answer"))


def _repeat():
    return lambda prompt: 'Therefore, the answer is: f_answers(["' + prompt.rsplit("Question = ", 1)[1].split("\n")[0] + '", "yes"])'


def _gold_questions(spark, sf_dir, doc, cid):
    """Questions and the evidences that those of a label share."""
    g = vectors.load(spark, sf_dir)
    asked = g.labels.select("qid", "gid", F.lit("?").alias("question"), F.array(F.lit("x")).alias("answers"))
    return asked, g.members.select("gid", doc.alias("doc"), cid.alias("cid"))


def evaluate_web(spark, sf_dir):
    """Recall and MRR of results against components, ranks in threes."""
    gold, evidences = _gold_questions(spark, sf_dir, F.concat(F.lit("d"), F.expr("node div 4")), F.concat(F.lit("p_"), "node"))
    return evaluate.retrieval_accuracy(gold, eval_queries._results(spark, sf_dir)[0], "web", evidences=evidences)


def evaluate_pages(spark, sf_dir):
    """Recall at 3 and MRR at 10 of results against pages."""
    gold, evidences = _gold_questions(spark, sf_dir, F.concat(F.lit("d"), F.expr("node div 4")), F.lit(None).cast("string"))
    return evaluate.retrieval_accuracy(gold, eval_queries._results(spark, sf_dir)[0], "page", evidences=evidences)


def page_answers(spark, sf_dir):
    """Match and F1 of guessed prices against prices and sizes, with parts that have no guess."""
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_size", F.floor("p_retailprice").cast("bigint").alias("price"))
    gold = part.select(F.col("p_partkey").alias("qid"), F.array(F.col("price").cast("string"), F.concat(F.lit("Size  "), F.col("p_size"))).alias("golds"))
    guess = (F.col("price") + F.col("price") * (F.col("p_partkey") % 9 - 4) * 2 / 100).cast("bigint").cast("string")
    return T.page_scores(gold, part.where("p_partkey % 7 > 0").select(F.col("p_partkey").alias("qid"), guess.alias("answer")))


def _answered(spark, sf_dir):
    """Documents' whole texts as answers: gold all words of letters, predicted without long ones, some with none."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ]", " ").alias("t"), "lang")
    gold = docs.select(F.col("doc_id").alias("qid"), F.array("t").alias("answers"), F.array().cast("array<struct<modality:string,doc:string,cid:string,score:double>>").alias("evidences"), F.lit("?").alias("question"))
    made = docs.where("doc_id % 11 > 0").select(F.col("doc_id").alias("qid"), F.array(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("The "), F.upper("t"))).otherwise(F.regexp_replace("t", "[A-Za-z]{8,}", "one"))).alias("answers"), F.lit(1).alias("line"))
    return gold, made


def evaluate_answers_web(spark, sf_dir):
    """EM and F1 over all documents as questions."""
    gold, made = _answered(spark, sf_dir)
    return evaluate.answer_accuracy(gold, made, "web").select(F.round("em", 9).alias("em"), F.round("f1", 9).alias("f1"), "questions")


def answer_em_f1(spark, sf_dir):
    """EM and F1 of each document's whole text as an answer, the best of two references."""
    gold, made = _answered(spark, sf_dir)
    return T.score_answers(gold.select("qid", F.array("answers", F.array(F.lit("the one"))).alias("references")), made)


def answer_lists(spark, sf_dir):
    """F1 of lists of two answers, matched in the better of both ways, and of one against two."""
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    gold = part.select(F.col("p_partkey").alias("qid"), F.array(F.array("p_name", F.concat("p_type", F.lit(" widget "), "p_size"))).alias("references"))
    swap = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("a "), F.lower("p_type"), F.lit(" "), "p_size"), F.lit("the small widget"))).otherwise(F.array(F.lit("small widget")))
    return T.score_answers(gold, part.select(F.col("p_partkey").alias("qid"), swap.alias("answers"), F.lit(1).alias("line")))


def question_hops(spark, sf_dir):
    """Customers by made-up question types, counted by the modalities of their hops."""
    kinds = [*T.HOPS, "Bridge(X)", "Other"]
    t = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("c_custkey") % len(kinds) + 1).cast("int"))
    rows = _read(spark, sf_dir, "customer").select(T.hop(t).alias("hop"), T.hops(t).alias("h"))
    return rows.groupBy("hop", F.col("h.first").alias("first"), F.col("h.second").alias("second")).agg(F.count("*").alias("n"))


def table_edges(spark, sf_dir):
    """Links in the cells of orders' tables to suppliers' nations, and one in a reference."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    nation = _read(spark, sf_dir, "nation")
    link = lambda text, to: F.array(F.struct(text.alias("text"), to.alias("hyperlink")))
    s = F.col("l_suppkey").cast("string")
    cell = F.struct(s.alias("text"), link(s, F.concat(F.lit("/wiki/N"), F.col("l_suppkey") % 30)).alias("links"))
    order = lambda x: F.array(x["cell"])
    rows = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("cell")))).alias("rows"))
    refs = F.create_map(F.lit("1"), F.struct(F.lit("r").alias("text"), link(F.lit("r"), F.lit("/wiki/N3")).alias("links")))
    tables = rows.select("doc", F.lit("t_1").alias("cid"), F.transform("rows", order).alias("cells"), refs.alias("refs"))
    titles = nation.select(F.concat(F.lit(C.SITE + "/wiki/N"), F.col("n_nationkey")).alias("url"), F.col("n_name").alias("title"))
    return C.table_edges(tables, titles, nation.where("n_nationkey <> 5").select(F.col("n_name").alias("title")))


def _parsed(spark, sf_dir):
    paras = Q._paragraphs(spark, sf_dir)
    named = paras.select(F.col("doc").cast("string").alias("doc"), "cid", F.lit("T").alias("title"), F.array(F.lit("S")).alias("section"), "text")
    links = Q._edges(paras).withColumn("doc", F.col("doc").cast("string")).drop("edge").withColumn("hyperlink", F.concat(F.lit("/wiki/d"), F.col("start") % 100))
    titles = spark.range(100).select(F.concat(F.lit(C.SITE + "/wiki/d"), "id").alias("url"), F.concat(F.lit("d"), "id").alias("title"))
    tables = Q._tables(spark, sf_dir).withColumn("doc", F.concat(F.lit("o"), "doc"))
    images = Q._image_rows(spark, sf_dir).withColumn("doc", F.concat(F.lit("s"), "doc")).withColumn("summary", F.lit(None).cast("string"))
    return steps.Parsed(named, links, tables, images, titles, titles.where("cast(substr(title, 2) as int) % 3 = 0").select("title"))


def corpus_build(spark, sf_dir):
    """All steps of building a corpus, then those again that are asked for; rows of each table."""
    out = _folder(spark)
    parsed = _parsed(spark, sf_dir)
    steps.build(spark, parsed, out, ["links", "segments", "sentences"])
    made = steps.build(spark, parsed, out)
    counts = None
    for name, df in made.items():
        n = df.agg(F.lit(name).alias("step"), F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    return counts


def corpus_edges(spark, sf_dir):
    """Edges of paragraphs and sentences of a built corpus, links that name files already."""
    parsed = _parsed(spark, sf_dir)
    return steps.build(spark, parsed, _folder(spark), ["links", "sentences", "edges"], needs_dereference=False)["edges"].groupBy("cid", "edge").agg(F.count("*").alias("n"))


def validation_report(spark, sf_dir):
    """The lines and the exit code of a set's report."""
    sets = {"s": {"type": "page", "qa_schema": "vqa_evidence", "document_granularity": "page", "needs_dereference": False, "filename": "f"}, "t": {"type": "web", "qa_schema": "odd"}}
    rows = []
    for name in ("s", "t", "u"):
        text, code = report([r.problem for r in validate.validate(spark, name, sets, {"page": ["s"]}, {"e": {"by_type": {"page": {"text": 1}}}}).orderBy("problem").collect()])
        rows.append((name, text.count("\n") + 1, code))
    return spark.createDataFrame(rows, "name string, lines int, code int")


@F.pandas_udf(types.BinaryType())
def _painted(width: pd.Series, height: pd.Series, blue: pd.Series) -> pd.Series:
    """Pictures whose red grows to the right and green downwards."""

    def one(w, h, b):
        y, x = np.mgrid[0:h, 0:w]
        return pixels.encoded(np.stack((x % 256, y % 256, np.full((h, w), b % 256)), axis=2).astype(np.uint8))

    return pd.Series([one(*r) for r in zip(width, height, blue, strict=True)])


@F.pandas_udf(types.ArrayType(types.LongType()))
def _sums(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else pixels.decoded(c).astype(np.int64).sum(axis=(0, 1)).tolist())


def _pictures(spark, sf_dir, blue):
    p = spread(_read(spark, sf_dir, "part"), "p_partkey")  # a picture takes longer to paint than its row to read
    content = F.when(F.col("p_partkey") % 17 == 0, F.lit(b"broken")).otherwise(_painted(F.col("p_size") + 10, F.col("p_partkey") % 20 + 30, blue))
    return p.select(F.col("p_partkey").cast("string").alias("image"), content.alias("content"))


def cut_images(spark, sf_dir):
    """Boxes cut out of parts' pictures, one of them reaching over the edge, with the sums of their colours."""
    p = _read(spark, sf_dir, "part").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    x1 = F.when(F.col("k") == 1, 2.0).otherwise(F.col("p_size") + 5.0)
    boxes = p.select(F.col("p_partkey").cast("string").alias("image"), F.concat("k", F.lit("_a.png")).alias("name"), x1.alias("x1"), F.lit(3.0).alias("y1"), (x1 + 8).alias("x2"), F.lit(13.0).alias("y2"))
    made = vision.cut_outs(_pictures(spark, sf_dir, F.col("p_partkey")), boxes)
    return made.select("image", "name", "width", "height", F.array_join(_sums("content"), ",").alias("sums"), "error")


def resize_images(spark, sf_dir):
    """Parts' pictures within a square of 16 pixels; blue is the same all over and stays so."""
    made = vision.resized_images(_pictures(spark, sf_dir, F.lit(77)), 16)
    return made.select("image", "width", "height", F.get(_sums("content"), 2).alias("blue"), "error")


QUERIES = {
    f.__name__: f
    for f in (
        json_lines, json_overwrite, documents_folder, document_problems, optional_shards, run_settings, parsed_pages_cache, images_as_pages, qa_pages, qa_components, qa_files, latest_answers, merged_answers, index_inversion, shard_merge,
        seeded_artifact, report_format, saved_index, subimage_paths, image_summaries, failed_prompts, encoding_subset, encode_vectors, question_assembly, vectors_of_modes, decompose_limited, run_names, registries, retrieve_paths, generate_answers,
        evaluate_web, evaluate_pages, page_answers, evaluate_answers_web, answer_em_f1, answer_lists, question_hops, table_edges, corpus_build, corpus_edges, validation_report, cut_images, resize_images,
    )
}
QUERIES |= {
    "retrieve_knn": _retrieved("single_knn", level="both"),
    "retrieve_topdown": _retrieved("single_topdown"),
    "retrieve_late_interaction": _retrieved("late_interaction", hop="0_hop"),
    "retrieve_iterated": _retrieved("iterative_late_interaction", iterations=2),
}

_QA = "select c_custkey::varchar as qid, c_name as question, c_nationkey::varchar as answers"
_NUMBERS = "case w " + " ".join(f"when '{w}' then '{float(n)}'" for w, n in T.WORDS.items()) + " else w end"
#: Words of letters only, as the scorer sees them: lower case, no articles, number words as numbers.
_NORMAL = f"""docs as (select doc_id as qid, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g') as t from documents),
made as (select qid, case when qid % 3 = 0 then 'The ' || upper(t) else regexp_replace(t, '[A-Za-z]{{8,}}', 'one', 'g') end as t from docs where qid % 11 > 0),
gw as (select qid, list_transform(list_filter(string_split(lower(t), ' '), lambda w: w not in ('', 'a', 'an', 'the')), lambda w: {_NUMBERS}) as w from docs),
pw as (select qid, list_transform(list_filter(string_split(lower(t), ' '), lambda w: w not in ('', 'a', 'an', 'the')), lambda w: {_NUMBERS}) as w from made),
sides as (select qid, gw.w as g, pw.w as p from gw left join pw using (qid) union all select qid, ['1.0'], pw.w from gw left join pw using (qid)),
sets as (select qid, g, p, list_distinct(g) as gs, list_distinct(p) as ps from sides),
common as (select *, len(list_intersect(gs, ps)) as n, list_has_any(list_filter(gs, lambda x: try_cast(x as double) is not null), ps) as gate, len(list_filter(gs, lambda x: try_cast(x as double) is not null)) as numbers from sets),
each as (select qid, case when p is null then 0.0 when g = p then 1.0 else 0.0 end::double as em, case when p is null or numbers > 0 and not gate then 0.0
    else round((select case when a + b = 0 then 0.0 else 2 * a * b / (a + b) end from (select case when len(ps) > 0 then n / len(ps) else 1.0 end as a, case when len(gs) > 0 then n / len(gs) else 1.0 end as b)), 2) end::double as f1, g from common)"""
_LIST = f"list_transform(list_filter(string_split(lower({{}}), ' '), lambda w: w not in ('', 'a', 'an', 'the')), lambda w: coalesce(try_cast(w as double)::varchar, {_NUMBERS}))"
_PAIR = "(select case when len(list_filter({g}, lambda x: try_cast(x as double) is not null)) > 0 and not list_has_any(list_filter({g}, lambda x: try_cast(x as double) is not null), {p}) then 0.0 when len(list_intersect({g}, {p})) = 0 then 0.0 else 2.0 * len(list_intersect({g}, {p})) / (len({g}) + len({p})) end)::double"
_HASHED = "('0x' || substr(md5(w), 1, 12))::bigint"
_PRICE = "floor(p_retailprice)::bigint"
_GUESS = f"trunc({_PRICE} + {_PRICE} * (p_partkey % 9 - 4) * 2 / 100)::bigint"


def _values(rows: list[tuple], names: str) -> str:
    said = lambda x: "null::varchar" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::int"
    return f"select * from (values {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) v({names})"


ORACLES = {
    "json_lines": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "json_overwrite": "select r_name as name from region",
    "documents_folder": "select n_name as title, 'Nation ' || n_nationkey as text, case when n_nationkey % 2 = 0 then n_name end as image, true as json from nation",
    "document_problems": "select n_name as file, 'missing image' as problem from nation where n_nationkey % 2 = 1",
    "optional_shards": "select count(*) as rows, false as alone from region join nation on n_regionkey = r_regionkey",
    "run_settings": _values(sorted((k, str(v)) for k, v in (config.RETRIEVAL | {"run_name": "/root/x", "beam_width": 7}).items()), "name, value"),
    "parsed_pages_cache": f"select *, true as refused from ({Q.ORACLES['html_titles']})",
    "images_as_pages": _values([(f"n{k}.{('png', 'JPG', 'jpeg', 'txt')[k % 4]}", "", 1) for k in range(12) if k % 3 < 2 and k % 4 < 3], "file, target, images"),
    "qa_pages": f"{_QA}, null::varchar as modality, 'd_' || c_custkey as doc, null::varchar as cid, null::double as score from customer",
    "qa_components": f"{_QA}, 'table' as modality, c_mktsegment as doc, case when c_custkey % 2 = 0 then 't_' || c_custkey end as cid, null::double as score from customer",
    "qa_files": f"{_QA}, 'text' as modality, c_mktsegment as doc, c_mktsegment || '_' || c_custkey as cid, (c_custkey % 4)::double as score from customer",
    "latest_answers": "select user_id as qid, arg_max(event_type || '|' || event_id, event_id) as answers from events group by user_id",
    "merged_answers": "select user_id as qid, arg_max(event_type, ((event_id + 1) % 3) * 1000000000 + event_id // 3) as answer from events group by user_id",
    "index_inversion": "select c_nationkey, min(c_custkey) as c_custkey from customer group by c_nationkey",
    "shard_merge": "select 'd' || vec_id % 3 as doc, 'p_' || vec_id as cid, embedding[1]::double as first from embeddings",
    "seeded_artifact": "select n_nationkey, n_name || '++' as n_name from nation",
    "report_format": "select event_type, printf('%.4f', max(value)) as value, count(*) as n from events group by event_type",
    "saved_index": vector_queries.ORACLES["knn_topk"],
    "subimage_paths": f"select p_partkey, case when p_partkey % 2 = 0 then 'img' || p_partkey || '/1_table.png' else '/data/img' || p_partkey || '/1_table.png' end as path from part",
    "image_summaries": "select 'img' || p_partkey || '.png' as name, case when p_partkey % 10 = 7 then '' else 'seen img' || p_partkey || '.png' end as summary from part where p_partkey % 5 > 0",
    "failed_prompts": "select p_partkey as qid, case when p_partkey % 10 = 7 then '' else 'seen img' || p_partkey || '.png' end as answer, case when p_partkey % 10 = 7 then 'ValueError: too large' end as error from part",
    "encoding_subset": "select 'set2' as dataset, 'table' as component, 512::int as max_length, 10::int as batch_size",
    "encode_vectors": f"""with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as w from documents),
d as (select doc_id, {_HASHED} // 2 % 64 as dim, sum(case when {_HASHED} % 2 = 1 then 1 else -1 end)::double as n from w group by all)
select doc_id, dim, n / sqrt(sum(n * n) over (partition by doc_id)) as x from d where n <> 0""",
    "question_assembly": f"{_G} select qid, 'q' || qid as question, string_agg(qid || '___' || sq_pos || '=s' || sq_pos, '|' order by sq_pos) as subqueries from sq where sq_pos < 2 or qid % 2 = 0 group by qid",
    "vectors_of_modes": f"{_G}, s as (select * from sq where sq_pos < 2 or qid % 2 = 0) select qid, sq_pos, 'agnostic' as mode, vec[1] as x from s union all select qid, sq_pos, 'aware', -vec[1] from s",
    "decompose_limited": """with q as (select conv_id as qid, regexp_replace(text, '[^A-Za-z ]', ' ', 'g') as question from conversations where turn = 0 order by conv_id limit 7),
w as (select *, regexp_extract_all(question, '[A-Za-z]{6,}') as w from q), r as (select qid, case when len(w) > 0 then w else [question] end as w from w)
select qid, (k - 1)::int as sq_pos, qid || '___' || (k - 1) as sqid, w[k] as subquery from (select *, unnest(range(1, len(w) + 1)) as k from r)""",
    "run_names": _values([("single_knn", "m_single_knn_k50_low"), ("single_topdown", "m_single_topdown_k50_bw7"), ("late_interaction", "m_late_interaction_k50_bw7_0_hop"), ("iterative_late_interaction", "m_iterative_late_interaction_k50_bw7_ni2"), ("decomposed_topdown", "m_decomposed_topdown_defaultparams")], "mode, name"),
    "registries": _values([("encoder", "hashing", "refused"), ("schema", "mmqa_component", "refused"), ("schema", "mmqa_page", "refused"), ("schema", "vqa_evidence", "refused")], "kind, name, again"),
    "retrieve_knn": vector_queries.ORACLES["knn_both"],
    "retrieve_topdown": vector_queries.ORACLES["topdown_rerank"],
    "retrieve_late_interaction": vector_queries.ORACLES["late_interaction_0hop"],
    "retrieve_iterated": vector_queries.ORACLES["iterative_late_interaction"],
    "retrieve_paths": vector_queries.ORACLES["beam_paths"],
    "generate_answers": "select distinct o_custkey as qid, 'What did customer ' || o_custkey || ' order?|yes' as answer from orders",
    "evaluate_web": f"{eval_queries._NEAR}, g as (select qid, 'd' || (node // 4) as doc, 'p_' || node as cid from gold), h as (select g.qid, count(c.cid) / count(*) as r, coalesce(1 / ceil(min(c.rank) / 3), 0.0) as rr from g left join comp c on c.qid = g.qid and c.doc = g.doc and c.cid = g.cid and c.rank <= 9 group by g.qid) select avg(r) as recall, avg(rr) as mrr, count(*) as questions from h",
    "evaluate_pages": f"select x.recall, y.mrr from ({eval_queries.ORACLES['recall_at_3']}) x, ({eval_queries.ORACLES['mrr_at_10']}) y",
    "page_answers": f"""select p_partkey as qid, case when p_partkey % 7 > 0 and abs({_GUESS} - {_PRICE}) <= 0.05 * {_PRICE} then 1.0 else 0.0 end::double as em,
    case when p_partkey % 7 = 0 then 0.0 when {_GUESS} = {_PRICE} then 1.0 when {_GUESS} = p_size then 0.67 else 0.0 end::double as f1 from part""",
    "evaluate_answers_web": f"with {_NORMAL}, own as (select * from each where g <> ['1.0'] or qid in (select qid from gw where w = ['1.0'])), m as (select qid, min(em) as em, min(f1) as f1 from (select qid, em, f1, g from each join gw using (qid) where g = gw.w) group by qid) select round(avg(em), 9) as em, round(avg(f1), 9) as f1, count(*) as questions from m",
    "answer_em_f1": f"with {_NORMAL} select qid, max(em) as em, max(f1) as f1 from each group by qid",
    "answer_lists": f"""with l as (select p_partkey as qid, list_distinct({_LIST.format('p_name')}) as g1, list_distinct({_LIST.format("p_type || ' widget ' || p_size")}) as g2, list_distinct({_LIST.format("p_type || ' ' || p_size")}) as p1, ['small', 'widget'] as p2 from part)
select qid, 0.0::double as em, case when qid % 2 = 0 then round(greatest({_PAIR.format(g='g1', p='p1')} + {_PAIR.format(g='g2', p='p2')}, {_PAIR.format(g='g1', p='p2')} + {_PAIR.format(g='g2', p='p1')}) / 2, 2)
    else round(greatest({_PAIR.format(g='g1', p='p2')}, {_PAIR.format(g='g2', p='p2')}) / 2, 2) end as f1 from l""",
    "question_hops": f"with t as ({_values([(k, 'single' if v[1] is None else 'multi', *v) for k, v in enumerate(T.HOPS.values())] + [(16, 'multi', None, None), (17, 'single', None, None)], 'k, hop, first, second')}) select hop, first, second, count(*) as n from customer join t on c_custkey % 18 = k group by all",
    "table_edges": """with l as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey::varchar) as k, l_suppkey from lineitem)
select doc, 't_1' as cid, k || ',1' as place, l_suppkey::varchar as text, '/wiki/N' || l_suppkey % 30 as hyperlink, n_name || '.json' as edge from l join nation on n_nationkey = l_suppkey % 30 where n_nationkey <> 5
union all select distinct doc, 't_1', 'ref 1', 'r', '/wiki/N3', n_name || '.json' from l, nation where n_nationkey = 3""",
    "corpus_build": f"""{Q._P}, e as (select * from edge where start % 100 % 3 = 0), placed as (select s.*, instr(p.text, s.text) - 1 as o from sent s join para p on p.doc = s.doc and p.cid = s.para),
low as (select e.doc, s.cid, e.edge from e join placed s on s.doc = e.doc and s.para = e.para and o <= start and "end" <= o + length(s.text) qualify row_number() over (partition by e.doc, e.para, start order by o, pos) = 1),
n as (select (select count(*) from e) as links, (select count(*) from lineitem) as segments, (select count(*) from sent) as sentences, (select count(*) from (select doc, para, edge from e union select * from low)) as edges,
    (select count(*) from para) + (select count(*) from sent) + (select count(distinct l_orderkey) from lineitem) + (select count(*) from lineitem) + (select count(*) from supplier) as lines)
select unnest(['links', 'segments', 'sentences', 'edges', 'lines', 'vectors']) as step, unnest([links, segments, sentences, edges, lines, lines]) as n from n""",
    "corpus_edges": f"""{Q._P}, placed as (select s.*, instr(p.text, s.text) - 1 as o from sent s join para p on p.doc = s.doc and p.cid = s.para),
low as (select e.doc, s.cid, e.hyperlink from edge e join placed s on s.doc = e.doc and s.para = e.para and o <= start and "end" <= o + length(s.text) qualify row_number() over (partition by e.doc, e.para, start order by o, pos) = 1)
select cid, edge, count(*) as n from (select doc, para as cid, hyperlink as edge from edge union select * from low) group by all""",
    "validation_report": _values([("s", 1, 0), ("t", 6, 1), ("u", 1, 1)], "name, lines, code"),
    "cut_images": """with b as (select p_partkey, p_size + 10 as w, k, case when k = 1 then 2 else p_size + 5 end as x, p_partkey % 17 = 0 as bad from part, (values (1), (2)) v(k)),
s as (select *, least(x + 8, w) - x as n from b)
select p_partkey::varchar as image, k || '_a.png' as name, case when not bad then 8::int end as width, case when not bad then 10::int end as height,
    case when not bad then 10 * (n * x + n * (n - 1) // 2) || ',' || n * 75 || ',' || n * 10 * (p_partkey % 256) end as sums, case when bad then 'no PNG file' end as error from s""",
    "resize_images": """with b as (select p_partkey, (p_size + 10)::double as w, (p_partkey % 20 + 30)::double as h, p_partkey % 17 = 0 as bad from part),
r as (select *, least(16.0::double / w, 16.0::double / h) as r from b), f as (select *, greatest(trunc(w * r), 1)::int as fw, greatest(trunc(h * r), 1)::int as fh from r)
select p_partkey::varchar as image, case when not bad then fw end as width, case when not bad then fh end as height, case when not bad then 77 * fw::bigint * fh end as blue, case when bad then 'no PNG file' end as error from f""",
}
