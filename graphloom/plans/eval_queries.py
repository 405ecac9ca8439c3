"""Evaluation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import llm_text
from ..operators import rank_eval as E
from ..operators import retrieve as R
from ..operators import text_eval as T
from ..sources import vectors
from .vector_queries import _G, BEAM, K

MORE = 30


def _results(spark, sf_dir):
    """Nearest lower components, two to a unit, as results with file names and component ids."""
    g = vectors.load(spark, sf_dir)
    near = R.single_knn(g.questions, g.tops, g.low, "low", MORE).select("qid", "rank", "node")
    cid = F.concat(F.lit("p_"), F.expr("node div 5"), F.lit("_s"), F.col("node") % 5 + 1)
    rows = near.select("qid", F.expr("(rank - 1) div 2").alias("u"), "rank", F.struct(F.concat(F.lit("d"), F.expr("node div 20"), F.lit(".json")).alias("doc"), cid.alias("cid")).alias("node"))
    units = rows.groupBy("qid", "u").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("nodes"))
    return units.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("u", F.struct("nodes").alias("unit")))), lambda x: x["unit"]).alias("units")), g


def parse_results_top50(spark, sf_dir):
    return E.parse_components(_results(spark, sf_dir)[0])


def parse_results_pages(spark, sf_dir):
    return E.parse_pages(_results(spark, sf_dir)[0])


def parse_results_baseline(spark, sf_dir):
    results, _ = _results(spark, sf_dir)
    named = results.withColumn("qid", F.col("qid").cast("string"))
    questions = vectors.load(spark, sf_dir).questions.select((F.col("qid") + 25).cast("string").alias("position"), F.concat(F.lit("q"), F.col("qid")).alias("qid"))
    return E.parse_baseline(named, (".json",), questions)


def _gold(g, key):
    """Questions of a label share its golds."""
    return E.SharedGold(g.labels, g.members.select("gid", key.alias("gold")))


def mrr_at_10(spark, sf_dir):
    results, g = _results(spark, sf_dir)
    return E.mrr(_gold(g, F.concat(F.lit("d"), F.expr("node div 4"))), E.parse_pages(results))


def recall_at_3(spark, sf_dir):
    results, g = _results(spark, sf_dir)
    return E.recall(_gold(g, F.concat(F.lit("d"), F.expr("node div 4"))), E.parse_pages(results))


def component_recall_mrr(spark, sf_dir):
    results, g = _results(spark, sf_dir)
    return E.component_metrics(_gold(g, F.concat(F.lit("p_"), F.col("node"))), E.parse_components(results), 9, F.col("cid"))


def page_recall_tolerance(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    near = R.single_knn(g.questions, g.tops, g.low, "top", K)
    run = near.select("qid", "rank", F.concat(F.lit("doc_"), F.expr("node div 4"), F.lit("_"), F.col("node")).alias("page"))
    name = F.when(F.col("node") % 3 == 0, "none").otherwise(F.concat(F.lit("doc_"), F.expr("node div 4"), F.lit("_"), F.col("node")))
    return E.page_number_metrics(_gold(g, name), run, K)


def run_sweep(spark, sf_dir):
    """Mean value of events by run, as if each user's events were a run's times."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    runs = ev.select(F.concat(F.lit("run_ni"), F.col("user_id") % 3, F.lit("_bw"), F.col("user_id") % 5 + 1).alias("name"), F.col("event_type").alias("dataset"), (F.col("user_id") % 7).cast("double").alias("score"), F.floor("value").cast("double").alias("ms"))
    return E.sweep(runs, {"click": 100.0, "view": 50.0})


def _said(spark, sf_dir):
    """Model answers made of documents' whole texts: fenced, marked, bare and broken ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "lang", "source")
    return docs.withColumn("t", F.regexp_replace("t", r"[^A-Za-z0-9 ]", ""))


_T = "select doc_id, lang, source, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g') as t from documents"


def modality_parse(spark, sf_dir):
    fence = F.lit(llm_text.FENCE)
    kinds = F.element_at(F.array(F.lit("Table"), F.lit("image data"), F.lit("text"), F.col("t")), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, F.concat(fence, F.lit("json\n "), kinds, F.lit("\n"), fence)).otherwise(F.concat(F.lit("  "), kinds, F.lit("\n")))
    return _said(spark, sf_dir).select("doc_id", llm_text.modality(raw).alias("modality"))


def subquery_parse(spark, sf_dir):
    fence = F.lit(llm_text.FENCE)
    array = F.concat(F.lit('["'), F.col("t"), F.lit('", "'), F.col("lang"), F.lit('"]'))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Sure: "), fence, F.lit("json\n"), array, F.lit("\n"), fence)).when(F.col("doc_id") % 3 == 1, array).otherwise(F.concat(F.lit("["), F.col("t")))
    rows = _said(spark, sf_dir).select("doc_id", F.posexplode(llm_text.subqueries(raw)).alias("sq_pos", "subquery"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("___"), F.col("sq_pos")).alias("sqid"), "subquery")


def answer_postprocess(spark, sf_dir):
    inside = F.concat(F.lit('f_answers(["'), F.col("t"), F.lit('", "'), F.col("lang"), F.lit('"])'))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("So. Therefore, the answer is: "), inside)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("The answer is: "), F.col("lang"), F.lit(" answer is: x"))).otherwise(F.col("t"))
    return _said(spark, sf_dir).select("doc_id", F.array_join(llm_text.answer_values(raw), "|").alias("answers"))


def answer_numeric_tolerance(spark, sf_dir):
    """Prices against prices of the next part within a margin."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", F.floor("p_retailprice").cast("bigint").alias("price"))
    guess = F.concat((F.col("price") + F.col("price") * (F.col("p_partkey") % 9 - 4) * 2 / 100).cast("bigint").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "%").otherwise(" "))
    golds = F.array(F.concat(F.lit(" "), F.col("price").cast("string")), F.concat(F.lit("Size  "), F.col("p_size").cast("string")))
    return part.select("p_partkey", T.answers_match(guess, golds).alias("matched"))


def metrics_grouping_sets(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = labels.select((F.col("quality") * 1.0).cast("double").alias("em"), (F.col("toxic") * 1.0).cast("double").alias("f1"), "quality", "toxic", F.when(F.col("doc_id") % 2 == 0, "single").otherwise("multi").alias("hop"))
    return T.breakdown(rows, ["quality", "toxic", "hop"])


def predicted_numbers(spark, sf_dir):
    """How many numbers the documents' texts hold, and the sum of those of up to four digits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = llm_text.numbers(F.regexp_replace("text", r"[^0-9, \n]", ""))
    return docs.select("doc_id", F.size(found).cast("bigint").alias("n"))


_NEAR = f"""{_G}, near as (select qid, node, row_number() over (partition by qid order by list_inner_product(q.vec, emb.vec) desc, node) as r from q, emb qualify r <= {MORE}),
comp as (select qid, 'd' || (node // 20) as doc, 'p_' || (node // 5) as cid, row_number() over (partition by qid order by min(r))::int as rank from near group by qid, node // 20, node // 5),
page as (select qid, doc, row_number() over (partition by qid order by min(rank))::int as rank from comp group by qid, doc),
gold as (select distinct q.qid, e.top as node from (select node as qid, label from emb where node % 25 = 0) q join emb e on e.label = q.label)"""
QUERIES = {f.__name__: f for f in (parse_results_top50, parse_results_pages, parse_results_baseline, mrr_at_10, recall_at_3, component_recall_mrr, page_recall_tolerance, run_sweep, modality_parse, subquery_parse, answer_postprocess, answer_numeric_tolerance, metrics_grouping_sets, predicted_numbers)}
_PRICE = "floor(p_retailprice)::bigint"
_GUESS = f"trunc({_PRICE} + {_PRICE} * (p_partkey % 9 - 4) * 2 / 100)::bigint"
ORACLES = {
    "parse_results_top50": f"{_NEAR} select * from comp",
    "parse_results_pages": f"{_NEAR} select * from page",
    "parse_results_baseline": f"""{_NEAR} select coalesce('q' || m.qid, n.qid::varchar) as qid, 'd' || (node // 20) as doc, 'd' || (node // 20) as page, ((r - 1) // 2 + 1)::int as rank
from near n left join q m on m.qid + 25 = n.qid where r % 2 = 1""",
    "mrr_at_10": f"{_NEAR}, h as (select p.qid, min(case when rank <= 10 and g.doc is not null then rank end) as r from page p left join (select distinct qid, 'd' || (node // 4) as doc from gold) g on g.qid = p.qid and g.doc = p.doc group by p.qid) select avg(coalesce(1 / r, 0.0::double)) as mrr, count(*) as questions from h",
    "recall_at_3": f"{_NEAR}, g as (select distinct qid, 'd' || (node // 4) as doc from gold), h as (select g.qid, count(p.doc) / count(*) as r from g left join page p on p.qid = g.qid and p.doc = g.doc and p.rank <= 3 group by g.qid) select avg(r) as recall, count(*) as questions from h",
    "component_recall_mrr": f"{_NEAR}, g as (select qid, 'p_' || node as cid from gold), h as (select g.qid, count(c.cid) / count(*) as r, coalesce(1 / ceil(min(c.rank) / 3), 0.0) as rr from g left join comp c on c.qid = g.qid and c.cid = g.cid and c.rank <= 9 group by g.qid) select avg(r) as recall, avg(rr) as mrr, count(*) as questions from h",
    "page_recall_tolerance": f"{_G}, gold as (select distinct q.qid, e.top as node from (select node as qid, label from emb where node % 25 = 0) q join emb e on e.label = q.label), near as (select qid, node, row_number() over (partition by qid order by list_inner_product(q.vec, tops.vec) desc, node) as r from q, tops qualify r <= {K}), h as (select g.qid, coalesce(count(n.node) / nullif(count(case when g.node % 3 <> 0 then 1 end), 0), 0.0) as rec, coalesce(1 / min(n.r), 0.0) as rr from gold g left join near n on n.qid = g.qid and n.node = g.node and g.node % 3 <> 0 group by g.qid) select avg(rec) as recall, avg(rr) as mrr, count(*) as questions from h",
    "run_sweep": "select event_type as dataset, (user_id % 3)::int as iterations, (user_id % 5 + 1)::int as beam, avg((user_id % 7)::double) as score, avg(floor(value)::double) + case event_type when 'click' then 100.0 when 'view' then 50.0 else 0.0 end::double as ms from events group by event_type, user_id % 3, user_id % 5 + 1",
    "modality_parse": f"select doc_id, case when doc_id % 7 = 0 then 'text' when doc_id % 4 = 0 then 'table' when doc_id % 4 = 1 then 'image' when doc_id % 4 = 2 then 'text' when lower(trim(t)) like 'table%' then 'table' when lower(trim(t)) like 'image%' then 'image' else 'text' end as modality from ({_T})",
    "subquery_parse": f"with d as ({_T}) select doc_id || '___0' as sqid, case when doc_id % 3 = 2 then '[' || t else t end as subquery from d union all select doc_id || '___1', lang from d where doc_id % 3 <> 2",
    "answer_postprocess": f"select doc_id, case doc_id % 3 when 0 then t || '|' || lang when 1 then lang else t end as answers from ({_T})",
    "answer_numeric_tolerance": f"select p_partkey, (abs({_GUESS} - {_PRICE}) <= 0.05 * {_PRICE}) as matched from part",
    "metrics_grouping_sets": """with r as (select doc_id, quality, toxic, case when doc_id % 2 = 0 then 'single' else 'multi' end as hop from labels)
select case when grouping(quality) = 0 then 'quality' when grouping(toxic) = 0 then 'toxic' when grouping(hop) = 0 then 'hop' else 'all' end as category,
    coalesce(quality::varchar, toxic::varchar, hop, 'all') as value, avg(quality::double) * 100 as em, avg(toxic::double) * 100 as f1, count(*) as n
from r group by grouping sets ((), (quality), (toxic), (hop))""",
    "predicted_numbers": r"""with d as (select doc_id, unnest(regexp_split_to_array(trim(regexp_replace(text, '[^0-9, \n]', '', 'g'), ' '), '[ \n]+')) as w from documents)
select doc_id, count(case when try_cast(replace(w, ',', '') as double) <> 0 and regexp_matches(w, '^[0-9][0-9,]*$') then 1 end) as n from d group by doc_id""",
}
