"""Evaluation of ranked results.

Results are (qid, units): units an array, best first, of structs with nodes,
an array of (doc, cid).  Parsed runs are (qid, doc, cid, rank) or (qid, doc,
rank).  Gold is (qid, golds) with an array of what is relevant, or SharedGold, where many
questions have the same golds and arrays for each would grow with questions times golds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ids

MOST = 50


@dataclass
class SharedGold:
    """Golds by group: asked (qid, gid) says which group a question, a row for each, has; golds (gid, gold) has a row for each gold, repeats too."""

    asked: DataFrame
    golds: DataFrame

    def counted(self) -> DataFrame:
        """(_gid, _gold, times): each gold of a group once."""
        return self.golds.where("gold is not null").groupBy(F.col("gid").alias("_gid"), F.col("gold").alias("_gold")).agg(F.count("*").alias("times"))

    def sized(self) -> DataFrame:
        """(q, gid, n_gold, n_all): questions with the number of their golds, each once and with repeats."""
        sizes = self.golds.groupBy(F.col("gid").alias("_gid")).agg((F.count_distinct("gold") + F.max(F.col("gold").isNull().cast("int"))).alias("n_gold"), F.count("*").alias("n_all"))
        both = self.asked.join(sizes, F.col("gid") == F.col("_gid"), "left")
        return both.select(F.col("qid").alias("q"), "gid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_gold", "n_all")])

    def met(self, got: DataFrame, how: str) -> DataFrame:
        """Questions with got (qid, key, ...): q, n_gold, n_all, and times, null where key is no gold of the question's."""
        rows = self.sized().join(got, F.col("q") == F.col("qid"), how)
        return rows.join(self.counted(), (F.col("gid") == F.col("_gid")) & (F.col("key") == F.col("_gold")), "left")


def _nodes(results: DataFrame) -> DataFrame:
    flat = results.select("qid", F.posexplode("units").alias("u", "unit"))
    return flat.select("qid", "u", F.posexplode("unit.nodes").alias("n", "node")).select("qid", F.struct("u", "n").alias("at"), "node.doc", "node.cid")


def _first(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Distinct keys in the order of their first place, with rank."""
    once = df.groupBy("qid", *keys).agg(F.min("at").alias("at"))
    out = once.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("at")))
    if limit is not None:
        out = out.where(F.col("rank") <= limit)
    return out


def parse_components(results: DataFrame, most: int = MOST) -> DataFrame:
    """Distinct upper components in order, most of them at most: (qid, doc, cid, rank)."""
    rows = _nodes(results).withColumn("doc", F.replace("doc", F.lit(".json"), F.lit(""))).withColumn("cid", ids.highest(F.col("cid")))
    return _first(rows, ["doc", "cid"], most).select("qid", "doc", "cid", "rank")


def parse_pages(results: DataFrame, most: int = MOST) -> DataFrame:
    """The documents of the first components, distinct, in order: (qid, doc, rank)."""
    doc = F.replace(F.replace("doc", F.lit(".json"), F.lit("")), F.lit("/text"), F.lit(""))
    rows = _nodes(results).withColumn("doc", doc).withColumn("cid", ids.highest(F.col("cid")))
    kept = _first(rows, ["doc", "cid"], most).select("qid", "doc", F.col("rank").alias("at"))
    return _first(kept, ["doc"]).select("qid", "doc", "rank")


def _asked(results: DataFrame, questions: DataFrame | None) -> DataFrame:
    """Results with a number as qid get the question's at that position of questions (position, qid)."""
    if questions is None:
        return results
    q = questions.select(F.col("position").cast("int").alias("p"), F.col("qid").alias("named"))
    return results.join(q, F.col("qid").try_cast("int") == F.col("p"), "left").withColumn("qid", F.coalesce("named", "qid")).drop("p", "named")


def parse_baseline(results: DataFrame, suffixes: tuple[str, ...], questions: DataFrame | None = None) -> DataFrame:
    """(qid, doc, page, rank) of the first node of each unit; suffixes are taken out of its file name."""
    page = F.element_at("unit.nodes", 1)["doc"]
    for s in suffixes:
        page = F.replace(page, F.lit(s), F.lit(""))
    flat = _asked(results, questions).select("qid", F.posexplode("units").alias("u", "unit")).select("qid", "u", page.alias("page"))
    return flat.select("qid", F.regexp_replace("page", "_[^_]*$", "").alias("doc"), "page", (F.col("u") + 1).alias("rank"))


def mrr(gold: DataFrame | SharedGold, run: DataFrame, cutoff: int = 10, key: str = "doc") -> DataFrame:
    """(mrr, questions): over gold questions that the run has; the first hit counts up to cutoff."""
    hits = _hits(gold, run, key).groupBy("qid").agg(F.min(F.when(F.col("hit") & (F.col("rank") <= cutoff), F.col("rank"))).alias("r"))
    return hits.agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), F.count("*").alias("questions"))


def recall(gold: DataFrame | SharedGold, run: DataFrame, cutoff: int = 3, key: str = "doc") -> DataFrame:
    """(recall, questions): over gold questions with something relevant that the run has."""
    hits = _hits(gold if isinstance(gold, SharedGold) else gold.where(F.size("golds") > 0), run, key).where("n_gold > 0")
    each = hits.groupBy("qid").agg(F.count_if(F.col("hit") & (F.col("rank") <= cutoff)).alias("n"), F.first("n_gold").alias("of"))
    return each.agg(F.avg(F.col("n") / F.col("of")).alias("recall"), F.count("*").alias("questions"))


def _hits(gold: DataFrame | SharedGold, run: DataFrame, key: str) -> DataFrame:
    if isinstance(gold, SharedGold):
        return gold.met(run.select("qid", "rank", F.col(key).alias("key")), "inner").select("qid", "rank", F.col("times").isNotNull().alias("hit"), "n_gold")
    g = gold.select(F.col("qid").alias("g"), "golds", F.size(F.array_distinct("golds")).alias("n_gold"))
    return run.join(g, F.col("qid") == F.col("g")).select("qid", "rank", F.array_contains("golds", F.col(key)).alias("hit"), "n_gold")


def page_metrics(gold: DataFrame | SharedGold, run: DataFrame) -> DataFrame:
    """Recall at 3 and MRR at 10 for page sets, whatever k is configured."""
    return recall(gold, run, 3).select("recall").crossJoin(mrr(gold, run, 10).select("mrr"))  # a row each


def component_metrics(gold: DataFrame | SharedGold, run: DataFrame, k: int, key: Column) -> DataFrame:
    """(recall, mrr, questions) for web sets: over all gold questions, those without a run count as 0.

    Recall divides by the number of golds, repeats included; ranks count in
    groups of three.
    """
    each = component_scores(gold, run, k, key)
    return each.agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.count("*").alias("questions"))


def component_scores(gold: DataFrame | SharedGold, run: DataFrame, k: int, key: Column) -> DataFrame:
    """(qid, recall, rr) of each gold question."""
    if isinstance(gold, SharedGold):
        rows = gold.met(run.where(F.col("rank") <= k).select("qid", "rank", key.alias("key")), "left")
        hit = F.col("times").isNotNull()
        each = rows.groupBy("q", "n_all").agg(F.count_distinct(F.when(hit, F.col("key"))).alias("n"), F.min(F.when(hit, F.col("rank"))).alias("first"))
        recall_ = F.when(F.col("n_all") > 0, F.col("n") / F.col("n_all")).otherwise(0.0)
        return each.select(F.col("q").alias("qid"), recall_.alias("recall"), F.coalesce(1 / F.ceil(F.col("first") / 3), F.lit(0.0)).alias("rr"))
    got = run.where(F.col("rank") <= k).select(F.col("qid").alias("r"), "rank", key.alias("key"))
    rows = gold.select("qid", "golds").join(got, F.col("qid") == F.col("r"), "left")
    hit = F.array_contains("golds", F.col("key"))
    each = rows.groupBy("qid", "golds").agg(F.count_distinct(F.when(hit, F.col("key"))).alias("n"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    return each.select("qid", F.when(F.size("golds") > 0, F.col("n") / F.size("golds")).otherwise(0.0).alias("recall"), F.coalesce(1 / F.ceil(F.col("first") / 3), F.lit(0.0)).alias("rr"))


def page_number_metrics(gold: DataFrame | SharedGold, run: DataFrame, k: int) -> DataFrame:
    """(recall, mrr, questions) of pages named <document>_<number>; golds without a number don't count."""
    if isinstance(gold, SharedGold):
        numbered = SharedGold(gold.asked, gold.golds.where(F.col("gold").rlike(r"_[0-9]+$")))
        got = run.where(F.col("rank") <= k).groupBy("qid", F.col("page").alias("key")).agg(F.min("rank").alias("rank"))
        each = numbered.met(got, "left").groupBy("q", "n_all").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), F.min(F.when(F.col("times").isNotNull(), F.col("rank"))).alias("first"))
        each = each.select(F.when(F.col("n_all") > 0, F.col("n") / F.col("n_all")).otherwise(0.0).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))
        return each.agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.count("*").alias("questions"))
    numbered = gold.select("qid", F.filter("golds", lambda x: x.rlike(r"_[0-9]+$")).alias("golds"))
    got = run.where(F.col("rank") <= k).select(F.col("qid").alias("r"), "rank", "page")
    rows = numbered.join(got, F.col("qid") == F.col("r"), "left")
    hit = F.array_contains("golds", F.col("page"))
    pages = F.array_distinct(F.collect_list(F.when(hit, F.col("page"))))
    each = rows.groupBy("qid", "golds").agg(pages.alias("found"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    n = F.size(F.filter("golds", lambda x: F.array_contains("found", x)))
    each = each.select("qid", F.when(F.size("golds") > 0, n / F.size("golds")).otherwise(0.0).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))
    return each.agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.count("*").alias("questions"))


def sweep(runs: DataFrame, constants: dict[str, float]) -> DataFrame:
    """(dataset, iterations, beam, score, ms) of runs (name, dataset, score, ms): parameters from names like x_ni2_bw5, mean times plus a set's constant."""
    extra = F.lit(0.0)
    for name, ms in constants.items():
        extra = F.when(F.col("dataset") == name, F.lit(float(ms))).otherwise(extra)
    rows = runs.select("dataset", F.regexp_extract("name", r"ni(\d+)_bw(\d+)", 1).try_cast("int").alias("iterations"), F.regexp_extract("name", r"ni(\d+)_bw(\d+)", 2).try_cast("int").alias("beam"), "score", "ms")
    each = rows.where("beam is not null").groupBy("dataset", "iterations", "beam").agg(F.avg("score").alias("score"), F.avg("ms").alias("ms"))
    return each.withColumn("ms", F.col("ms") + extra)
