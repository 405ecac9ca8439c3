"""Whole evaluations: results and gold in, figures out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rank_eval, text_eval

KINDS = ("web", "page")


def _golds(questions: DataFrame, value, evidences: DataFrame | None = None):
    if evidences is not None:
        return rank_eval.SharedGold(questions.select("qid", "gid"), evidences.select("gid", value(F.struct("doc", "cid")).alias("gold")))
    return questions.select("qid", F.transform("evidences", value).alias("golds"))


def retrieval_accuracy(questions: DataFrame, results: DataFrame, kind: str, baseline: bool = False, k: int = 9, positions: DataFrame | None = None, evidences: DataFrame | None = None) -> DataFrame:
    """A row of recall and mrr of results (qid, units) against questions (qid, question, answers, evidences).

    Web sets count components, k of them, and ranks in threes; page sets count
    pages, recall among 3 and first hits among 10.  A baseline's results are
    pages named by files; positions name its questions if it numbers them.  Where questions share evidences, these are a
    table (gid, doc, cid) and questions have gid instead of them, so that nothing grows with questions times evidences.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is {kind!r}; known are {', '.join(KINDS)}")
    if baseline:
        run = rank_eval.parse_baseline(results, (".png",) if kind == "web" else (".jpeg", ".jpg"), positions)
        if kind == "web":
            return rank_eval.page_number_metrics(_golds(questions, lambda e: e["cid"], evidences), run, k)
        return rank_eval.page_metrics(_golds(questions, lambda e: e["doc"], evidences), run.select("qid", F.col("page").alias("doc"), "rank"))
    if kind == "web":
        key = F.concat_ws("/", "doc", "cid")
        return rank_eval.component_metrics(_golds(questions, lambda e: F.concat_ws("/", e["doc"], e["cid"]), evidences), rank_eval.parse_components(results), k, key)
    return rank_eval.page_metrics(_golds(questions, lambda e: e["doc"], evidences), rank_eval.parse_pages(results))


def answer_accuracy(questions: DataFrame, predictions: DataFrame, kind: str) -> DataFrame:
    """A row (em, f1, questions), over all questions; predictions are (qid, answers, line), a page set's first answer counts."""
    if kind not in KINDS:
        raise ValueError(f"kind is {kind!r}; known are {', '.join(KINDS)}")
    if kind == "web":
        scored = text_eval.score_answers(questions.select("qid", F.array("answers").alias("references")), predictions)
    else:
        last = predictions.groupBy("qid").agg(F.max_by("answers", "line").alias("a")).select("qid", F.get("a", 0).alias("answer"))
        scored = text_eval.page_scores(questions.select("qid", F.col("answers").alias("golds")), last)
    return scored.agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.count("*").alias("questions"))


def result_table(figures: DataFrame, datasets: list[str], metric: str = "recall") -> DataFrame:
    """(algorithm, one column for each set, mean) from figures (algorithm, dataset, metric, value); the mean is over sets that have a figure."""
    own = figures.where(F.col("metric") == metric)
    wide = own.groupBy("algorithm").pivot("dataset", datasets).agg(F.first("value"))
    held = F.filter(F.array(*[F.col(f"`{d}`") for d in datasets]), lambda x: x.isNotNull())
    mean = F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))
    return wide.withColumn("mean", mean)


def set_table(figures: DataFrame, dataset: str, metrics: list[str]) -> DataFrame:
    """(algorithm, one column for each metric) of one set; metrics that it lacks are null."""
    return figures.where(F.col("dataset") == dataset).groupBy("algorithm").pivot("metric", metrics).agg(F.first("value"))
