"""Questions to sub-queries, their modalities and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import llm_text
from ..functions.models import Encoder, encode, generate, generated
from .corpus import pending

DECOMPOSE = (
    "Split the question into one to five search requests. Each must stand for itself and find one sentence, paragraph, table row or picture; "
    "together they must keep every name and phrase of the question. Use one request if one place can answer it; put what others depend on first. "
    "Give a JSON array of strings and nothing else.\n\nQuestion: {}\n\nRequests: "
)
MODALITY = "Would the answer to this request stand in running text, in a table or in an image? Say text, table or image and nothing else.\n\nRequest: {}\n\nKind: "
#: What goes before a sub-query for an encoder that takes instructions.
INSTRUCTIONS = {"text": "Find a text that answers this.", "table": "Find a table that answers this.", "image": "Find an image that answers this."}


def _prompt(template: str, column: str):
    a, b = template.split("{}")
    return F.concat(F.lit(a), F.col(column), F.lit(b))


def decompose(questions: DataFrame, model: Callable, done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(qid, sq_pos, sqid, subquery) of questions (qid, question) that are not done; limit keeps the first by qid."""
    asked = questions.select("qid", "question")
    if limit is not None:
        asked = asked.orderBy("qid").limit(limit)
    if done is not None:
        asked = pending(asked, done, "qid")
    raw = asked.select("qid", generate(_prompt(DECOMPOSE, "question"), model).alias("raw"))
    rows = raw.select("qid", F.posexplode(llm_text.subqueries(F.col("raw"))).alias("sq_pos", "subquery"))
    return rows.select("qid", "sq_pos", F.concat(F.col("qid").cast("string"), F.lit("___"), F.col("sq_pos")).alias("sqid"), "subquery")


def with_modality(subqueries: DataFrame, model: Callable) -> DataFrame:
    """subqueries with modality: text, table or image."""
    return subqueries.withColumn("_raw", generate(_prompt(MODALITY, "subquery"), model)).withColumn("modality", llm_text.modality(F.col("_raw"))).drop("_raw")


def with_vectors(subqueries: DataFrame, encoder: Callable[[], Encoder]) -> DataFrame:
    """subqueries with v_agnostic, the vector of the text, and v_aware, that of the text behind its modality's instruction."""
    told = F.lit(None).cast("string")
    for kind, said in INSTRUCTIONS.items():
        told = F.when(F.col("modality") == kind, said).otherwise(told)
    both = subqueries.withColumn("_told", F.concat_ws(" ", told, "subquery"))
    return encode(encode(both, encoder, "subquery", queries=True, out="v_agnostic"), encoder, "_told", queries=True, out="v_aware").drop("_told")


def vectors_of_mode(subqueries: DataFrame, mode: str) -> DataFrame:
    """(qid, sq_pos, vec) by mode: aware or agnostic of the modality."""
    if mode not in ("aware", "agnostic"):
        raise ValueError(f"mode is {mode!r}; aware or agnostic are known")
    return subqueries.select("qid", "sq_pos", F.col(f"v_{mode}").alias("vec"))


def assemble(questions: DataFrame, question_vectors: DataFrame, subqueries: DataFrame, agnostic: DataFrame, aware: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions (qid, question, vec) and sub-queries with both vectors, from tables by qid and sqid (sqid, vec); rows without a vector go."""
    q = questions.join(question_vectors.select("qid", "vec"), "qid")
    s = subqueries.join(agnostic.select("sqid", F.col("vec").alias("v_agnostic")), "sqid").join(aware.select("sqid", F.col("vec").alias("v_aware")), "sqid")
    return q, s.join(q.select("qid"), "qid", "left_semi")


def collected(subqueries: DataFrame) -> DataFrame:
    """(qid, subqueries): an ordered array of (sqid, subquery) for each question; a question has a handful."""
    return subqueries.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("sq_pos", "sqid", "subquery"))), lambda x: F.struct(x["sqid"].alias("sqid"), x["subquery"].alias("subquery"))).alias("subqueries"))


def answer_questions(prompts: DataFrame, model: Callable) -> DataFrame:
    """(qid, predicted_answer, raw, error): what a model answers to prompts (qid, prompt), cut down to the answer's values, and what went wrong, if anything."""
    raw = prompts.select("qid", generated(F.col("prompt"), model).alias("said"))
    return raw.select("qid", llm_text.answer_values(F.col("said.answer")).alias("predicted_answer"), F.col("said.answer").alias("raw"), "said.error")
