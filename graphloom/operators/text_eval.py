"""Evaluation of answers: exact match and F1 over normalised spans."""

from __future__ import annotations

import re
import string
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import spread
from ..functions.kept import Kept

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
WORDS = {w: k for k, w in enumerate(_ONES)} | {w: 10 * (k + 2) for k, w in enumerate(_TENS)} | {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}
_ARTICLE = re.compile(r"\b(?:a|an|the)\b")
_NO_PUNCTUATION = str.maketrans("", "", string.punctuation)


def number(token: str) -> float | None:
    try:
        return float(token)
    except ValueError:
        return None


def _plain_token(token: str) -> list[str]:
    token = token.lower()
    if number(token) is None:
        token = token.translate(_NO_PUNCTUATION)
    value = number(token)
    if value is None:
        value = WORDS.get(token.strip())
    token = token if value is None else str(float(value))
    return _ARTICLE.sub(" ", token).split()


_TOKENS, _NUMBERS = Kept(_plain_token), Kept(lambda w: number(w) is not None)


def words(text: str) -> list[str]:
    """The words of normalise()."""
    return list(chain.from_iterable(map(_TOKENS.__getitem__, text.replace("-", " ").split(" "))))


def normalise(text: str) -> str:
    """Words in lower case without articles and punctuation, numbers and number words written as decimals."""
    return " ".join(words(text))


def assignment(scores: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), each used once, with the largest total: the Hungarian method with potentials."""
    n, m = scores.shape
    if n > m:
        return sorted((r, c) for c, r in assignment(scores.T))
    cost = -scores
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[col] = True
            r = match[col]
            slack = cost[r - 1] - u[r] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = col
            nxt = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col] = match[way[col]]
            col = way[col]
    return sorted((int(match[c]) - 1, c - 1) for c in range(1, m + 1) if match[c])


def _f1(gold: set, predicted: set) -> float:
    numbers = {w for w in gold if _NUMBERS[w]}
    if numbers and not numbers & predicted:
        return 0.0
    common = len(gold & predicted)
    precision = common / len(predicted) if predicted else 1.0
    recall = common / len(gold) if gold else 1.0
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def _em(p: list[list[str]], g: list[list[str]]) -> float:
    return float(len(p) == len(g) and (p == g or {tuple(x) for x in p} == {tuple(x) for x in g}))


def list_em(predicted: list[str], gold: list[str]) -> float:
    return _em([words(x) for x in predicted], [words(x) for x in gold])


def list_f1(predicted: list[str], gold: list[str]) -> float:
    """Mean over the longer list's length of the best one-to-one alignment's F1, to two decimals."""
    return _aligned([set(words(x)) for x in predicted], [set(words(x)) for x in gold])


def _aligned(p: list[set], g: list[set]) -> float:
    longer = max(len(p), len(g))
    if not longer:
        return 0.0
    scores = np.array([[_f1(a, b) for b in p] for a in g]).reshape(len(g), len(p))
    if min(scores.shape) < 2:
        total = scores.max(initial=0.0)
    else:
        total = sum(scores[r, c] for r, c in assignment(scores))
    return round(total / longer, 2)


_SCORES = T.StructType().add("em", "double").add("f1", "double")


@F.pandas_udf(_SCORES)
def answer_scores(predicted: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """em and f1 of two arrays of strings; a missing prediction scores 0."""
    return pd.DataFrame([_best(p, [g]) for p, g in zip(predicted, gold, strict=True)], columns=["em", "f1"])


@F.pandas_udf(_SCORES)
def best_scores(predicted: pd.Series, references: pd.Series) -> pd.DataFrame:
    """The best em and f1 of an array of strings over references, an array of such arrays."""
    return pd.DataFrame([_best(p, r) for p, r in zip(predicted, references, strict=True)], columns=["em", "f1"])


def _best(predicted, references) -> tuple[float, float]:
    """em and f1, the best of all references; each text is split into words once."""
    if predicted is None:
        return 0.0, 0.0
    p = [words(x) for x in predicted]
    sets = [set(x) for x in p]
    em = f1 = 0.0
    for reference in references:
        if reference is not None:
            g = [words(x) for x in reference]
            em, f1 = max(em, _em(p, g)), max(f1, _aligned(sets, [set(x) for x in g]))
    return em, f1


def score_answers(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(qid, em, f1) of every gold question (qid, references), references an array of answers, each an array of strings.

    The best over references counts; a question without prediction (qid,
    answers) scores 0; of repeated predictions, that with the largest line counts.
    """
    last = predictions.groupBy(F.col("qid").alias("p")).agg(F.max_by("answers", "line").alias("answers"))
    # Dealt out by question: a few bytes of text take long to score.
    each = spread(gold.where(F.size("references") > 0).select("qid", "references"), "qid").join(last, F.col("qid") == F.col("p"), "left")
    each = each.select("qid", best_scores("answers", "references").alias("s"))
    return each.groupBy("qid").agg(F.max("s.em").alias("em"), F.max("s.f1").alias("f1"))


def breakdown(scored: DataFrame, categories: list[str]) -> DataFrame:
    """Means times 100 over all and by each category alone, in one pass: (category, value, em, f1, n)."""
    parts = F.array(F.struct(F.lit("all").alias("category"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in categories])
    rows = scored.select("em", "f1", F.explode(parts).alias("part"))
    return rows.groupBy("part.category", "part.value").agg((F.avg("em") * 100).alias("em"), (F.avg("f1") * 100).alias("f1"), F.count("*").alias("n"))


#: Question types with the modalities of their first and second hop; those of one hop have no second.
HOPS = {
    "TextQ": ("text", None),
    "TableQ": ("table", None),
    "ImageQ": ("image", None),
    "ImageListQ": ("image", None),
    "Compose(TableQ,ImageListQ)": ("image", "table"),
    "Compose(TextQ,ImageListQ)": ("image", "text"),
    "Compose(ImageQ,TableQ)": ("table", "image"),
    "Compose(ImageQ,TextQ)": ("text", "image"),
    "Compose(TextQ,TableQ)": ("table", "text"),
    "Compose(TableQ,TextQ)": ("text", "table"),
    "Intersect(TableQ,TextQ)": ("text", "table"),
    "Intersect(ImageListQ,TableQ)": ("image", "table"),
    "Intersect(ImageListQ,TextQ)": ("text", "image"),
    "Compare(Compose(TableQ,ImageQ),TableQ)": ("image", "table"),
    "Compare(Compose(TableQ,ImageQ),Compose(TableQ,TextQ))": ("image", "text"),
    "Compare(TableQ,Compose(TableQ,TextQ))": ("text", "table"),
}
_COMBINES = "(?i)compose|intersect|compare|bridge"


def hops(question_type: Column) -> Column:
    """A struct (first, second) of the modalities of a known question type's hops; null for others."""
    pair = lambda v: F.struct(F.lit(v[0]).cast("string").alias("first"), F.lit(v[1]).cast("string").alias("second"))
    known = F.create_map(*[x for k, v in HOPS.items() for x in (F.lit(k), pair(v))])
    return F.try_element_at(known, question_type)


def hop(question_type: Column) -> Column:
    """multi if the question type has a second hop or, where it isn't known, if its name says that it combines others; else single."""
    known = hops(question_type)
    many = F.when(known.isNotNull(), known["second"].isNotNull()).otherwise(question_type.rlike(_COMBINES))
    return F.when(many, "multi").otherwise("single")


def _plain(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def answers_match(predicted: Column, golds: Column) -> Column:
    """Whether a page answer is one of golds, up to spaces, case, a per cent sign on one side only, or 5 % of a gold number other than 0."""
    p = _plain(predicted)

    def one(raw: Column) -> Column:
        g = _plain(raw)
        bare = lambda x: F.replace(x, F.lit("%"), F.lit(""))
        p2 = F.when(p.contains("%") & ~g.contains("%"), bare(p)).otherwise(p)
        g2 = F.when(g.contains("%") & ~p.contains("%"), bare(g)).otherwise(g)
        pn, gn = bare(p2).try_cast("double"), bare(g2).try_cast("double")
        near = F.coalesce(F.abs(pn - gn) <= 0.05 * F.abs(gn), F.lit(False))
        return (p2 == g2) | (near & ~g2.isin("0", "0.0"))

    return F.coalesce(F.exists(golds, one), F.lit(False))


def page_scores(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(qid, em, f1) of page questions (qid, golds) with one answer string each (qid, answer); missing ones score 0."""
    p = predictions.select(F.col("qid").alias("p"), F.col("answer"))
    rows = spread(gold, "qid").join(p, F.col("qid") == F.col("p"), "left")
    each = rows.select("qid", F.when(answers_match(F.col("answer"), F.col("golds")), 1.0).otherwise(0.0).alias("em"), "answer", F.explode_outer("golds").alias("g"))
    each = each.select("qid", "em", answer_scores(F.when(F.col("answer").isNotNull(), F.array("answer")), F.when(F.col("g").isNotNull(), F.array("g"))).alias("s"))
    return each.groupBy("qid").agg(F.max("em").alias("em"), F.max("s.f1").alias("f1"))
