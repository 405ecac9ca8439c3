"""Exact nearest neighbours by inner product: blocks of vectors against all questions at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.vector import ordered_products

#: Questions that are broadcast at once, and best vectors that a task holds for all of them; more questions make several blocks.
QUESTIONS_PER_BLOCK, HELD = 4096, 1 << 19
#: Estimated bytes of vectors from which a part of them, one in SHARE, is searched first, for a bound to the best scores.
LARGE, SHARE = 1 << 33, 64
#: Results that a task of several blocks holds at once, for a part of its questions; questions and vectors that are multiplied at once.
PART, TILE = 1 << 18, (128, 2048)
#: Vectors that a task compares with a block of questions, where there are several blocks.
VECTORS_PER_BLOCK = 65536


def ranked(df: DataFrame, k: int, partition: str = "qid", score: str = "score", tie: str = "node") -> DataFrame:
    """The k best rows of each question with rank; ties go by node."""
    w = W.partitionBy(partition).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _keys(nodes: pa.Array) -> list[np.ndarray]:
    """Arrays that sort as the nodes do; fields of a struct one after the other."""
    if pa.types.is_struct(nodes.type):
        return [k for field in nodes.flatten() for k in _keys(field)]
    return [nodes.to_numpy(zero_copy_only=False)]


def _best(q: np.ndarray, score: np.ndarray, nodes: pa.Array, k: int) -> np.ndarray:
    """Places of the k first of each question, by score and then by node, sorted by question."""
    order = np.lexsort((*_keys(nodes)[::-1], -score, q))
    first = np.flatnonzero(np.diff(q[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < k]


def _promising(q: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, vector, score) of all pairs that score least or more and may be among a question's k best of x.

    Fast products, whose sums are in any order, tell which pairs these may be, with room for rounding; their scores are summed in order.
    """
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rough = q @ x.T
    room = 4e-16 * (q.shape[1] + 2) * np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1).max(initial=0.0))
    if not (np.isfinite(rough).all() and np.isfinite(room).all()):
        score = ordered_products(q, x)
        i, j = np.nonzero(score >= least[:, None])
        return i, j, score[i, j]
    floor = least[:, None] - room
    if k < len(x):
        floor = np.maximum(floor, np.partition(rough, len(x) - k, axis=1)[:, len(x) - k, None] - 2 * room)
    i, j = np.nonzero(rough >= floor)
    score = np.zeros(len(i))
    for d in range(q.shape[1]):
        score += q[i, d] * x[j, d]
    keep = score >= least[i]
    return i[keep], j[keep], score[keep]


def _search(q: np.ndarray, bound: np.ndarray, batches, k: int):
    """(question, score, nodes) of the k best of all batches for each question; what is below its bound isn't looked at."""
    least = bound.copy()
    parts: list[tuple] = []
    size = 0

    def settle() -> None:
        nonlocal parts, size
        i, s = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:2])
        nodes = pa.concat_arrays([x[2] for x in parts])
        keep = _best(i, s, nodes, k)
        i, s = i[keep], s[keep]
        parts, size = [(i, s, nodes.take(pa.array(keep)))], len(keep)
        full = np.flatnonzero(np.bincount(i, minlength=len(q)) == k)
        least[full] = s[np.searchsorted(i, full, side="right") - 1]

    for batch in batches:
        for at in range(0, batch.num_rows, TILE[1]):
            part = batch.slice(at, TILE[1])
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            for first in range(0, len(q), TILE[0]):
                i, j, score = _promising(q[first : first + TILE[0]], x, least[first : first + TILE[0]], k)
                if len(i):
                    parts.append((i + first, score, part.column(0).take(pa.array(j))))
                    size += len(i)
                if size > 2 * len(q) * k + 65536:
                    settle()
    if parts:
        settle()
        yield parts[0]


def _found(held, bounds, corpus: DataFrame, k: int) -> DataFrame:
    """(q, node, score): the k best of each task."""
    schema = T.StructType().add("q", "integer").add("node", corpus.schema["node"].dataType).add("score", "double")

    def run(batches):
        for i, s, nodes in _search(held.value, bounds.value, batches, k):
            for at in range(0, len(i), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(i[at : at + 10_000].astype(np.int32)), nodes.slice(at, 10_000), pa.array(s[at : at + 10_000])], names=["q", "node", "score"])

    return corpus.select("node", "vec").where("vec is not null").mapInArrow(run, schema)


def _few(questions: list, corpus: DataFrame, k: int, id_type: T.DataType) -> DataFrame:
    """The search for one block of questions, which is broadcast; the corpus stays where it is."""
    context = corpus.sparkSession.sparkContext
    ids = [r[0] for r in questions]
    held = context.broadcast(np.array([r[1] for r in questions], np.float64))
    bound = np.full(len(ids), -np.inf)
    size = int(corpus._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if k and size > LARGE:
        # The k-th best of a part is no better than the k-th best of all: tasks needn't give what is below it.
        part = _found(held, context.broadcast(bound), corpus.sample(1 / SHARE, seed=1), k)
        for r in ranked(part, k, "q").where(F.col("rank") == k).select("q", "score").collect():
            bound[r.q] = r.score
    found = _found(held, context.broadcast(bound), corpus, k)
    names = corpus.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType().add("n", "integer").add("qid", id_type))
    return ranked(found.join(F.broadcast(names), F.col("q") == F.col("n")).select("qid", "node", "score"), k)  # names has a block's rows


def _many(questions: DataFrame, corpus: DataFrame, k: int, count: int, most: int) -> DataFrame:
    """The search for any number of questions, in one plan: each block of questions meets each block of vectors in a task of its own.

    Blocks are made by hashes on the cluster and are of bounded size, most questions and VECTORS_PER_BLOCK vectors or
    a little more; a block pair gives its k best for each of its questions.
    """
    asked, there = -(-count // most), -(-corpus.count() // VECTORS_PER_BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    q = questions.select("qid", "vec", F.pmod(F.xxhash64("qid"), F.lit(asked)).cast("int").alias("qb"), each(there).alias("cb"))
    c = corpus.where("vec is not null").select("node", "vec", each(asked).alias("qb"), F.pmod(F.xxhash64("node"), F.lit(max(there, 1))).cast("int").alias("cb"))
    schema = T.StructType([T.StructField("qid", questions.schema["qid"].dataType), T.StructField("node", corpus.schema["node"].dataType), T.StructField("score", T.DoubleType())])

    def run(mine: pa.Table, vectors: pa.Table) -> pa.Table:
        if mine.num_rows and vectors.num_rows:
            held = mine.column("vec").combine_chunks()
            asked = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)
            batches = vectors.select(["node", "vec"]).to_batches(max_chunksize=TILE[1])
            made = []
            some = max(PART // max(k, 1), 1)
            for at in range(0, len(asked), some):
                ids = mine.column("qid").slice(at, some).combine_chunks()
                for i, s, nodes in _search(asked[at : at + some], np.full(len(ids), -np.inf), batches, k):
                    made.append(pa.table({"qid": ids.take(pa.array(i)), "node": nodes, "score": pa.array(s)}))
            if made:
                return pa.concat_tables(made)
        return pa.table({"qid": mine.column("qid").slice(0, 0), "node": vectors.column("node").slice(0, 0), "score": pa.array([], pa.float64())})

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(run, schema)
    return ranked(found, k)


def knn(questions: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(qid, node, score, rank) of the k vectors of corpus (node, vec) with the largest inner products with each question (qid, vec).

    Up to a block of questions is broadcast, by a count that is checked, and the corpus is read where it is; more are
    dealt in blocks with blocks of vectors, in one plan whatever their number.  Either way a
    task holds and gives its own best only.  Equal scores go by node.  Fewer than k vectors give fewer rows.
    """
    most = max(1, min(QUESTIONS_PER_BLOCK, HELD // max(k, 1)))
    first = questions.select("qid", "vec").limit(most + 1).collect()
    if not first:
        return corpus.select(F.lit(None).cast(questions.schema["qid"].dataType).alias("qid"), "node", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    if len(first) <= most:
        return _few(sorted(((r.qid, r.vec) for r in first), key=lambda r: r[0]), corpus, k, questions.schema["qid"].dataType)
    return _many(questions, corpus, k, questions.count(), max(1, min(QUESTIONS_PER_BLOCK, 4 * HELD // max(k, 1))))
