"""A component graph over the embeddings table, by whole-number rules: five vectors to an upper component, four of these to a document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Graph:
    questions: DataFrame
    subqueries: DataFrame
    tops: DataFrame
    low: DataFrame
    links: DataFrame
    gold: DataFrame
    #: gold without its pairs: each question's label (qid, gid), and the upper components of each label (gid, node).
    labels: DataFrame
    members: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Graph:
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    size = emb.agg(F.count("*").alias("n"), (F.max(F.expr("vec_id div 20")) + 1).alias("docs")).first()
    n, n_docs = size.n, size.docs or 1
    rows = emb.select(F.col("vec_id").alias("node"), F.expr("vec_id div 5").alias("top"), F.expr("vec_id div 20").alias("doc"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    tops = rows.where("node % 5 = 0").select(F.col("top").alias("node"), "doc", "vec")
    links = tops.where("node % 3 = 0").select(F.col("node").alias("top"), ((F.col("node") * 7 + 3) % n_docs).alias("dst"))
    asked = rows.where("node % 25 = 0").select(F.col("node").alias("qid"), "vec", "label")
    wanted = asked.select("qid", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("sq_pos"))
    wanted = wanted.select("qid", "sq_pos", ((F.col("qid") + 11 * F.col("sq_pos")) % max(n, 1)).alias("of"))
    subqueries = wanted.join(rows.select(F.col("node").alias("id"), "vec"), F.col("of") == F.col("id")).select("qid", "sq_pos", "vec")
    members = rows.select("top", F.col("label").alias("l")).distinct()
    gold = asked.join(members, F.col("label") == F.col("l")).select("qid", F.col("top").alias("node"))
    return Graph(asked.select("qid", "vec"), subqueries, tops, rows.select("node", "top", "vec"), links, gold, asked.where("label is not null").select("qid", F.col("label").alias("gid")), members.select(F.col("l").alias("gid"), F.col("top").alias("node")))
