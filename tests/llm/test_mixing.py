import math

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing as M


def test_thresholds_are_poisson(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 7.5), ("d", 900.0)], "grp string, rate double")
    for r in M.thresholds(df).collect():
        total, rate = 0.0, r.rate / r.shares
        assert rate <= M.SHARE and len(r.cdf) < 140 and r.shares == max(1, math.ceil(r.rate / M.SHARE))
        for k, c in enumerate(r.cdf):
            p = (k == 0) * 1.0 if rate == 0 else math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            total += p
            assert abs(c - total) < 1e-9
        assert abs(r.cdf[-1] - 1) < 1e-9


def test_weights_are_met(spark):
    docs = spark.range(40000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "rare").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit("x" * 10).alias("text"),
    )
    made = M.mix(docs, {"hot": 0.25, "rare": 0.25}, 0.5).groupBy("doc.source").count().collect()
    n = {r.source: r["count"] for r in made}
    total = sum(n.values())
    assert abs(total - 40000) < 1500 and abs(n["hot"] / total - 0.25) < 0.02 and abs(n["rare"] / total - 0.25) < 0.03


def test_tiny_source_and_rows_without_id(spark):
    rows = [(k, "x" * 200, "s") for k in range(2000)] + [(None, f"null {k}" + "y" * 40, "none") for k in range(10_000)] + [(7, "z" * 50, "one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    made = M.mix(docs, {"one": 0.2, "none": 0.2}, 0.6).groupBy("doc.source").agg(F.sum(F.length("doc.text")).alias("n"), F.count("*").alias("rows"), F.count_distinct("shuffle_key").alias("keys")).collect()
    size = {r.source: r.n for r in made}
    whole = sum(len(t) for _, t, _ in rows)
    assert all(abs(size[s] / whole - w) < 0.03 for s, w in {"one": 0.2, "none": 0.2, "s": 0.6}.items())
    assert {r.source: r.rows for r in made}["one"] > 1000 and all(r["keys"] == r.rows for r in made)


def test_too_many_copies_raise(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST", 1_000_000.0)
    docs = spark.createDataFrame([(1, "x" * 4_000_000, "a"), (2, "", "b")], "doc_id bigint, text string, source string")
    with pytest.raises(Exception, match="more than 1000000.0 copies of each document of b"):
        M.mix(docs, {"b": 0.5}, 0.5).count()


def test_edge_rows(spark):
    rows = [(1, None, "a", 9), (1, None, "a", 9), (None, "", None, 1), (2, "x" * 5, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy int")
    made = M.mix(docs, {"a": 0.5}, 0.5, epochs=20.0).select("doc.*", F.col("n_copies").alias("n"), F.col("copy").alias("k")).collect()
    one = [r for r in made if r.doc_id == 1]
    assert len(one) == 2 * one[0].n and {r.k for r in one} == set(range(1, one[0].n + 1))
    assert M.mix(docs, {"a": 0.0}, 1.0).where("doc.source = 'a'").count() == 0
    assert M.mix(docs.limit(0), {"a": 0.5}, 0.5).count() == 0


def test_no_python_in_plan(spark, data):
    plan = M.op3_mixing(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
