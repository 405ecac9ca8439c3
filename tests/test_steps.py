"""The corpus steps, working copies, merged writers and a set's report on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import validate_set
from graphloom.functions import models as M
from graphloom.operators import steps as S
from graphloom.operators import text_eval as T
from graphloom.plans import file_queries
from graphloom.sources import readers, sinks


@pytest.fixture(scope="module")
def parsed(spark, data):
    return file_queries._parsed(spark, data)


def test_steps_resume_and_need_each_other(spark, parsed, tmp_path):
    out = str(tmp_path / "c")
    with pytest.raises(ValueError, match="unknown steps: sort"):
        S.build(spark, parsed, out, ["sort"])
    with pytest.raises(ValueError, match="step edges needs the table of step sentences"):
        S.build(spark, parsed, out, ["links", "edges"])
    made = S.build(spark, parsed, out, ["sentences"])
    assert sorted(made) == ["links", "sentences"]
    before = (tmp_path / "c" / "sentences" / "_SUCCESS").stat().st_mtime_ns
    small = S.Parsed(parsed.paragraphs.limit(0), parsed.links, parsed.tables, parsed.images, parsed.titles, parsed.documents)
    again = S.build(spark, small, out, ["sentences", "segments"])
    assert (tmp_path / "c" / "sentences" / "_SUCCESS").stat().st_mtime_ns == before and "segments" in again
    assert S.build(spark, small, out, ["sentences"], overwrite=True)["sentences"].count() == 0


def test_replaced_and_artifact(spark, tmp_path):
    source, path = str(tmp_path / "s"), str(tmp_path / "a")
    spark.range(3).write.parquet(source)
    sinks.replaced(sinks.artifact(spark, source, path).selectExpr("id + 10 as id"), path)
    assert sorted(r.id for r in sinks.artifact(spark, source, path).collect()) == [10, 11, 12]
    assert sorted(r.id for r in spark.read.parquet(source).collect()) == [0, 1, 2]
    with pytest.raises(Exception):
        sinks.replaced(sinks.artifact(spark, source, path).select(F.raise_error(F.lit("no"))), path)
    assert sorted(r.id for r in sinks.artifact(spark, source, path).collect()) == [10, 11, 12]


def test_merged_and_checked_shards(spark):
    part = lambda *rows: spark.createDataFrame(list(rows), "qid string, line bigint")
    merged = readers.merged_lines([part(("a", 0), ("b", 1)), part(), part(("c", 0))])
    assert sorted((r.line, r.qid) for r in merged.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    vecs = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "row bigint, vec array<double>")
    names = spark.createDataFrame([(0, "d", "p_1")], "row bigint, doc string, cid string")
    with pytest.raises(ValueError, match="shard 1 has 2 vectors and 1 names"):
        readers.checked_shards([(vecs.limit(1), names), (vecs, names)])


def test_failures_are_told(spark):
    def model():
        return lambda p: str(1 // int(p))

    rows = spark.createDataFrame([("1",), ("0",), ("x",)], "p string").select("p", M.generated(F.col("p"), model).alias("s")).collect()
    got = {r.p: r.s[:] for r in rows}
    assert got["1"] == ("1", None) and got["0"] == ("", "ZeroDivisionError: integer division or modulo by zero") and got["x"][0] == "" and got["x"][1].startswith("ValueError")


def test_hops_cover_the_types(spark):
    assert len(T.HOPS) == 16 and sum(v[1] is None for v in T.HOPS.values()) == 4
    rows = spark.createDataFrame([("Compose(TextQ,TableQ)",), ("TextQ",), ("Bridge(X)",), (None,)], "t string").select(T.hop(F.col("t")), T.hops(F.col("t"))).collect()
    assert [(r[0], r[1] and r[1][:]) for r in rows] == [("multi", ("table", "text")), ("single", ("text", None)), ("multi", None), ("single", None)]


def test_validator_command(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps({"title": "A", "text": {"p_1": {"text": "x"}}}))
    own = {"type": "page", "qa_schema": "vqa_evidence", "document_granularity": "page", "needs_dereference": False, "filename": "f"}
    (tmp_path / "s.yaml").write_text(json.dumps({"sets": {"s": own}, "sets_by_type": {"page": ["s"]}, "encoders": {"e": {"by_type": {"page": {"text": 1}}}}}))
    assert validate_set.main(spark, [str(tmp_path / "s.yaml"), "s"]) == 0
    assert validate_set.main(spark, [str(tmp_path / "s.yaml"), "s", str(tmp_path / "docs")]) == 1
    assert validate_set.main(spark, [str(tmp_path / "s.yaml"), "t"]) == 1
    assert capsys.readouterr().out.splitlines() == ["no problems", "1. a.json: missing image", "1. t: not registered"]
