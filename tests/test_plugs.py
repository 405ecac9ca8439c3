"""Readers, sinks, models, questions, validation and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import config
from graphloom.functions import models as M
from graphloom.operators import corpus as C
from graphloom.operators import questions as Q
from graphloom.operators import validate as V
from graphloom.sources import readers, sinks
from graphloom.streaming.ingest import ingest, paragraphs


def test_json_by_ending(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"qid": "1"}, {"qid": "2"}], indent=1))
    (tmp_path / "b.jsonl").write_text('{"qid": "3"}\n{"qid": "4"}\n')
    assert readers.read_json(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_json(spark, str(tmp_path / "b.jsonl")).count() == 2
    with pytest.raises(ValueError):
        readers.read_json(spark, "c.csv")


def test_documents_and_their_problems(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"title": "A", "text": {"p_1": {"text": "x"}}, "image": {}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"title": "B"}))
    docs = readers.read_documents(spark, str(tmp_path), "title string, text map<string,struct<text string>>, image map<string,struct<filename string>>")
    assert sorted(r.file for r in docs.collect()) == ["a.json", "b.json"]
    assert [r[:] for r in V.document_problems(docs).collect()] == [("b.json", "missing text, image")]
    sets = {"s": {"type": "page", "qa_schema": "vqa_evidence", "document_granularity": "page", "needs_dereference": False, "filename": "f"}, "t": {"type": "page", "qa_schema": "odd"}}
    assert V.validate(spark, "s", sets, {"page": ["s"]}, {"e": {"by_type": {"page": {"text": 1}}}}).count() == 0
    assert V.validate(spark, "s", sets, {"page": ["s"]}, {"e": {}}, docs).count() == 2
    assert len(V.registration_problems("t", sets, {}, {})) == 5 and V.registration_problems("u", sets, {}, {}) == ["u: not registered"]


def test_questions_by_schema(spark):
    raw = spark.read.json(spark.sparkContext.parallelize([json.dumps({"qid": 1, "question": "q", "answers": [{"answer": 5}], "evidences": [{"gold_image": "d_1.jpeg"}]})]))
    assert readers.parse_questions(raw, "vqa_evidence").first().evidences[0].doc == "d_1"
    raw = spark.read.json(spark.sparkContext.parallelize([json.dumps({"qid": "1", "question": "q", "answers": [{"answer": "a"}], "evidences": [{"mmqa_doc_modality": "text", "gold_webpage_title": "T", "gold_component_id": "p_1"}, {"mmqa_doc_modality": "image"}]})]))
    got = readers.parse_questions(raw, "mmqa_component").first()
    assert got.answers == ["a"] and [e[:] for e in got.evidences] == [("text", "T", "p_1", None), ("image", None, None, None)]
    raw = spark.read.json(spark.sparkContext.parallelize([json.dumps({"qid": "1", "question": "q", "answers": [], "evidences": [{"mmqa_doc_modality": "text", "gold_pdf_name": "P", "gold_page": "p_3.png", "gold_page_score": 1}]}), '{"qid":"2","question":"r","answers":[{"answer":"x"}],"evidences":[]}']))
    assert [e[:] for e in readers.parse_questions(raw, "mmqa_page").where("qid = '1'").first().evidences] == [("text", "P", "p_3", 1.0)]
    with pytest.raises(ValueError, match="vqa_evidence"):
        readers.parse_questions(raw, "unknown")
    with pytest.raises(ValueError, match="already"):
        M.QA_SCHEMAS.register("mmqa_page")(print)


def test_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PNG").write_bytes(b"\x89PNG\r\n\x1a\nrest")
    (tmp_path / "b.jpg").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"\xff\xd8\xff")
    images = readers.read_images(spark, str(tmp_path))
    assert sorted(r.name for r in images.select("name").collect()) == ["a.PNG", "b.jpg"]
    assert [r.file for r in readers.page_targets(images).collect()] == ["a.PNG"]


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("root: ${REPO_ROOT}/x\nsub:\n  - a: '${REPO_ROOT}'\n    n: 3\n")
    assert readers.read_yaml(str(tmp_path / "c.yaml"), "/r") == {"root": "/r/x", "sub": [{"a": "/r", "n": 3}]}


def test_index_tables(spark):
    vec = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "row int, vec array<double>")
    names = spark.createDataFrame([(0, "d", "a"), (1, "d", "b")], "row int, doc string, cid string")
    assert readers.embedding_shards([(vec, names), (vec, names)]).count() == 4
    index = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "row int, id string")
    assert sorted(r[:] for r in readers.inverted(index, "row", "id").collect()) == [("x", 1), ("y", 3)]
    lines = spark.createDataFrame([("q", ["a"], 1), ("q", ["b"], 2)], "qid string, answers array<string>, line int")
    assert readers.latest_answers(lines).first().answers == ["b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "a int, b double")
    path = str(tmp_path / "out")
    sinks.append_lines(df, path)
    sinks.append_lines(df, path)
    assert spark.read.json(path).count() == 2
    sinks.overwrite_json(df, path)
    assert spark.read.json(path).count() == 1
    with pytest.raises(FileExistsError):
        sinks.guarded(df, path)
    sinks.guarded(df, path, force_overwrite=True)
    sinks.save_graph({"nodes": df, "links": df}, str(tmp_path / "g"))
    assert sinks.load_graph(spark, str(tmp_path / "g"), ["nodes"])["nodes"].count() == 1
    sinks.save_config(spark, config.run_config(top_k=5), str(tmp_path / "c"))
    assert json.loads(spark.read.text(str(tmp_path / "c")).first()[0])["top_k"] == 5
    assert sinks.formatted(df).first()[:] == (1, "0.5000")
    with pytest.raises(ValueError, match="topk"):
        config.run_config(topk=5)


def test_questions_to_vectors(spark):
    def model():  # local, so that workers get it by value
        def ask(prompt):
            if "Kind:" in prompt:
                return "table" if "size" in prompt else "text"
            if "fail" in prompt:
                raise RuntimeError
            return '["size of a", "b"]'

        return ask

    asked = spark.createDataFrame([("q1", "what"), ("q2", "done"), ("q3", "fail")], "qid string, question string")
    subs = Q.decompose(asked, model, done=asked.where("qid = 'q2'").select("qid")).cache()
    assert sorted((r.sqid, r.subquery) for r in subs.collect()) == [("q1___0", "size of a"), ("q1___1", "b"), ("q3___0", "")]
    assert Q.decompose(asked, model, limit=1).select("qid").distinct().count() == 1
    told = Q.with_vectors(Q.with_modality(subs, model), M.HashingEncoder).cache()
    assert sorted((r.sqid, r.modality) for r in told.collect()) == [("q1___0", "table"), ("q1___1", "text"), ("q3___0", "text")]
    r = told.where("sqid = 'q1___0'").first()
    assert r.v_agnostic != r.v_aware and len(r.v_aware) == 64
    assert Q.vectors_of_mode(told, "aware").count() == 3
    with pytest.raises(ValueError):
        Q.vectors_of_mode(told, "both")
    v = told.select("sqid", F.col("v_agnostic").alias("vec"))
    q, s = Q.assemble(asked, asked.where("qid <> 'q3'").select("qid", F.array(F.lit(1.0)).alias("vec")), subs, v, v)
    assert q.count() == 2 and s.count() == 2
    assert [x.subquery for x in Q.collected(subs).where("qid = 'q1'").first().subqueries] == ["size of a", "b"]
    out = Q.answer_questions(spark.createDataFrame([("q", "p")], "qid string, prompt string"), lambda: lambda p: 'the answer is: f_answers(["x"])')
    assert out.first().predicted_answer == ["x"]


def test_encoder_is_loaded_once_a_task_and_freed(spark):
    class Counting(M.HashingEncoder):
        def load_model(self):
            self.ready = True

        def encode_corpus(self, texts, images):
            assert self.ready
            return super().encode_corpus(texts, images)

        def delete_model(self):
            self.ready = False

    df = spark.createDataFrame([("a b",), (None,), ("b a",)], "text string")
    got = [r.vec for r in M.encode(df, Counting).collect()]
    assert got[0] == got[2] and sum(x * x for x in got[0]) == pytest.approx(1) and not any(got[1])
    assert M.ENCODERS.get("hashing") is M.HashingEncoder


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    make = lambda k: spark.createDataFrame([(k, "A b. C d.\n\nE."), (k + 1, None)], "doc_id bigint, text string")
    make(1).write.mode("append").parquet(str(src))
    for k in (1, 5):
        ingest(spark, str(src), make(0).schema, out).awaitTermination()
        if k == 1:
            make(5).write.mode("append").parquet(str(src))
    ingest(spark, str(src), make(0).schema, out).awaitTermination()
    got = spark.read.parquet(out + "/sentences")
    want = C.sentences(paragraphs(make(1).unionByName(make(5))))
    assert sorted(r[:] for r in got.select(*want.columns).collect()) == sorted(r[:] for r in want.collect())


def test_hashing_encoder_hashes_a_word_once(monkeypatch):
    """Words are hashed once for all texts, and count as they did word by word."""
    import hashlib as real

    import numpy as np

    from graphloom.functions import models

    def plainly(words, dim):
        row = np.zeros(dim)
        for word in words:
            h = int(real.md5(word.encode()).hexdigest()[:12], 16)
            row[h // 2 % dim] += 1 if h % 2 else -1
        n = np.linalg.norm(row)
        return row / n if n else row

    texts = [f"Word {k % 7} and word {k % 3}, x{k % 5}" for k in range(1200)] + ["", None]
    images = [["a/B.png"] if k % 4 == 0 else [] for k in range(1202)]
    calls = []
    monkeypatch.setattr(models.hashlib, "md5", lambda b, md5=real.md5: calls.append(b) or md5(b))
    made = models.HashingEncoder(16).encode_corpus(texts, images)
    assert len(calls) == len(set(calls)) < 20
    for row, text, paths in zip(made, texts, images, strict=True):
        assert row.tolist() == plainly([*(w.strip(",") for w in (text or "").lower().split()), *paths], 16).tolist()
