"""Metrics of ranked results and of answers."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import llm_text
from graphloom.operators import rank_eval as E
from graphloom.operators import text_eval as T


def frame(spark, golds, run):
    gold = spark.createDataFrame(list(golds.items()), "qid string, golds array<string>")
    rows = [(q, d, k + 1) for q, docs in run.items() for k, d in enumerate(docs)]
    return gold, spark.createDataFrame(rows, "qid string, doc string, rank int")


def test_recall_and_mrr_denominators(spark):
    golds = {"a": ["x", "y"], "b": ["z"], "none": [], "missing": ["x"], "late": ["w"]}
    run = {"a": ["q", "x", "r", "y"], "b": ["z"], "none": ["x"], "late": [f"d{k}" for k in range(10)] + ["w"], "extra": ["x"]}
    gold, got = frame(spark, golds, run)
    assert E.recall(gold, got, 3).first()[:] == (pytest.approx((0.5 + 1 + 0) / 3), 3)
    assert E.mrr(gold, got, 10).first()[:] == (pytest.approx((0.5 + 1 + 0 + 0) / 4), 4)
    assert E.page_metrics(gold, got).first().recall == pytest.approx(0.5)


def test_component_metrics_count_missing_questions(spark):
    golds = {"a": ["x", "x", "y"], "b": ["z"], "missing": ["x"]}
    gold, got = frame(spark, golds, {"a": ["q", "r", "s", "x"], "b": ["z", "z"]})
    m = E.component_metrics(gold, got, 9, F.col("doc")).first()
    assert m.recall == pytest.approx((1 / 3 + 1 + 0) / 3) and m.mrr == pytest.approx((1 / 2 + 1 + 0) / 3) and m.questions == 3


def test_parsing(spark):
    node = "struct<doc:string,cid:string>"
    units = [[("d1.json", "p_1_s2"), ("d2.json", "t_1")]], [[("d1.json", "p_1_s9")]], [[(f"d{k}.json", "i_1")] for k in range(60)]
    data = [("q", [(u[0],) if isinstance(u[0], list) else (u,) for u in [units[0], units[1], *[[x] for x in units[2]]]]), ("empty", [])]
    df = spark.createDataFrame(data, f"qid string, units array<struct<nodes:array<{node}>>>")
    got = E.parse_components(df).orderBy("rank").collect()
    assert len(got) == 50 and [(r.doc, r.cid) for r in got[:3]] == [("d1", "p_1"), ("d2", "t_1"), ("d0", "i_1")]
    assert [r.doc for r in E.parse_pages(df).orderBy("rank").collect()][:3] == ["d1", "d2", "d0"]
    base = spark.createDataFrame([("1", [([("a_b_3.jpeg", "x")],)]), ("q9", [([("c_4.jpg", "x")],)])], f"qid string, units array<struct<nodes:array<{node}>>>")
    questions = spark.createDataFrame([("1", "named")], "position string, qid string")
    assert sorted(r[:] for r in E.parse_baseline(base, (".jpeg", ".jpg"), questions).collect()) == [("named", "a_b", "a_b_3", 1), ("q9", "c", "c_4", 1)]
    gold = spark.createDataFrame([("named", ["a_b_3", "plain"]), ("q9", ["c_5"])], "qid string, golds array<string>")
    assert E.page_number_metrics(gold, E.parse_baseline(base, (".jpeg", ".jpg"), questions), 3).first()[:] == (0.5, 0.5, 2)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("The Blue-Lake.", "blue lake"), ("1,000 an 12", "1000.0 12.0"), ("Twenty one", "20.0 1.0"), ("12%", "12.0"), ("a", ""), ("3.50", "3.5"), ("", ""), ("U.S.", "us")],
)
def test_normalise(raw, want):
    assert T.normalise(raw) == want


def test_assignment_is_the_best_one():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        s = rng.random((n, m)).round(1)
        pairs = T.assignment(s)
        best = max(sum(s[r, c] for r, c in zip(range(n), p, strict=False)) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(s[r, c] for r, c in zip(p, range(m), strict=False)) for p in itertools.permutations(range(n), m))
        assert sum(s[r, c] for r, c in pairs) == pytest.approx(best) and len(pairs) == min(n, m)


def test_list_scores():
    assert T.list_em(["The Lake", "b"], ["b", "lake"]) == 1.0 and T.list_em(["b", "b"], ["b"]) == 0.0
    assert T.list_f1(["blue lake"], ["blue lake", "x"]) == 0.5
    assert T.list_f1(["12 km"], ["13 km"]) == 0.0 and T.list_f1(["big lake"], ["lake"]) == 0.67
    assert T.list_f1([], []) == 0.0 and T.list_f1(["a"], ["b"]) in (0.0, 1.0)


def test_answers_over_references(spark):
    gold = spark.createDataFrame([("a", [["x"], ["y z"]]), ("b", [["q"]]), ("c", [["1"]])], "qid string, references array<array<string>>")
    got = spark.createDataFrame([("a", ["no"], 1), ("a", ["y z"], 2), ("b", [""], 1)], "qid string, answers array<string>, line int")
    s = {r.qid: (r.em, r.f1) for r in T.score_answers(gold, got).collect()}
    assert s == {"a": (1.0, 1.0), "b": (0.0, 0.0), "c": (0.0, 0.0)}


@pytest.mark.parametrize(
    ("said", "gold", "match"),
    [(" A  b", "a B", True), ("12%", "12", True), ("12", "12 %", True), ("104", "100", True), ("106", "100", False), ("95", "100", True), ("0.01", "0", False), ("0", "0", True), ("-104", "-100", True), (None, "x", False), ("x", "y", False)],
)
def test_page_answers(spark, said, gold, match):
    df = spark.createDataFrame([(said, [gold, "zzz"])], "p string, g array<string>")
    assert df.select(T.answers_match(F.col("p"), F.col("g"))).first()[0] is match


def test_model_texts(spark):
    fence = "```"
    said = ["text", f"{fence}json\nTable\n{fence}", " image.", "none", None, "Tables"]
    df = spark.createDataFrame([(x,) for x in said], "x string")
    assert [r[0] for r in df.select(llm_text.modality(F.col("x"))).collect()] == ["text", "table", "image", "text", "text", "table"]
    subs = ['["a", "b"]', f'x {fence}json\n["c"]\n{fence} y', "plain", '["broken', '"word"']
    df = spark.createDataFrame([(x,) for x in subs], "x string")
    assert [r[0] for r in df.select(llm_text.subqueries(F.col("x"))).collect()] == [["a", "b"], ["c"], ["plain"], ['["broken'], ['"word"']]
    ans = ['Therefore, the answer is: f_answers(["x", "y"])', "answer is: 5 answer is: 6", "bare", 'f_answers("z")']
    df = spark.createDataFrame([(x,) for x in ans], "x string")
    assert [r[0] for r in df.select(llm_text.answer_values(F.col("x"))).collect()] == [["x", "y"], ["5"], ["bare"], ["z"]]
    df = spark.createDataFrame([("1,200 and 0 or 2.5 x",)], "x string")
    assert df.select(llm_text.numbers(F.col("x"))).first()[0] == [1200.0, 2.5]


def test_json_objects():
    assert llm_text.json_objects('a {"x": {"y": 1}} {bad} {"z": 2} {"open": {"y": 3}') == ['{"x": {"y": 1}}', '{"z": 2}']
    assert llm_text.json_objects(None) == [] and llm_text.json_objects("}{") == []
    assert len(llm_text.json_objects('{"a":1}' * 1000)) == 1000


def test_breakdown_and_hops(spark):
    rows = [(random.Random(k).randint(0, 1) * 1.0, 0.5, f"t{k % 2}") for k in range(10)]
    df = spark.createDataFrame(rows, "em double, f1 double, kind string")
    out = {(r.category, r.value): (r.em, r.n) for r in T.breakdown(df, ["kind"]).collect()}
    assert out["all", "all"] == (pytest.approx(sum(r[0] for r in rows) * 10), 10) and out["kind", "t0"][1] == 5
    kinds = spark.createDataFrame([("Compose(TextQ,ImageQ)",), ("TextQ",)], "t string")
    assert [r[0] for r in kinds.select(T.hop(F.col("t"))).collect()] == ["multi", "single"]


def test_sweep(spark):
    runs = spark.createDataFrame([("m_ni1_bw5", "s", 1.0, 10.0), ("m_ni1_bw5", "s", 3.0, 20.0), ("other", "s", 9.0, 9.0)], "name string, dataset string, score double, ms double")
    assert E.sweep(runs, {"s": 100.0}).first()[:] == ("s", 1, 5, 2.0, 115.0)


def test_scores_of_long_texts_read_each_once(spark, monkeypatch):
    """A predicted text is split into words once, whatever it is compared with; tokens are looked up, not made again."""
    made = []
    monkeypatch.setattr(T, "words", lambda text: made.append(text) or text.lower().split())
    assert T._best(["a b c"], [["a b c"], ["x"], None]) == (1.0, 1.0) and T._best(None, [["x"]]) == (0.0, 0.0)
    assert made == ["a b c", "a b c", "x"]
    calls = []
    kept = T.Kept(lambda token: calls.append(token) or [token])
    assert [kept[w] for w in ["u", "v", "u", "y" * 100, "y" * 100]] and calls == ["u", "v", "y" * 100, "y" * 100]


def test_shared_golds_are_those_of_each_question(spark):
    """Golds of a group, read once, give what arrays of them for each question give: repeats, none and missing questions too."""
    rng = random.Random(8)
    groups = {g: [f"doc_{rng.randrange(6)}_{rng.randrange(9)}" if rng.random() < 0.8 else "none" for _ in range(n)] for g, n in enumerate((9, 1, 0, 14))}
    of = {f"q{k}": k % 4 for k in range(16)}
    run = spark.createDataFrame([(f"q{k}", f"doc_{rng.randrange(6)}_{rng.randrange(9)}", r) for k in range(1, 20) for r in range(1, 13)], "qid string, page string, rank int")
    arrays = spark.createDataFrame([(q, groups[g]) for q, g in of.items()], "qid string, golds array<string>")
    shared = E.SharedGold(spark.createDataFrame(list(of.items()), "qid string, gid int"), spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "gid int, gold string"))
    numbers = lambda df: [pytest.approx(x) for x in df.first()]
    docs = run.withColumnRenamed("page", "doc")
    for one in (lambda g: E.mrr(g, docs), lambda g: E.recall(g, docs), lambda g: E.component_metrics(g, docs, 9, F.col("doc")), lambda g: E.page_number_metrics(g, run, 10), lambda g: E.page_metrics(g, docs)):
        assert numbers(one(arrays)) == list(one(shared).first())


def test_golds_grow_with_vectors_only(spark, data):
    """No join of questions with all golds of their label."""
    from graphloom.plans import eval_queries

    plan = eval_queries.page_recall_tolerance(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
