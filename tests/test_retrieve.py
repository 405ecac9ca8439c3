"""Retrieval modes against a plain re-implementation on a small graph, and their ties and corner cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.operators import graph as G
from graphloom.operators import knn as K
from graphloom.operators import retrieve as R


def dot(a, b):
    out = 0.0
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


class Plain:
    """The same semantics with dictionaries and loops."""

    def __init__(self, seed=3, docs=6, tops=3, dim=4):
        r = random.Random(seed)
        vec = lambda: [r.randint(-3, 3) / 2 for _ in range(dim)]
        self.doc = {d * tops + t: d for d in range(docs) for t in range(tops)}
        self.top_vec = {t: vec() for t in self.doc if t % 7 != 5}
        self.low, self.parent = {}, {}
        for t in self.doc:
            for k in range(r.randint(0, 3)):
                self.low[t * 10 + k], self.parent[t * 10 + k] = vec(), t
        self.links = [(t, r.randrange(docs)) for t in self.doc for _ in range(r.randint(0, 2))]
        self.q = {q: vec() for q in range(4)}
        self.sq = {(q, k): vec() for q in range(3) for k in range(q + 1)}

    def frames(self, spark):
        make = spark.createDataFrame
        questions = make([(q, v) for q, v in self.q.items()], "qid bigint, vec array<double>")
        subs = make([(q, k, v) for (q, k), v in self.sq.items()], "qid bigint, sq_pos int, vec array<double>")
        tops = make([(t, d, self.top_vec.get(t)) for t, d in self.doc.items()], "node bigint, doc bigint, vec array<double>")
        low = make([(n, self.parent[n], v) for n, v in self.low.items()], "node bigint, top bigint, vec array<double>")
        links = make(self.links, "top bigint, dst bigint")
        return questions, subs, tops, low, links

    def seed(self, q, beam):
        hits = sorted(self.low, key=lambda n: (-dot(self.q[q], self.low[n]), n))
        return list(dict.fromkeys(self.parent[n] for n in hits))[:beam]

    def units(self, beam, hop):
        pairs = set()
        for a in beam:
            targets = {d for t, d in self.links if t == a}
            for b, d in self.doc.items():
                if hop == "1_hop" and (b != a and d == self.doc[a] or d in targets) or hop == "0_hop" and b in beam and b != a and (d == self.doc[a] or d in targets):
                    pairs.add((min(a, b), max(a, b)))
        met = {n for p in pairs for n in p}
        return [(a, None if a == b else b) for a, b in pairs] + [(n, None) for n in beam if n not in met]

    def subs(self, q):
        return [v for (i, _), v in sorted(self.sq.items()) if i == q] or [self.q[q]]

    def vector(self, q, node):
        mine = [self.low[n] for n, p in self.parent.items() if p == node]
        return [max((dot(s, v) for v in mine), default=0.0) for s in self.subs(q)]

    def ranked(self, q, beam, hop, k):
        best = {}
        for a, b in self.units(beam, hop):
            va = self.vector(q, a)
            sa = sum(va)
            if b is None:
                unit, score = (a, None), sa
            else:
                vb = self.vector(q, b)
                sb, edge = sum(vb), sum(map(max, va, vb))
                unit, score = ((a if sa >= sb else b, None), max(sa, sb)) if max(sa, sb) >= edge else ((a, b), edge)
            best[unit] = score
        out = sorted(best.items(), key=lambda x: (-x[1], x[0][0], x[0][1] is not None, x[0][1] or 0))[:k]
        near = lambda n: dot(self.q[q], self.top_vec[n]) if n in self.top_vec else 0.0
        return [((b, a) if b is not None and near(b) > near(a) else (a, b), s) for (a, b), s in out]


def got(df, q):
    return [((r.node_a, r.node_b), r.score) for r in df.where(f"qid = {q}").orderBy("rank").collect()]


@pytest.mark.parametrize("hop", ["1_hop", "0_hop"])
def test_late_interaction(spark, hop):
    p = Plain()
    out = R.late_interaction(*p.frames(spark), beam=4, k=6, hop=hop).cache()
    for q in p.q:
        assert got(out, q) == p.ranked(q, p.seed(q, 4), hop, 6)


def test_iterations(spark):
    p = Plain(8)
    frames = p.frames(spark)
    out = R.iterative_late_interaction(*frames, beam=3, k=5, iterations=2).cache()
    for q in p.q:
        first = p.ranked(q, p.seed(q, 3), "1_hop", 5)
        beam = list(dict.fromkeys(n for (a, b), _ in first for n in (a, b) if n is not None))[:3]
        assert got(out, q) == p.ranked(q, beam, "1_hop", 5)
    once = R.iterative_late_interaction(*frames, beam=3, k=5, iterations=1)
    assert sorted(map(str, once.collect())) == sorted(map(str, R.late_interaction(*frames, beam=3, k=5).collect()))
    with pytest.raises(ValueError):
        R.iterative_late_interaction(*frames, iterations=0)


def test_topdown(spark):
    p = Plain(5)
    q, _, tops, low, _ = p.frames(spark)
    out = R.topdown(q, tops, low, 5, 3).cache()
    for i in p.q:
        beam = sorted(p.top_vec, key=lambda t: (-dot(p.q[i], p.top_vec[t]), t))[:5]
        best = []
        for t in beam:
            mine = sorted(((-dot(p.q[i], p.low[n]), n) for n, x in p.parent.items() if x == t))
            best.append((mine[0][1], -mine[0][0]) if mine else (t, 0.0))
        want = sorted(best, key=lambda x: (-x[1], x[0]))[:3]
        assert [(r.node, r.score) for r in out.where(f"qid = {i}").orderBy("rank").collect()] == want
    none = R.topdown(q, tops, low.limit(0), 2, 2).where("qid = 0").orderBy("rank").collect()
    beam = sorted(p.top_vec, key=lambda t: (-dot(p.q[0], p.top_vec[t]), t))[:2]
    assert [(r.node, r.score) for r in none] == [(t, dot(p.q[0], p.top_vec[t])) for t in beam]


def test_knn_levels_ties_and_sizes(spark, monkeypatch):
    p = Plain()
    q, _, tops, low, _ = p.frames(spark)
    assert R.single_knn(q, tops, low, "both", 1000).count() == len(p.q) * (len(p.low) + len(p.top_vec))
    with pytest.raises(ValueError):
        R.single_knn(q, tops, low, "middle", 1)
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(50)], "node bigint, vec array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], "qid bigint, vec array<double>")
    monkeypatch.setattr(K, "QUESTIONS_PER_BLOCK", 1)
    found = K.knn(asked, same, 3).orderBy("qid", "rank").collect()
    assert [(r.qid, r.node, r.rank) for r in found] == [(i, k, k + 1) for i in (1, 2) for k in range(3)]
    monkeypatch.setattr(K, "LARGE", 0)
    monkeypatch.setattr(K, "SHARE", 2)
    again = K.knn(asked, same.repartition(5), 3).orderBy("qid", "rank").collect()
    assert [r[:] for r in again] == [r[:] for r in found]
    for size in (7, 50, 65536):  # of blocks of vectors
        monkeypatch.setattr(K, "VECTORS_PER_BLOCK", size)
        assert [r[:] for r in K.knn(asked, same, 3).orderBy("qid", "rank").collect()] == [r[:] for r in found]
    rng = np.random.default_rng(4)
    many = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(40)], "qid bigint, vec array<double>")
    there = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(60)] + [(60, None)], "node bigint, vec array<double>")
    monkeypatch.setattr(K, "VECTORS_PER_BLOCK", 20)
    plan = K.knn(many, there, 5)
    want = [(q.qid, n, r + 1) for q in many.collect() for r, (_, n) in enumerate(sorted((-dot(q.vec, v.vec), v.node) for v in there.collect() if v.vec)[:5])]
    assert [(r.qid, r.node, r.rank) for r in plan.orderBy("qid", "rank").collect()] == sorted(want, key=lambda t: (t[0], t[2]))
    longer = K.knn(many.union(many.selectExpr("qid + 40", "vec")), there, 5)
    assert len(longer._jdf.queryExecution().optimizedPlan().toString()) < 1.4 * len(plan._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(K, "QUESTIONS_PER_BLOCK", 1)
    pairs = same.selectExpr("struct(cast(50 - node as string) as a, node as b) as node", "vec")
    assert [r.node.a for r in K.knn(asked, pairs, 3).where("qid = 1").orderBy("rank").collect()] == ["1", "10", "11"]
    assert K.knn(asked.limit(0), same, 3).count() == 0 and K.knn(asked, same.limit(0), 3).count() == 0


@pytest.mark.parametrize("k", [1, 3, 40])
def test_search_keeps_the_best_of_many_chunks(k):
    rng = np.random.default_rng(k)
    q, x = rng.integers(-2, 3, (7, 4)).astype(float), rng.integers(-2, 3, (9000, 4)).astype(float)
    nodes = rng.permutation(9000)
    batches = [pa.RecordBatch.from_arrays([pa.array(nodes[a : a + 3000]), pa.array(x[a : a + 3000].tolist())], names=["node", "vec"]) for a in range(0, 9000, 3000)]
    (i, s, found), = K._search(q, np.full(7, -np.inf), batches, k)
    for n in range(7):
        want = sorted(zip(-(x @ q[n]), nodes, strict=True))[:k]
        assert [(-a, b) for a, b in zip(s[i == n], found.to_numpy()[i == n], strict=True)] == want


def test_paths(spark):
    p = Plain(9)
    q, subs, tops, low, links = p.frames(spark)
    doc = tops.selectExpr("node as t", "doc")
    near = G.low_neighbours(low.join(doc, low.top == doc.t).select("node", "top", "doc"), links)
    want_near = {(a, b) for a, b in itertools.product(p.low, p.low) if p.doc[p.parent[a]] == p.doc[p.parent[b]] and a != b or (p.parent[a], p.doc[p.parent[b]]) in p.links}
    assert {(r.node, r.near) for r in near.collect()} == want_near
    out = R.beam_paths(q, subs, low, near, 3).collect()
    for i in p.q:
        vs = p.subs(i)
        paths = sorted((([n], dot(vs[0], v)) for n, v in p.low.items()), key=lambda x: (-x[1], x[0]))[:3]
        for v in vs[1:]:
            longer = [([*path, b], s + dot(v, p.low[b])) for path, s in paths for a, b in want_near if a == path[-1]]
            paths = sorted(longer, key=lambda x: (-x[1], x[0]))[:3] or paths
        assert [(r.path, r.score) for r in sorted((r for r in out if r.qid == i), key=lambda r: r.rank)] == paths


def test_retrieve_and_names(spark):
    p = Plain()
    frames = p.frames(spark)
    assert R.retrieve(*frames, mode="single_knn", k=2, level="low").count() == 8
    assert R.retrieve(*frames, mode="single_topdown", k=2, beam=3).count() == 8
    with pytest.raises(ValueError, match="known are"):
        R.retrieve(*frames, mode="guess")
    assert R.run_name("m", "late_interaction", 10, 5) == "m_late_interaction_k10_bw5_1_hop"


def test_search_holds_few_pairs_at_once(monkeypatch):
    """Of each tile only pairs that may be among the best are kept and sorted, with the scores of dot(), equal ones and odd numbers too."""
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (5000, 16)).astype(np.float64) / 7
    x[1000:1300] = x[:300]
    q = x[rng.integers(0, 5000, 300)].copy()
    nodes = rng.permutation(5000)
    sizes = []
    inner = K._best
    monkeypatch.setattr(K, "_best", lambda i, s, n, k: sizes.append(len(i)) or inner(i, s, n, k))
    for odd in (False, True):
        if odd:
            x[7, 3], x[8, 2] = np.inf, np.nan
        batch = pa.RecordBatch.from_arrays([pa.array(nodes), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 16)], names=["node", "vec"])
        ((i, s, found),) = K._search(q, np.full(len(q), -np.inf), [batch], 5)
        if not odd:
            assert max(sizes) < 100_000  # all pairs of a batch would be 614,400
        with np.errstate(invalid="ignore"):
            all_scores = K.ordered_products(q, x)
        for row in range(0, 300, 37):
            held = np.flatnonzero(all_scores[row] >= -np.inf)
            want = held[np.lexsort((nodes[held], -all_scores[row][held]))][:5]
            assert found.to_numpy()[i == row].tolist() == nodes[want].tolist() and s[i == row].tolist() == all_scores[row][want].tolist()


def test_seed_beam_searches_further_only_where_it_must(spark, monkeypatch):
    """A question whose first hits are all below one upper component is searched for all hits; the beam is the same."""
    low = [(k, 0 if k < 70 else k - 69, [100.0 - k, 1.0]) for k in range(75)] + [(100 + k, 200 + k, [0.0, 50.0 - k]) for k in range(20)]
    low = spark.createDataFrame(low, "node bigint, top bigint, vec array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid bigint, vec array<double>")
    ks = []
    inner = R.knn
    monkeypatch.setattr(R, "knn", lambda q, c, k: ks.append((q.count(), k)) or inner(q, c, k))
    got = {(r.qid, r.node, r["rank"]) for r in R.seed_beam(asked, low, 3).collect()}
    assert ks == [(2, 48), (1, 2048)]
    assert got == {(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 200, 1), (2, 201, 2), (2, 202, 3)}
    assert {(r.qid, r.node) for r in R.seed_beam(asked, low, 3, 60).collect()} == {(1, 0), (2, 200), (2, 201), (2, 202)}
