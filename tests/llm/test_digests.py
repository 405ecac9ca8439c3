import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import digests as D


def level(window):
    return D._ALL + sum(int(D._PART[c]) for c in Counter(window).values())


def brute_ranks(datas):
    counts = Counter(level(d[i : i + D.SPAN]) for d in datas for i in range(len(d) - D.SPAN + 1))
    rank = []
    for at in range(D._ALL + 1):
        near = sum(counts[k] for k in range(at - D.NEAR, at + D.NEAR + 1))
        rank.append(int(D._NONE) if at / (64 * D.SPAN) < D.LEAST else round(math.log2(1 + near) * 10_000))
    return np.array(rank)


def brute_selected(data, ranks):
    n = len(data) - D.SPAN + 1
    if n < 1:
        return []
    rank = []
    for i in range(n):
        rank.append(int(ranks[level(data[i : i + D.SPAN])]))
    wins = Counter()
    for i in range(1 - D.SPAN, n):
        options = [(rank[k], k) for k in range(max(0, i), min(n, i + D.SPAN))]
        best = min(options)
        if best[0] < D._NONE:
            wins[best[1]] += 1
    return sorted(k for k, w in wins.items() if w >= D.POPULAR)


def texts():
    rng = random.Random(5)
    words = ["the", "and", "of", "größe", "nature", "x1", "\n", "zebra", "lorem"]
    return ["", "a", "b" * 63, "c" * 64, "d" * 500, *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(12)]]


def test_entropy():
    data = texts()[-1].encode()
    got = D.entropies(np.frombuffer(data, np.uint8)) / (64 * D.SPAN)
    for i in (0, 1, 17, len(got) - 1):
        counts = Counter(data[i : i + D.SPAN]).values()
        want = -sum(c / D.SPAN * math.log2(c / D.SPAN) for c in counts)
        assert abs(got[i] - want) < 0.01


def test_selection_in_batches_equals_brute_force():
    datas = [t.encode() for t in texts()]
    rank = brute_ranks(datas)
    for data, got in zip(datas, D.selected(datas, rank), strict=True):
        assert got.tolist() == brute_selected(data, rank)
    for data, got in zip(datas, D.digests(datas, rank), strict=True):
        assert np.array_equal(got, D.digests([data], rank)[0])


def test_likeness():
    datas = [t.encode() for t in texts()]
    rank = brute_ranks(datas)
    chains = D.digests(datas, rank)
    for c in chains:
        assert D.likeness(c, c) == 1.0
    for a in chains:
        for b in chains:
            assert 0.0 <= D.likeness(a, b) <= 1.0
    long = " ".join(texts()[5:])
    near = long[:1000] + " inserted words " + long[1000:]
    a, b, c = D.digests([long.encode(), near.encode(), bytes(random.Random(1).choices(b"etaoin shrdlu", k=3000))], rank)
    assert len(a) > 1 and D.likeness(a, b) > 0.8 > 0.3 > D.likeness(a, c)


def check(rows, got, rank=None):
    """rows in the order that next documents are taken in."""
    assert len(rows) == len(got)
    rank = brute_ranks([(t or "").encode() for _, t in rows]) if rank is None else rank
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for (doc, text), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, other = text or "", other or ""
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        sha = hashlib.sha256(new.encode()).hexdigest()
        r = next(x for x in by[doc] if x.edited_sha256 == sha and x.n_chars == len(text))
        by[doc].remove(r)
        own, changed, following = D.digests([text.encode(), new.encode(), other.encode()], rank)
        assert (r.fingerprint, r.edited_fingerprint) == (D.written(own), D.written(changed))
        assert (r.near_edited, r.near_next) == (D.likeness(own, changed), D.likeness(own, following))


def test_edges(spark):
    rows = [(5, "a" * 99 + "é"), (3, None), (2, ""), (0, "x y z"), (-4, "negative " * 30)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, bucket string")
    check(rows, D.fingerprint_edits(df).collect())
    check(rows[:1], D.fingerprint_edits(df.where("doc_id = 5")).collect())
    assert D.fingerprint_edits(df.limit(0)).count() == 0
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, "n1", ""), (None, "n1", ""), (None, "n2", "")], df.schema))
    assert D.fingerprint_edits(twice).count() == 13
    one = spark.createDataFrame([(None, "n1", ""), (7, "seven", "")], df.schema)
    check([(7, "seven"), (None, "n1")], D.fingerprint_edits(one).collect())


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rank = D.measured(spark.read.parquet(f"{data}/documents.parquet"))
    check(sorted(rows, reverse=True), D.op4_fingerprints(spark, data).collect(), rank)


def test_ranks_are_those_of_all_windows(spark):
    made = texts()
    df = spark.createDataFrame([(t,) for t in [*made, None]], "text string").repartition(3)
    assert np.array_equal(D.measured(df), brute_ranks([t.encode() for t in made]))
    assert (D.measured(df.limit(0)) == brute_ranks([])).all()


def test_rows_without_id_are_spread(spark):
    rows = [(None, f"text {k} " * 20) for k in range(300)] + [(k, "x y z" * k) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = D.with_next(df)
    assert made.where("doc_id is null and shown").groupBy("bucket").count().count() > 2
    got = D.fingerprint_edits(df).collect()
    assert len(got) == len(rows)
    hashes = {r.text: r.t for r in df.select("text", F.xxhash64("text").alias("t")).collect()}
    order = [*sorted((r for r in rows if r[0] is not None), reverse=True), *sorted((r for r in rows if r[0] is None), key=lambda r: hashes[r[1]])]
    check(order, got)
    with pytest.raises(TypeError):
        D.fingerprint_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
