import hashlib
import random
from collections import Counter

import pytest

from graphloom.llm import substrings as S


def brute(rows):
    """(n_words, kept) of each text in order."""
    words = [(t or "").encode().split() for t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((len(w), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_automaton():
    rng = random.Random(2)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 5))]
        copies = [rng.randrange(1, 3) for _ in texts]
        a = S.SuffixAutomaton()
        for t, c in zip(texts, copies, strict=True):
            a.add(t, c)
        a.close()
        counts = Counter()
        for t, c in zip(texts, copies, strict=True):
            for i in range(len(t)):
                for j in range(i + 1, len(t) + 1):
                    counts[t[i:j]] += c
        for query in [*texts, "abba", "aabbaabb", "c", "acb"]:
            for least in (1, 2, 3):
                want = [max((n for n in range(i + 2) if n == 0 or counts[query[i + 1 - n : i + 1]] >= least), default=0) for i in range(len(query))]
                assert a.matches(query, least) == want


def planted(seed=4, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "the", "the"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [make(k) for k in (34, 35, 36, 60, 120, 400)]
    texts = []
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += make(rng.randrange(0, 80))
            if rng.random() < 0.6:
                p = list(rng.choice(passages))
                if rng.random() < 0.4:
                    p[rng.randrange(len(p))] = f"edit{k}"
                parts += p
        texts.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    texts += [texts[0], "same " * 100, "same " * 34, "once " * 35, " ".join(make(70) * 2), "", None, None, "x"]
    return texts


@pytest.mark.parametrize("full", [1000, 5, 1])
def test_dedup(spark, monkeypatch, full):
    monkeypatch.setattr(S, "FULL", full)
    texts = planted()
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, kept string").repartition(5)
    got = {r.doc_id: r for r in S.dedup(df).collect()}
    for k, (n, kept) in enumerate(brute(texts)):
        assert (got[k].n_words, got[k].kept) == (n, kept), k
        assert got[k].n_removed == n - len(kept.split())


def test_repeated_rows_and_nulls(spark):
    long = " ".join(f"v{k}" for k in range(50))
    rows = [(1, long), (1, long), (None, "z " + long), (None, None), (2, "other " + " ".join(f"u{k}" for k in range(50)))]
    got = sorted((r.doc_id or 0, r.n_words, r.kept) for r in S.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [g[:2] for g in got] == [(0, 0), (0, 51), (1, 50), (1, 50), (2, 51)]
    assert [g[2] for g in got][1:4] == ["z", "", ""] and got[4][2].startswith("other u0")
    assert S.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_reference(spark):
    reference = spark.createDataFrame([("a b c d e",), ("x y",), (None,)], "text string")
    docs = spark.createDataFrame([(1, "q a b c r"), (2, "b c d e b c"), (3, "x y a b"), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.kept for r in S.remove_reference(docs, reference, window=3).collect()}
    assert got == {1: "q r", 2: "b c", 3: "x y a b", 4: ""}
    for shard_words, shards in ((4, 1), (3, 2), (1, 1)):  # as many rounds as it takes
        small = S.remove_reference(docs, reference, window=3, shard_words=shard_words, shards=shards)
        assert {r.doc_id: r.kept for r in small.collect()} == got
    nothing = reference.where("false")
    assert {r.doc_id: r.n_removed for r in S.remove_reference(docs, nothing, window=3).collect()} == dict.fromkeys(range(1, 5), 0)
    assert S.remove_reference(docs.where("false"), reference, window=3).count() == 0


def test_reference_odd_rows(spark):
    rows = [(None, "a b c", 1), (5, "", 2), (5, None, 3), (7, "a b c d", 4), (7, "a b c d", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, gone int")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed, r.kept) for r in S.remove_reference(docs, spark.createDataFrame([("b c d",), ("b c d",)], "text string"), window=3).collect())
    assert got == [(0, 3, 0, "a b c"), (5, 0, 0, ""), (5, 0, 0, ""), (7, 4, 3, "a"), (7, 4, 3, "a")]


@pytest.mark.parametrize("run", [7, 1])
def test_equal_windows_have_equal_keys(run):
    """Every window of a segment is in one piece, and all places of a window have one key."""
    import pyarrow as pa

    rng = random.Random(run)
    passage = [f"p{k}" for k in range(90)]
    keys: dict[tuple, set] = {}
    for k in range(40):
        a = rng.randrange(0, 50)
        words = [*(f"l{k}.{i}" for i in range(rng.randrange(0, 40))), *passage[a : a + rng.randrange(20, 90)], *(f"r{k}.{i}" for i in range(rng.randrange(0, 40)))]
        hasher = S.Hasher()
        start, windows, anchor, w = S.anchors(hasher.words(" ".join(words).encode())[2], hasher)
        for s, n, an in zip(start.tolist(), windows.tolist(), anchor.tolist(), strict=True):
            data = " ".join(words[s : s + n + 34]).encode()
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([1]), pa.array([data])], names=["a", "w", "copies", "words"])
            seen = []
            for out in S._cut(run)([batch]):
                for r in out.to_pylist():
                    piece = r["words"].split()
                    assert len(piece) - 34 <= run
                    for i in range(len(piece) - 34):
                        seen.append(r["lo"] + i)
                        keys.setdefault(tuple(piece[i : i + 35]), set()).add((an, r["a"]))
                        assert piece[i : i + 35] == data.split()[r["lo"] + i : r["lo"] + i + 35]
            assert sorted(seen) == list(range(n))
    assert len(keys) > 500 and all(len(x) == 1 for x in keys.values())


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in S.op5_substrings(spark, data).collect()}
    removed = 0
    for r, (n, kept) in zip(rows, brute([r.text for r in rows]), strict=True):
        assert (got[r.doc_id].n_words, got[r.doc_id].kept_sha256) == (n, hashlib.sha256(kept.encode()).hexdigest())
        removed += got[r.doc_id].n_removed
    assert removed
