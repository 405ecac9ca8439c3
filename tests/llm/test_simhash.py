"""SimHash against a plain re-implementation."""

import random
import re

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=3):
    """Rows (id, fingerprint): the smallest id that each reaches."""
    out = {}
    ids = [r for r in rows if r[0] is not None]
    for i, fp in ids:
        seen, todo = {fp}, [fp]
        while todo:
            x = todo.pop()
            near = {f for _, f in ids if (x ^ f).bit_count() <= radius} - seen
            seen |= near
            todo += near
        out[i, fp] = min(j for j, f in ids if f in seen)
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a a a a a a", "Straße ÄÖ É x", "nbsp stays one", "x " * 40_000, "a\x1cb c\x85d e", "😀 b c d"])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain(text)


def test_tile_components():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(0b111 << 40), base[:9] ^ np.uint64(0b1111)]))
    got = S.tile_components(x, 3)
    want = components([(k, int(v)) for k, v in enumerate(x)])
    assert got.tolist() == [want[k, int(v)] for k, v in enumerate(x)]


@pytest.mark.parametrize("n", [1, 10_000, 10**7, 10**10])
def test_masks_miss_no_pair(n):
    masks = S.block_masks(n, 3)
    r = random.Random(n)
    for _ in range(300):
        d = sum(1 << b for b in r.sample(range(64), 3))
        assert any(d & m == 0 for m in masks)


def texts(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 6)))
    out = [None, "", "  ", "One two", "one TWO"]
    for _ in range(n):
        words = [word() for _ in range(r.randint(1, 200))]
        out.append(" ".join(words))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = word()
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("group", [16384, 7])
def test_components(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    rows = [(k, t) for k, t in enumerate(texts())] + [(3, "One two"), (None, "one two"), (None, "no such text at all")]
    df = spark.createDataFrame([(t, i, 7, "x") for i, t in rows], "text string, doc_id bigint, fp int, component_id string")
    got = S.simhash_components(df).collect()
    want = components([(i, plain(t)) for i, t in rows])
    mask = (1 << 64) - 1
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fp & mask): r.component_id for r in got if r.doc_id is not None} == want
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted(["3", "None"])


def test_a_dense_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 16)
    r = random.Random(4)
    center = r.getrandbits(63)
    fps = {center ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 4))) for _ in range(150)}
    rows = [(fp, k) for k, fp in enumerate(sorted(fps))]
    from graphloom.llm.components import connected_components

    links = S.near_links(spark.createDataFrame(rows, "fp bigint, node bigint"), 3)
    got = {x.node: x.component for x in connected_components(links, "a", "b").collect()}
    assert {k: got.get(k, k) for _, k in rows} == {k: c for (k, _), c in components([(k, fp) for fp, k in rows]).items()}


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_on_a_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in S.op1_simhash(spark, data).collect()}
    want = components([(d.doc_id, plain(d.text)) for d in docs])
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].fingerprint == f"{plain(d.text):016x}" and got[d.doc_id].component_id == want[d.doc_id, plain(d.text)]
