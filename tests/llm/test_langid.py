import zlib

import numpy as np

from graphloom.llm import langid as L


def test_gradients():
    rng = np.random.default_rng(0)
    net = L.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(97, 105, (4, L.WINDOW + L.REACH)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y)
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, step = net.p[name][at], 1e-6
        net.p[name][at] = old + step
        up = net.gradients(x, y)[0]
        net.p[name][at] = old - step
        down = net.gradients(x, y)[0]
        net.p[name][at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), name


def test_tables_equal_the_network():
    net = L.Network(4)
    x = np.random.default_rng(1).integers(0, 256, (70, L.WINDOW + L.REACH)).astype(np.uint8)
    got = L.Tables(net.p).log_probs(x)
    e = net.p["emb"][x]
    h = []
    for w in L.WIDTHS:
        c = np.concatenate([e[:, k : k + L.WINDOW] for k in range(w)], axis=2)
        h.append((c @ net.p[f"w{w}"] + net.p[f"b{w}"]).max(axis=1))
    logit = np.maximum(np.concatenate(h, axis=1), 0) @ net.p["out"] + net.p["bias"]
    want = logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))
    assert np.abs(got - want).max() < 1e-4


def slow(p, languages, text):
    """Language and score by the definitions, window by window."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = text.encode()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    total = np.zeros(len(languages))
    for at in range(0, len(data), L.WINDOW):
        x = np.frombuffer(data[at : at + L.WINDOW + L.REACH].ljust(L.WINDOW + L.REACH, b"\0"), np.uint8)
        e = p["emb"][x]
        h = [np.stack([e[k : k + w].ravel() @ p[f"w{w}"] for k in range(L.WINDOW)]).max(axis=0) + p[f"b{w}"] for w in L.WIDTHS]
        logit = np.maximum(np.concatenate(h), 0) @ p["out"] + p["bias"]
        total += (logit - logit.max() - np.log(np.exp(logit - logit.max()).sum())) * len(data[at : at + L.WINDOW])
    prob = np.exp(total / len(data) - (total / len(data)).max())
    prob /= prob.sum()
    return languages[int(prob.argmax())], float(prob.max())


def test_result_against_a_slow_forward_pass(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tables, languages = L.fit(docs, steps=200)
    got = {r.doc_id: r for r in L.identify(docs, model=(tables, languages)).select("doc.doc_id", "lang_pred", "score").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        lang, score = slow(tables.p, languages, r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-3


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 1000):
        data = bytes(range(1, 256)) * 4
        w = L.windows_of(data[:n])
        assert w[:, : L.WINDOW].tobytes().rstrip(b"\0") == data[:n].rstrip(b"\0")


def test_held_out_accuracy_and_fold(spark, data_more):
    got = {r.doc_id: r for r in L.op8_langid(spark, data_more).collect()}
    rows = spark.read.parquet(f"{data_more}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    right = total = 0
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if got[r.doc_id].held_out and L.has_letter(r.text):
            total += 1
            right += got[r.doc_id].lang_pred == r.lang
    assert right / total >= 0.97


def test_edges(spark):
    rows = [(k, t, lang, "x") for k, (t, lang) in enumerate([("the thing and that " * 20, "en"), ("und der die das ist ß " * 20, "de")] * 12)]
    rows += [(100, None, "en", "x"), (101, "", "de", "x"), (102, "123 !!", None, "x"), (103, "the and " * 5, None, "x"), (103, "the and " * 5, None, "x"), (None, "der die ß", "de", "x"), (104, "a" * 300000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    made = L.identify(docs, model=L.fit(docs, steps=60)).select("doc.doc_id", "lang_pred", "score").collect()
    got = {r.doc_id: r for r in made}
    assert len(made) == len(rows)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (100, 101, 102))
    assert got[103].lang_pred == "en" and 0 <= got[103].score <= 1 and got[104].lang_pred in ("en", "de")
    bare = L.identify(docs.where("lang is null"))
    assert {r.lang_pred for r in bare.collect()} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0
