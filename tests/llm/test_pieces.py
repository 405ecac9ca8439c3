import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from graphloom.llm import pieces as P

TEXTS = ["", " ", "  ", "Hello  wörld\n\t中文 x", "a", "\x00\x7f", "▁ a▁b", "   lead", "trail   ", "é \U0001f600\U0001f600 ok", "x" * 3000, "\n\n\n", "né\r\nà " * 50, "ſtrange — “quotes”… 1234.5678", " " * 40 + "z"]


@pytest.fixture(scope="module")
def pieces():
    with open(P.MODEL, "rb") as f:
        return P.Pieces(f.read())


def vocabulary(p):
    own = {}
    for k in range(p.size):
        own[bytes(p.bytes[p.starts[k] : p.starts[k] + p.lengths[k]])] = k
    for b, k in enumerate(p.byte_ids.tolist()):
        if own.get(bytes([b])) == k:
            del own[bytes([b])]
    return own


def brute(p, text, own=None):
    """Viterbi over all prefixes, as plain as can be."""
    if not text:
        return []
    data = b" " + text.encode()
    own = own or vocabulary(p)
    longest = max(map(len, own))
    best = [(-1e300, 0, [])] * (len(data) + 1)
    best[0] = (0.0, 0, [])
    for i in range(len(data)):
        if data[i] & 0xC0 == 0x80:
            continue
        width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        options = [(j, [own[data[i:j]]], p.scores[own[data[i:j]]]) for j in range(i + 1, min(len(data), i + longest) + 1) if data[i:j] in own]
        if not any(j == i + width for j, *_ in options):
            options.append((i + width, [int(p.byte_ids[b]) for b in data[i : i + width]], p.scores[p.size]))
        for j, ids, gain in options:
            if best[i][0] + gain > best[j][0]:
                best[j] = (best[i][0] + gain, i, ids)
    out, at = [], len(data)
    while at:
        out = best[at][2] + out
        at = best[at][1]
    return out


def total(p, ids):
    return sum(p.scores[i] for i in ids)


def same(p, got, want):
    """Equal, or another path of the same score: sums of doubles depend on the order of adding."""
    return list(got) == list(want) or abs(total(p, got) - total(p, want)) < 1e-6


def test_viterbi_and_round_trip(pieces):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aeth n\n中é0▁") for _ in range(rng.randrange(200))) for _ in range(60)]
    made = P.Encoder(pieces).encode([t.encode() for t in texts])
    for text, ids in zip(texts, made, strict=True):
        assert pieces.decode(ids) == text.encode()
        if len(text) < 1000:
            assert same(pieces, ids, brute(pieces, text)), text


def test_against_the_library(pieces):
    """The library's own unigram model over the same pieces and scores."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    with open(P.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = P.UNIGRAM
    for k, piece in enumerate(m.pieces):
        if piece.type in (P.NORMAL, P.USER_DEFINED):
            piece.type, piece.score = P.NORMAL, float(pieces.scores[k])
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = [t for t in TEXTS if "▁" not in t and len(t) < 1000] + ["The quick brown fox jumps over 13 lazy dogs.", "Größe und Maß, für naïve Façade"]
    for text, ids in zip(texts, P.Encoder(pieces).encode([t.encode() for t in texts]), strict=True):
        want = lib.encode(text)
        assert list(ids) == want or abs(total(pieces, ids) - total(pieces, want)) < 1e-3, text


def test_small_memory_and_chunks_change_nothing(pieces, monkeypatch):
    texts = [t.encode() for t in TEXTS]
    want = P.Encoder(pieces).encode(texts)
    monkeypatch.setattr(P, "_CHUNK", 3)
    one = P.Encoder(pieces, limit=2)
    got = [one.encode([t])[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_unigram_scores_are_kept():
    def field(number, kind, body):
        return bytes([number << 3 | kind]) + body

    def piece(text, score, kind=1):
        import struct

        body = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    data = piece("<unk>", 0, 2) + piece("▁ab", -5.0) + piece("▁a", -1.0) + piece("b", -2.0) + piece("▁", -9.0) + field(2, 2, bytes([2, 3 << 3, 1]))
    p = P.Pieces(data)
    assert p.scores[1] == -5.0 and list(P.Encoder(p).encode([b"ab"])[0]) == [2, 3]


def test_operator(spark, pieces):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "dup", "x"), (None, "dup", "x")], "doc_id bigint, text string, pieces string")
    made = P.encode(docs)
    got = {r.doc_id: r for r in made.collect()}
    assert made.count() == len(TEXTS) + 3 and got[99].pieces == [] and got[0].n_pieces == 0
    texts = {r.doc_id: r.text for r in P.decode(made).collect()}
    assert all(texts[k] == t for k, t in enumerate(TEXTS)) and texts[None] == "dup"
    assert P.encode(docs.limit(0)).count() == 0


def test_query(spark, data, pieces):
    got = {r.doc_id: r for r in P.op7_pieces(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got.values())
    for r in rows:
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    own = vocabulary(pieces)
    ids = {r.doc_id: r.pieces for r in P.encode(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    for r in rows:
        mine = ids[r.doc_id]
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(mine, "<i4").tobytes()).hexdigest() and got[r.doc_id].n_pieces == len(mine)
        want = brute(pieces, r.text, own)
        assert mine == want or abs(total(pieces, mine) - total(pieces, want)) < 1e-6 * max(1.0, abs(total(pieces, want))), r.doc_id
