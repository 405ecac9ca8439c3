"""The rule ledger against a plain count, its SQL, and its ablations."""

import re
import sys
from pathlib import Path

import pytest

from graphloom.llm import quality as Q
from graphloom.llm.words import Hasher

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracles  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines),
    }


TEXTS = [
    None, "", " \t\n ", "a", "one two three four five one two three four five", "a a a a a a a a", "x\nx\n x\nx ", "é ß 😀 a#b <c> | & %", "\n\n# t\n- a...\n- b…\n• c\n* d",
    "w " * 20_000, "a b c", "long" * 5000, "1 2 3 4 5 6 7 8 9 10 11 12", "A b c d e f g h i j k", "\r\n x \x0b y \x0c z", "the cat sat on the mat and the cat sat on the mat",
]


@pytest.mark.parametrize("text", [t for t in TEXTS if len(t or "") < 30_000])
def test_measure(text):
    got = dict(zip(Q.MEASURES, Q.measure(text, Hasher()), strict=True))
    want = plain(text)
    assert {k: got[k] for k in want} == want


def frame(spark):
    rows = [(k, t, "clash", 3) for k, t in enumerate(TEXTS)] + [(3, "a", "clash", 3), (None, "a b", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, fail_bits int")


def test_ledger(spark):
    made = Q.ledger(frame(spark)).collect()
    assert len(made) == len(TEXTS) + 2
    for r in made:
        if r.doc_id is not None and len(TEXTS[r.doc_id] or "") < 30_000:
            want = plain(TEXTS[r.doc_id])
            assert {k: r[k] for k in want} == want
            assert bool(r.fail_bits & 1) == (want["n_words"] < 10)
            assert bool(r.fail_bits & 2) == (100 * want["n_repeat_words"] > 20 * want["n_words"])
    long = next(r for r in made if r.doc_id == 9)
    assert long.n_words == long.n_repeat_words == 20_000
    assert Q.ledger(frame(spark).limit(0)).count() == 0


def test_policies_and_ablations(spark):
    ledger = Q.ledger(frame(spark)).cache()
    bits = [r.fail_bits for r in ledger.collect()]
    for policy in Q.POLICIES:
        mask = Q.policy_mask(policy)
        kept = Q.apply_policy(ledger, policy)
        assert kept.where("kept").count() == sum(b & mask == 0 for b in bits)
        for r in Q.ablation(ledger, policy).collect():
            bit = 1 << [n for n, _ in Q.RULES].index(r.rule)
            assert r[1:] == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), len(bits), sum(b & mask == 0 for b in bits))


def test_like_sql(spark, data):
    assert not oracles.differences(Q.op2_quality(spark, data), oracles.connection(data), Q.OP2_SQL)


def test_ablation_like_sql(spark, data):
    assert not oracles.differences(Q.quality_ablation(spark, data), oracles.connection(data), Q.ABLATION_SQL)
