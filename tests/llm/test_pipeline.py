import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import slow_lexer  # noqa: E402
from test_langid import slow as slow_language  # noqa: E402
from test_resemblance import brute as alike  # noqa: E402
from test_secrets import brute as base_spans  # noqa: E402

from graphloom.llm import langid, mixing, pieces, secrets  # noqa: E402


def u(seed, *parts):
    return int(hashlib.md5(":".join([str(seed), *map(str, parts)]).encode()).hexdigest()[:12], 16) / 2**48


def redacted(text):
    """The text with each character of a secret marked, and each run of these replaced."""
    spans = [(m[0], m[1], m[2]) for m in base_spans(text)]
    gone = [(a, b) for a, b in slow_lexer.lexed(text) if not any(x <= a and b <= y for x, _, y in spans)]
    for a, kind, b in spans:
        inside = re.match(secrets._ASSIGN.pattern, text[a:b], re.I | re.A) if kind == 0 else None
        gone.append((a + inside.start(2) if inside else a, b))
    out, at, end = "", 0, -1
    for a, b in sorted(gone):
        if a > end:
            out += text[at:a] + "[SECRET]"
        end = at = max(end, b)
    return out + text[at:]


def test_each_stage_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    given = docs.collect()

    tables, languages = langid.fit(docs)
    judged = {r.doc_id: slow_language(tables.p, languages, r.text) for r in given}
    kept = stages["language_id"](spark, docs, data)
    assert kept.columns == names
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in rows} == {r.doc_id for r in given if judged[r.doc_id][0] != "und" and judged[r.doc_id][1] >= corpus_pipeline.LEAST_SCORE}
    assert len(rows) >= 0.97 * len(given)

    kept = stages["near_dedup"](spark, spark.createDataFrame(rows, docs.schema), data)
    after = sorted(kept.collect(), key=lambda r: r.doc_id)
    assert kept.columns == names and [r.doc_id for r in after] == alike([(r.doc_id, r.text) for r in rows]) and len(after) < len(rows)
    assert {tuple(r) for r in after} <= {tuple(r) for r in rows}

    kept = stages["secret_scan"](spark, spark.createDataFrame(after, docs.schema), data)
    clean = sorted(kept.collect(), key=lambda r: r.doc_id)
    assert kept.columns == names and len(clean) == len(after)
    for a, b in zip(after, clean, strict=True):
        assert b.text == redacted(a.text) and b.n_chars == len(b.text)
        assert not [s for s in secrets.scan(b.text) if s[1] < 3]

    kept = stages["source_mix"](spark, spark.createDataFrame(clean, docs.schema), data)
    mixed = kept.collect()
    assert kept.columns == names
    size = Counter()
    for r in clean:
        size[r.source if r.source in mixing.WEIGHTS else None] += max(1, len(r.text))
    want = Counter()
    for r in clean:
        g = r.source if r.source in mixing.WEIGHTS else None
        rate = mixing.WEIGHTS.get(g, mixing.OTHER) / (sum(mixing.WEIGHTS.values()) + mixing.OTHER) * sum(size.values()) / size[g]
        assert rate <= mixing.SHARE
        x, n, p, c = u(mixing.SEED, r.doc_id, hashlib.md5(r.text.encode()).hexdigest(), 0), 0, np.exp(-rate), np.exp(-rate)
        while c <= x:
            n += 1
            p *= rate / n
            c += p
        want[r.doc_id] = n
    assert Counter(r.doc_id for r in mixed) == +want

    last = stages["piece_encoding"](spark, spark.createDataFrame(mixed, docs.schema), data)
    texts = {r.doc_id: r.text for r in pieces.decode(last).collect()}
    assert last.count() == len(mixed) and all(texts[r.doc_id] == r.text for r in mixed)


def test_run_and_odd_rows(spark, data, tmp_path):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "n_pieces", "pieces"] and out.count() > 100
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    base = spark.read.parquet(f"{data}/documents.parquet").limit(20).collect()
    odd = [(1000, None, None, None, None), (1001, "", "en", None, 0), (None, base[0].text, "en", "src0", 5), (1002, base[1].text, None, "src1", 5), (1002, base[1].text, None, "src1", 5)]
    for rows in ([], [tuple(r) for r in base] + odd):
        path = str(tmp_path / str(len(rows)))
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        assert all(r.doc_id not in (1000, 1001) for r in got) and (rows or not got)
