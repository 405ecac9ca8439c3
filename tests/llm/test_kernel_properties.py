"""Properties of the kernels on generated inputs."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import langid, pieces, secrets, substrings, words

TEXT = st.text(st.sampled_from("ab \t\n\x0b\x1f é中😀  ."), max_size=60)


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_words_are_runs_of_other_than_ascii_space(text):
    data = text.encode()
    starts, ends, hashes = words.Hasher().words(data)
    found = [data[a:b].decode() for a, b in zip(starts, ends, strict=True)]
    assert found == re.findall(r"[^\x20\x09-\x0D]+", text)
    for x, hx in zip(found, hashes.tolist(), strict=True):
        assert all((x == y) == (hx == hy) for y, hy in zip(found, hashes.tolist(), strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", max_size=12), min_size=1, max_size=4), st.text("abcd", max_size=15), st.integers(1, 3))
def test_matching_statistics(shard, text, least):
    automaton = substrings.SuffixAutomaton()
    for s in shard:
        automaton.add(s)
    got = automaton.close().matches(text, least)
    occurs = lambda x: sum(s[i : i + len(x)] == x for s in shard for i in range(len(s)))
    for k in range(len(text)):
        want = max((n for n in range(1, k + 2) if occurs(text[k + 1 - n : k + 1]) >= least), default=0)
        assert got[k] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=120))
def test_anchors_put_each_window_into_one_segment(tokens):
    hasher = words.Hasher()
    hashes = hasher.words(" ".join(tokens).encode())[2]
    start, windows, anchor, _ = substrings.anchors(hashes, hasher)
    n = max(0, len(tokens) - substrings.WINDOW + 1)
    assert [s + k for s, w in zip(start.tolist(), windows.tolist(), strict=True) for k in range(w)] == list(range(n))
    by_window = np.repeat(anchor, windows)
    for i in range(n):
        for j in range(i):
            if tokens[i : i + substrings.WINDOW] == tokens[j : j + substrings.WINDOW]:
                assert by_window[i] == by_window[j]


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_pieces_round_trip(model, texts):
    for text, ids in zip(texts, pieces.Encoder(model).encode([t.encode() for t in texts]), strict=True):
        assert model.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text("tokensecret=:\"' +abcdef0123456789\n", max_size=80))
def test_redacted_text_has_no_base_secret(text):
    spans = secrets.scan(text)
    assert all(0 <= a <= v <= b <= len(text) for a, _, b, v in [(s[0], s[1], s[2], s[3]) for s in spans])
    assert not [s for s in secrets.scan(secrets.redact(text, spans)) if s[1] < 3]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1200))
def test_windows_hold_all_bytes(data):
    assert langid.windows_of(data)[:, : langid.WINDOW].tobytes()[: len(data)] == data
