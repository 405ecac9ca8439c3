"""Properties of the pure functions on generated inputs."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.functions import llm_text
from graphloom.operators import serialize as S
from graphloom.operators import text_eval as T
from graphloom.sources import html as H

WORDS = st.text("ab c\n", max_size=8)
INLINE = st.recursive(
    WORDS.map(lambda t: t),
    lambda kids: st.tuples(st.sampled_from(["a", "b", "i", "sup", "span"]), st.lists(kids, max_size=3)).map(lambda x: f'<{x[0]} href="/w">' + "".join(x[1]) + f"</{x[0]}>"),
    max_leaves=12,
)


@settings(max_examples=100, deadline=None)
@given(st.lists(INLINE, max_size=4), st.lists(INLINE, max_size=4))
def test_offsets_of_links_are_those_of_their_text(a, b):
    page = "<article><p>" + "".join(a) + "</p><ul>" + "".join(f"<li>{x}</li>" for x in b) + "</ul></article>"
    for block in H.blocks("u", page):
        for link in block["links"]:
            assert block["text"][link["start"] : link["end"]] == link["text"]


@settings(max_examples=100, deadline=None)
@given(st.text("<>/apulidv=\"' \n!-&;", max_size=60))
def test_any_markup_parses(html):
    cids = [b["cid"] for b in H.blocks("https://en.wikipedia.org/wiki/x", html) if b["kind"] not in ("title", "heading")]
    assert len(cids) == len(set(cids))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=12), st.integers(1, 40), st.data())
def test_chunks_hold_each_row_once_and_keep_to_the_size(lengths, size, data):
    rows = [f"r{k}_ " + "w " * n for k, n in enumerate(lengths)]
    images = [[]]
    lines = []
    for _ in rows:
        new = data.draw(st.integers(0, 1))
        images.append(list(range(len(lines), len(lines) + new)))
        lines += ["<I> x "] * new
    made = S.chunked("h ", rows, images, lines, size)
    at = [[k for k in range(len(rows)) if f"r{k}_" in t] for t, _ in made]
    assert [k for part in at for k in part] == list(range(len(rows)))
    for part, (text, shown) in zip(at, made, strict=True):
        assert len(part) < 2 or sum(len(rows[k].split()) + 2 * len(images[k + 1]) for k in part) + 1 <= size
        assert shown == [i for k in part for i in images[k + 1]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab 1.,-%", max_size=8), max_size=4), st.lists(st.text("ab 1.,-%", max_size=8), max_size=4))
def test_scores_lie_between_0_and_1_and_match_themselves(a, b):
    assert 0 <= T.list_f1(a, b) <= 1 and T.list_em(a, a) == 1.0
    assert T.list_em(a, a[::-1]) == 1.0 and T.list_f1(a, a[::-1]) == T.list_f1(a, a)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.text("ab", min_size=1, max_size=2), st.integers() | st.lists(st.booleans(), max_size=2), max_size=3), max_size=4), st.text("xy []", max_size=5))
def test_objects_are_found_among_other_text(objects, between):
    said = [json.dumps(o) for o in objects]
    assert llm_text.json_objects(between.join(["", *said, '{"cut": 1'])) == said
