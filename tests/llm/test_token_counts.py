"""Edit-aware counts against encoding the whole edited text."""

import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from evenkeel.llm import queries, token_counts as t

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPACES = st.sampled_from(["\x1c", "\x85", "\xa0", "　"])


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def apply(text, edits):
    for start, end, new in edits:
        start = min(max(0, start), len(text))
        end = min(max(start, end), len(text))
        text = text[:start] + new + text[end:]
    return text


TEXT = st.text(st.sampled_from("ab'slrevd  \n\t1é.,"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(text=TEXT, edits=st.lists(st.tuples(st.integers(-2, 70), st.integers(-2, 70), TEXT), max_size=6), leaf=st.integers(1, 3))
def test_any_edits(library, text, edits, leaf):
    before = t.LEAF, t.FULL
    t.LEAF, t.FULL = leaf, 2 * leaf
    try:
        tree = t.TokenTree.of(text, t.counter(PATH))
        assert tree.n_tokens == len(library.encode_ordinary(text))
        for k in range(len(edits)):
            tree.edit(*edits[k])
            want = apply(text, edits[: k + 1])
            assert tree.text == want and tree.n_chars == len(want)
            assert tree.n_tokens == len(library.encode_ordinary(want))
            tree = t.TokenTree.restored(tree.text, tree.state(), tree.count)
    finally:
        t.LEAF, t.FULL = before


def test_an_edit_touches_little():
    words = " ".join(f"word{i}" for i in range(20_000))
    tree = t.TokenTree.of(words, t.counter(PATH))
    for place in (0, 50_000, len(words) - 1):
        tree.encoded = 0
        tree.edit(place, place + 1, "X y")
        assert 0 < tree.encoded <= 4 * t.LEAF


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        edits = t.cleaning(text)
        new = apply(text, edits)
        assert (r.n_chars, r.n_tokens, r.n_edits) == (len(text), len(library.encode_ordinary(text)), len(edits))
        assert (r.edited_chars, r.edited_tokens) == (len(new), len(library.encode_ordinary(new)))
    assert any(r.n_edits and r.n_encoded < r.n_pieces for r in rows)


def test_cleaning():
    text = "a b\nmail me@x.org\na b\ncall 123 456 789 0\nmail me@x.org"
    assert apply(text, t.cleaning(text)) == "a b\nmail [masked]\ncall [masked]"


def test_kept_trees_and_a_table_of_edits(spark, library):
    docs = spark.createDataFrame([(1, "one two three", 7), (2, None, 7), (None, "x", 7), (3, "", 7)], "doc_id long, text string, n_tokens int")
    edits = spark.createDataFrame(
        [(1, 2, 0, 1, "T"), (1, 1, 4, 7, "t w o"), (2, 1, 0, 0, "new text"), (9, 1, 0, 1, "z"), (3, 1, None, 2, "q"), (3, 2, 0, 9, None)],
        "doc_id long, seq long, start long, end long, replacement string",
    )
    trees = t.token_trees(docs, PATH)
    out = {r.doc_id: r for r in t.edited(t.with_edits(trees, edits), PATH).collect()}
    assert {d: r.text for d, r in out.items()} == {1: "Tne t w o three", 2: "new text", None: "x", 3: ""}
    assert all(r.n_tokens == len(library.encode_ordinary(r.text)) for r in out.values())
    assert out[1].n_before == 3 and out[None].n_encoded == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "a" * 300_000, 0), (2, "", 0)], "doc_id long, text string, n_chars int")
    rows = t.counts_after(docs, PATH).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in rows), key=repr) == [(1, 0), (1, 0), (2, 0), (None, 300_000)]
    assert t.counts_after(docs.limit(0), PATH).count() == 0
