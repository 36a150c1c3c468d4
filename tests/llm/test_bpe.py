"""BPE against the tokenizers library, id by id, on real texts and odd ones."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from evenkeel.llm import bpe, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a<|endoftext|>B <|startoftext|>", "İstanbul ΣΑΣ ς \x1c\x1d x\x85y\xa0z", "don't we'll '' 'S it''s 12²3Ⅷ",
    "é Å ﬁ", "😀😀 a😀b", "日本語テキスト", "​ ﻿ à́b", "x" * 3000, "ǅ ß ẞ", "</w> <w> /w", "　a",
]


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.WordEncoder(bpe.Vocabulary(f.read()))


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(encoder, library, text):
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(st.characters(exclude_categories=["Cs", "Cn"])), st.text("abtheing's .0\n", max_size=60)))
def test_any_text(encoder, library, text):
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_very_long_texts(encoder, library):
    """A million characters: many words, one word without an edge, and one of a few repeated characters."""
    for text in ("The quick brown fox, 12 foxes' tails.\n" * 26_000, "abcdefghij" * 20_000, "a😀" * 50_000):
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_byte_level_pieces():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        pieces = bpe.Pieces(bpe.Vocabulary(f.read()))
    for word in ["the", " the", " unbelievably", "aaaaaaa", " Zürich", "strawberries", "xqzzzzy"]:
        assert pieces.encode(word.encode()) == library.encode(word, add_special_tokens=False).ids


def test_memory_of_words_is_bounded():
    seen = []
    words = bpe.Remembered(lambda w: seen.append(w) or len(w), 2)
    assert [words[w] for w in ("a", "bb", "ccc", "a")] == [1, 2, 3, 1]
    words.turn()
    assert not len(words) and words["a"] == 1 and seen == ["a", "bb", "ccc"]


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        decoded = library.decode(want, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, b"x"), (None, "a", b"y"), (2, "", b"z"), (3, "the the", b"z"), (3, "the the", b"z")],
        "doc_id long, text string, ids binary",
    )
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == [(1, ""), (2, ""), (3, "the</w> the</w>"), (3, "the</w> the</w>"), (None, "a</w>")]
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0
