"""The pipeline against a brute-force version that shares no operator with it."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from oracle import database
from test_secrets import plain as plain_spans
from test_simhash import plain_components, plain_print
from tokenizers import Tokenizer

import corpus_pipeline
from evenkeel.llm import mixing, quality_rules_sql

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def redacted(text):
    out, at, names = "", 0, ["ASSIGN", "ACCESS", "HEX"]
    spans, k = plain_spans(text), 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] <= end:
            k += 1
            end = max(end, spans[k][1])
        out, at, k = out + text[at:start] + f"[{names[kind]}]", end, k + 1
    return out + text[at:]


def brute_force(sf):
    con = database(sf)
    good = con.sql(
        f"WITH {quality_rules_sql.with_verdicts('documents')} SELECT {', '.join(COLUMNS)} FROM verdicts WHERE kept ORDER BY doc_id"
    ).fetchall()
    roots = plain_components([plain_print(r[1]) for r in good])
    rest = [r for k, r in enumerate(good) if roots[k] == k]
    rest = [(d, redacted(t), lang, source, n) for d, t, lang, source, n in rest]
    sizes = Counter(r[3] for r in rest)
    weights = {s: np.floor(n**0.5 * 1e6) for s, n in sizes.items()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, text, _, source, _ in rest:
        rate = weights[source] / sum(weights.values()) * (len(rest) / sizes[source])
        u = int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) / 2**52
        copies, term, upto = 0, np.exp(-rate), np.exp(-rate)
        while upto <= u:
            copies += 1
            term *= rate / copies
            upto += term
        ids = library.encode(text, add_special_tokens=False).ids
        out += [(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] * copies
    return sorted(out)


def test_against_brute_force(spark):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == brute_force(SF)
    assert len(got) > 20


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (None, "a token=abcdefgh " + " ".join(f"w{i}" for i in range(60)), "en", "s", 5)] * 2,
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == COLUMNS
            rows = rows.cache()
        assert not any(re.search("abcdefgh", r.text) for r in rows.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "BPE encoding and decoding",
    ]


def test_stages_keep_extra_columns_of_any_name(spark):
    """Names that the stages might use themselves, and a map; a very long text among short ones."""
    more = ["_mark", "_rows", "_id", "kept", "print", "component_id", "copies", "id", "n_words"]
    words = " ".join(f"word{i}" for i in range(60))
    rows = [
        (i, f"{words} number {i * 7919}" if i % 9 else "", "en", "s", 1, *(f"{c}{i}" for c in more), {"k": str(i)}) for i in range(40)
    ] + [(99, " ".join(f"long{i}" for i in range(150_000)), "en", "t", 1, *(f"{c}99" for c in more), {"k": "99"})]
    names = [*COLUMNS, *more, "tags"]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'map<string,string>' if c == 'tags' else 'string'}" for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
        docs = docs.cache()
        for r in docs.collect():
            assert [r[c] for c in more] == [f"{c}{r.doc_id}" for c in more] and r.tags == {"k": str(r.doc_id)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0


@pytest.mark.parametrize("text", ["a", "token=abcdef", 'x token = "' + "0f" * 12 + '" y AKIA' + "A" * 16])
def test_plain_redaction(text):
    assert "abcdef" not in redacted(text)
