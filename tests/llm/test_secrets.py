"""Secret scan against plain expressions over whole texts, and by hand."""

import hashlib
import re

from hypothesis import given, settings, strategies as st

from evenkeel.llm import queries, secrets

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain(text):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


def base(text):
    return [s for s in secrets.secret_spans(text) if s[2] < 3]


PIECES = ["token", "Secret", "api_key", "APIKEY", "passwd", "paſſword", "=", ": ", '"', "AKIA", "A1B2" * 4, "abc", "0f" * 12, "ü", "K", "\n", " "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans(text):
    assert base(text) == plain(text)


def test_short_matches_use_up_their_text():
    text = "token=secret=abcdef token: ab token=x"
    assert base(text) == plain(text) == [(0, 19, 0)]


def test_checksums():
    body = "abcdefghij0123456789ABCDEFGHIJ"
    good, bad = f"ghp_{body}{secrets.checksum(body)}", f"ghp_{body}zzzzzz"
    assert secrets.secret_spans(f"é {good} {bad}") == [(2, 2 + len(good), 3)]
    assert secrets.secret_spans(good + "x") == []
    assert secrets.redacted(f"é {good}.") == "é [FORGE]."


def test_overlapping_spans_are_redacted_once():
    assert secrets.redacted('a token = "' + "0f" * 12 + '" b') == 'a [ASSIGN]" b'


def test_query(spark):
    rows = queries.op8_secret_scan(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain(texts[r.doc_id])
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in spans) for k in range(3)]
    assert any(r.n_assign for r in rows)


def test_edges(spark, rows):
    docs = spark.createDataFrame(
        [(1, None, "x"), (None, "token=abcdef", "y"), (2, "", "z"), (2, "", "z"), (3, "a" * 500_000 + " token=abcdef", "w")],
        "doc_id long, text string, spans string",
    )
    out = secrets.digest_columns(secrets.scan_secrets(docs))
    assert [(r.doc_id, r.n_assign) for r in sorted(out.collect(), key=repr)] == [(1, 0), (2, 0), (2, 0), (3, 1), (None, 1)]
    kept = secrets.redact_secrets(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect() if r.text is not None)[0] == ""
    assert kept.filter("doc_id = 1").first().text is None
    assert secrets.scan_secrets(docs.limit(0)).count() == 0
