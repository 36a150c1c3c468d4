"""Archives: exact round trips, the merge against sorting, the query against its SQL."""

import hashlib
import random

import pytest
from oracle import database, differences

from evenkeel.llm import queries, warc

SF = "/root/testdata/sf0.001"


def test_query_agrees_with_its_sql(spark):
    assert differences(queries.op3_warc(spark, SF), database(SF), queries.SQL["op3_warc"]) == []


def test_payloads_come_back(spark):
    html = ["", None, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é" * 700, "x" * 999, "y" * 300_000, "\r\n\r\n", "end\n"]
    pages = [(k, f"http://A.example.org/{k}?q=1\r\nX: y", h) for k, h in enumerate(html * 3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = warc.write_archives(df)
    files = spark.read.format("binaryFile").load(path).collect()
    got = {}
    for f in files:
        for _, _, headers, block in warc.records(bytes(f.content)):
            got[warc._number(headers["warc-record-id"])] = (headers["warc-type"], bytes(block).partition(b"\r\n\r\n")[2])
    for k, h in enumerate(html * 3):
        large = len((h or "").encode()) >= 1000
        assert got[k] == (("revisit", b"") if large and k < 16 else ("response", (h or "").encode()))
    found = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert all(found[k].payload_digest == hashlib.sha1((h or "").encode()).hexdigest() for k, h in enumerate(html * 3))
    assert found[3].refers_to == 19 and found[19].refers_to is None and found[0].url_key == "org,example,a)/0?q=1x:y"
    raw = {f.path.rsplit("/", 1)[-1]: bytes(f.content) for f in files}
    one = found[5]
    assert raw[one.archive][one.offset : one.offset + one.length].startswith(b"WARC/1.1\r\nWARC-Type: revisit")


def test_archives_are_bounded_by_bytes(spark):
    """Large records are written apart; only one that is too large by itself exceeds the bytes."""
    html = ["a" * (50 + k % 7) for k in range(300)] + ["b%d" % k + "x" * 4000 for k in range(20)] + ["y" * 60_000]
    pages = spark.createDataFrame([(k, f"http://a/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, most_bytes=30_000, most_records=25)
    sizes = [(f.length, len(list(warc.records(bytes(f.content))))) for f in spark.read.format("binaryFile").load(path).filter("length > 0").collect()]
    assert sum(n for _, n in sizes) == len(html) and all(n <= 25 and (size <= 30_000 or n == 1) for size, n in sizes)
    got = {r.page_id: r.payload_bytes for r in warc.read_archives(spark, path).collect()}
    assert got == {k: len(h) for k, h in enumerate(html)}


def test_damage_is_found(spark):
    path = warc.write_archives(spark.createDataFrame([(1, "http://a", "hello")], "page_id long, url string, html string"))
    content = bytes(spark.read.format("binaryFile").load(path).first().content)
    assert len(warc.captured(content, "x")) == 1
    with pytest.raises(ValueError):
        warc.captured(content.replace(b"hello", b"hellO"), "x")
    with pytest.raises(ValueError):
        warc.captured(content.replace(b"hello", b"hell"), "x")


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 9), r, i) for i in range(rng.randint(0, 12))) for r in range(k)]
    merged = list(warc.LoserTree([iter(r) for r in runs], lambda x: x[0]))
    assert merged == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1]))


def test_histories_are_in_global_order(spark):
    rows = [(f"http://{'hot' if i % 3 else i}.org/", i) for i in range(400)]
    pages = spark.createDataFrame([(i, u, "p" * (i % 5)) for u, i in rows], "page_id long, url string, html string").repartition(5)
    out = warc.histories(warc.read_archives(spark, warc.write_archives(pages)), range_rows=90)
    assert out.rdd.getNumPartitions() > 3
    got = [tuple(r)[:3] for r in out.collect()]
    assert len(got) == 400 and got == sorted(got)


def test_edges(spark):
    pages = spark.createDataFrame(
        [(None, None, None, 1), (None, "u", "z" * 1000, 2), (5, "u", "z" * 1000, 3), (5, "u", "z" * 1000, 3), (6, None, "q" * 1000, 4), (-7, "http://x/", "q" * 1000, 4)],
        "page_id long, url string, html string, payload_bytes int",
    )
    out = warc.histories(warc.read_archives(spark, warc.write_archives(pages))).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in out), key=repr) == sorted(
        [(None, "response", None), (None, "revisit", 5), (5, "response", None), (5, "response", None), (6, "response", None), (-7, "revisit", 6)], key=repr
    )
    empty = warc.histories(warc.read_archives(spark, warc.write_archives(pages.limit(0))))
    assert empty.count() == 0
