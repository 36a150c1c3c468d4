"""Web archives: writing WARC files, reading them back, and one ordered index of all captures.

Writing is plain DataFrame work: a record is a text, and records are written by Spark's own text
writer with the blank lines that end a WARC record as its separator, so archives are files in the
shared folder like any other output. Of equal payloads one is kept as a response and the others
are revisits that refer to it.

Reading takes archives whole (their records and bytes are bounded), follows the lengths in the
headers, checks every payload against its digest and gives each archive's captures in order: a
sorted run. The runs are merged outside of any one machine's memory: captures are dealt to ranges
of (URL key, time, page), so a URL with many captures is split too, and within a range the runs
meet in a loser tree, which gives the histories in global order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenkeel.session import shared_dir, ship_package, stored

LEAST_SHARED = 1000  # bytes from which equal payloads are kept once
ARCHIVE_RECORDS, ARCHIVE_BYTES = 20_000, 1 << 30  # most of an archive; one record may be larger
RANGE_ROWS = 250_000
EPOCH = "2024-01-01T00:00:00Z"  # time of page 0 where a table has no times; page n is n seconds later
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
ORDER = ["url_key", "captured", "page_id"]


def url_key(url: Column) -> Column:
    """Host labels in reverse, then the path: pages of a site and its hosts stand together."""
    lowered = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(lowered, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    rest = F.regexp_replace(lowered, r"^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def with_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html (null: empty), payload_bytes, payload_digest, record_type, refers_to.

    Of the rows with equal payloads of at least LEAST_SHARED bytes those of the largest page_id are
    responses and the others revisit it; without any page_id all are responses. The payload itself
    is not part of any aggregation: groups are known by digest and length, and only groups of
    several rows are joined.
    """
    html = F.coalesce(html_col, F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"),
    )
    shared = rows.filter(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest", "payload_bytes")
    kept = shared.agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1 AND kept IS NOT NULL")
    kept = stored(pages.sparkSession, kept.select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "kept"), "shared")
    found = rows.join(kept, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    again = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id"))
    return found.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("kept")).alias("refers_to"),
    )


def record(row: DataFrame, time_col: str | None = None) -> Column:
    """A WARC record without the blank lines that end it."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seconds = F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + F.coalesce("page_id", F.lit(0))
    moment = F.col(time_col) if time_col else F.timestamp_seconds(F.pmod(seconds, F.lit(1 << 37)))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), number("payload_bytes"), F.lit(END)
    )
    is_revisit = F.col("record_type") == "revisit"
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("html")))
    # Line ends and other control characters would break the header.
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number("page_id"), F.lit(">")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url)),
        F.concat(F.lit("WARC-Date: "), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), number("refers_to"), F.lit(">"))),
        F.when(is_revisit, F.lit(f"WARC-Profile: {REVISIT}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(END), block)


def write_archives(
    pages: DataFrame, path: str | None = None, time_col: str | None = None, most_bytes: int = ARCHIVE_BYTES, most_records: int = ARCHIVE_RECORDS, **names
) -> str:
    """Write a record per row of ``pages`` to WARC files below ``path``; gives the folder.

    An archive has at most ``most_records`` records and ``most_bytes`` bytes, but at least one
    record. Records that could exceed the bytes are written apart, with as many to an archive as
    the largest of them allows.
    """
    path = path or shared_dir(pages.sparkSession, "archives")
    typed = with_types(pages, **names)
    lines = typed.select(record(typed, time_col).alias("value"))
    share = most_bytes // most_records
    # A header has the URL and under a kilobyte of its own.
    largest = pages.agg(F.max(F.octet_length(names.get("html_col", "html"))), F.max(F.octet_length(names.get("url_col", "url")))).first()
    largest = sum(x or 0 for x in largest) + 1024
    size = F.octet_length("value") + len(END)

    def write(some: DataFrame, records: int) -> None:
        some.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records).text(path)

    write(lines if largest <= share else lines.filter(size <= share), most_records)
    if largest > share:
        write(lines.filter(size > share), max(1, most_bytes // largest))
    return path


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, headers by lower-case name, block) of every record of an archive."""
    view, at = memoryview(content), 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:head_end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = head_end + 4
        end = start + int(headers["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        yield at, end - at, headers, view[start:end]
        at = end + 4


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def captured(content: bytes, archive: str) -> list[tuple]:
    """The captures of an archive, without URL key; payloads of responses are checked."""
    out = []
    for offset, length, headers, block in records(content):
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        split = bytes(block[:1024]).index(b"\r\n\r\n") + 4
        size = int(bytes(block[:split]).lower().partition(b"content-length:")[2].split()[0])
        kind = headers["warc-type"]
        if kind == "response" and (len(block) - split != size or hashlib.sha1(block[split:]).hexdigest() != digest):
            raise ValueError(f"damaged payload in {archive} at {offset}")
        out.append((
            headers["warc-date"], _number(headers["warc-record-id"]), headers.get("warc-target-uri"), kind,
            _number(headers.get("warc-refers-to")), size, digest, archive, offset, length,
        ))
    return out


READ = ["captured", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "offset", "length"]
READ_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _read(batches):
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows = captured(content.as_py(), path.as_py().rsplit("/", 1)[-1])
            columns = list(zip(*rows)) or [()] * len(READ)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, READ_TYPES)], READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below a folder, sorted within each partition (see CAPTURES)."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    kinds = ", ".join(f"{n} {'string' if pa.types.is_string(t) else 'long'}" for n, t in zip(READ, READ_TYPES))
    found = files.mapInArrow(_read, kinds).withColumn("url_key", url_key(F.col("url")))
    return found.select(*(x.split()[0] for x in CAPTURES.split(", "))).sortWithinPartitions(*ORDER)


class LoserTree:
    """The least of the heads of several sorted runs, found with one comparison per level.

    Each inner node keeps the run that lost there; the overall winner stands above the tree. When
    a run gives its next item, only the path from its leaf to the top is played again.
    """

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.heads = [next(r, None) for r in runs]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for run in range(len(runs)):
            self.play(run)

    def before(self, a: int, b: int) -> bool:
        """Run a's head comes before run b's; runs that are used up come last, ties by number."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        x, y = self.key(self.heads[a]), self.key(self.heads[b])
        return x < y or x == y and a < b

    def play(self, run: int) -> None:
        winner, node = run, (run + self.size) // 2
        while node > 0:
            if self.losers[node] < 0:  # while the tree is filled: wait for the other side
                self.losers[node] = winner
                return
            if self.before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.winner = winner

    def __iter__(self):
        while self.runs and (item := self.heads[self.winner]) is not None:
            yield item
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self.play(self.winner)


def _key(row: tuple):
    """Null keys and pages come first, as in Spark's own order."""
    return tuple((x is not None, x) for x in row[:3])


def ascending(rows: list[tuple]) -> list[list[tuple]]:
    """The rows cut wherever one comes before its predecessor: the sorted runs they consist of."""
    runs: list[list[tuple]] = []
    last = None
    for row in rows:
        k = _key(row)
        if last is None or k < last:
            runs.append([])
        runs[-1].append(row)
        last = k
    return runs


def _merge(batches):
    rows, names, schema = [], None, None
    for batch in batches:
        names, schema = batch.schema.names, batch.schema
        rows += zip(*(c.to_pylist() for c in batch.columns))
    if rows:
        merged = list(LoserTree([iter(r) for r in ascending(rows)], _key))
        for at in range(0, len(merged), 10_000):
            columns = zip(*merged[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=names)


def histories(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures (see CAPTURES) of sorted runs in global order of URL key, time and page: ranges in
    the order of their partitions, each merged from its runs.

    Dealing out keeps the order of a map task's rows, so a range gets one run from each; should
    rows come in another order, they just make more and shorter runs.
    """
    spark = runs.sparkSession
    ship_package(spark)
    runs = stored(spark, runs, "runs")
    ranges = max(1, -(-runs.count() // range_rows))
    return runs.repartitionByRange(ranges, *ORDER).mapInArrow(_merge, CAPTURES)
