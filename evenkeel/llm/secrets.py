"""Secret scan: keyword automaton, anchored expressions near its hits, embedded checksums.

A text is folded to lower case (ASCII only, so offsets stay) and read once by an Aho-Corasick
automaton. An expression is tried only where its keyword was found, anchored at that place.
Kinds that carry a checksum of their own are kept only if it holds. Hexadecimal runs have no
keyword; they are found by their run length.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.session import ship_package

# The kinds in their order, and what each looks like.
BASE_KINDS = ["assign", "access", "hex"]
CHECKED_KINDS = ["forge", "registry"]
KINDS = BASE_KINDS + CHECKED_KINDS
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
FORGE = re.compile(r"gh[opsur]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
REGISTRY = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "forge": ["gho_", "ghp_", "ghs_", "ghu_", "ghr_"],
    "registry": ["npm_"],
}
LEAST_VALUE = 6
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = "array<struct<kind:string,start:int,end:int>>"


def checksum(body: str) -> str:
    """CRC-32 of the random part as six base-62 digits, which such keys end with."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


@cache
def automaton():
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            out.add_word(word, (KINDS.index(kind), len(word)))
    out.make_automaton()
    return out


def lowered(text: str) -> str:
    """A-Z in lower case; every other character, and so every offset, stays."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def _at(kind: int, text: str, start: int):
    """(end, counts) of the expression of a kind at a place; None where it doesn't match there."""
    if kind == 0:
        m = ASSIGN.match(text, start)
        return m and (m.end(), len(m.group(2)) >= LEAST_VALUE)
    if kind == 1:
        m = ACCESS.match(text, start)
        return m and (m.end(), True)
    m = (FORGE if kind == 3 else REGISTRY).match(text, start)
    return m and (m.end(), checksum(m.group(1)) == m.group(2))


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start and then kind; leftmost and without overlap per kind.

    A match that fails a later test (a short value, a wrong checksum) still uses up its text.
    """
    found = [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    hits = sorted((end + 1 - length, kind) for end, (kind, length) in automaton().iter(lowered(text)))
    free = [0] * len(KINDS)
    for start, kind in hits:
        if start >= free[kind] and (m := _at(kind, text, start)):
            free[kind] = m[0]
            if m[1]:
                found.append((start, m[0], kind))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def _scan(batches):
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        rows = [
            [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in secret_spans(t)] if t else []
            for t in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind_type))], ["id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``: kind, start and end (code points, end exclusive), by start and kind.

    One row per row of ``docs``, in one pass and without a shuffle. A null or empty text has no
    spans; a null id stays null.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_scan, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; spans that touch are merged."""
    out, at, open_end = [], 0, -1
    for start, end, kind in secret_spans(text):
        if start > open_end:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            open_end = at = end
        else:
            open_end = at = max(open_end, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns, every secret in ``text_col`` replaced by its kind.

    Null texts stay null. No shuffle; rows stay where they are.
    """
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.array([t and redacted(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names
            )

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as one text."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(BASE_KINDS))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
