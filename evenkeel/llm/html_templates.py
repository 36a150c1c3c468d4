"""Main text of pages by deducing the template of each site from equivalence classes of tokens.

A token is an element's path, or a text in an element. Its occurrence vector says how often it is
in each page of its host; tokens of equal vectors form an equivalence class: what a template
prints together. Vectors are never built: a token's number of pages and the exclusive or of a hash
of (page, count) stand for it, so they come from one aggregation with partial sums in each task,
however many pages a host has. Pages of a host that hold the same text count once.

Paths make classes nest: an element belongs to the class of its parent, or begins one that lies in
a slot of the parent's class (``outer``). Classes in enough pages form the host's template, which
tells

- fixed text: a text in the class of the element around it fills that element in every page that
  has it, so the template prints it (a notice, a slogan) and the article does not;
- the main slot, for pages that do not mark their article: the innermost element that is once in
  most such pages of the host and holds most of the words that are not links.

What remains in a page's article (or main slot) is the result. Menus, headers, footers, forms and
the like are left out by their tags, roles and names (``html_blocks``).
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.html_blocks import NONE, Page, best_region, signed
from evenkeel.session import ship_package, stored

LEAST_PAGES = 5  # pages of different texts in which a class must occur
MAIN_SHARE, MAIN_PAGES = 0.7, 0.5  # words and pages of a host that its main slot must have

_BLOCK = pa.struct([("text", pa.string()), ("text_key", pa.int64()), ("heading", pa.bool_())])
_TAG = pa.struct(
    [("key", pa.int64()), ("parent", pa.int64()), ("n", pa.int32()), ("words", pa.int64())]
    + [("depth", pa.int32()), ("holds", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())]
)
_TEXT = pa.struct([("key", pa.int64()), ("parent", pa.int64()), ("n", pa.int32())])
PARSED = (
    "content long, marked boolean, words long, blocks array<struct<text: string, text_key: long, heading: boolean>>, "
    "tags array<struct<key: long, parent: long, n: int, words: long, depth: int, holds: boolean, first: int, last: int>>, "
    "texts array<struct<key: long, parent: long, n: int>>"
)
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(_BLOCK), pa.list_(_TAG), pa.list_(_TEXT)]


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.when(host != "", host)


def parsed_page(html: str) -> tuple:
    """A page in the columns of PARSED: a hash of its text, whether it marks its article, the words
    outside links, its blocks, its elements, and the texts that may be fixed."""
    page = Page(html)
    region = best_region(page.blocks)
    kept = [b for b in page.blocks if b[3] == region]
    content = xxhash.xxh64()
    counts: dict[tuple[int, int], int] = {}
    for text, key, text_key, _, _ in kept:
        content.update(text + "\n")
        counts[key, text_key] = counts.get((key, text_key), 0) + 1
    elements = {t.key: t.count for t in page.tokens.values()}
    blocks = [{"text": text, "text_key": text_key, "heading": heading} for text, _, text_key, _, heading in kept]
    tags = [
        {"key": t.key, "parent": t.parent, "n": t.count, "words": t.words, "depth": t.depth, "holds": t.holds, "first": t.first, "last": t.last}
        for t in page.tokens.values()
    ]
    # A text that is not as frequent in the page as its element cannot have the element's vector.
    texts = [{"key": text_key, "parent": key, "n": n} for (key, text_key), n in counts.items() if elements.get(key) == n]
    return signed(content.intdigest()), region != NONE, page.stack[0].words, blocks, tags, texts


def _parse(batches):
    names = [x.split()[0] for x in ("content", "marked", "words", "blocks", "tags", "texts")]
    for batch in batches:
        columns = list(zip(*map(parsed_page, batch.column("html").to_pylist()))) or [()] * len(names)
        kept = [c for c in batch.schema.names if c != "html"]
        arrays = [*map(batch.column, kept), *(pa.array(c, t) for c, t in zip(columns, _KINDS))]
        yield pa.RecordBatch.from_arrays(arrays, [*kept, *names])


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A row per page: page_id, url, host, page (a number of its own) and PARSED."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
        F.monotonically_increasing_id().alias("page"), F.coalesce(html_col, F.lit("")).alias("html"),
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "html")
    return rows.mapInArrow(_parse, f"{kept}, {PARSED}")


def different_pages(pages: DataFrame) -> DataFrame:
    """The pages that have a host, one for each text of a host."""
    spark = pages.sparkSession
    known = pages.filter("host IS NOT NULL")
    several = known.groupBy("host", "content").agg(F.min("page").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    several = stored(spark, several.select("host", "content", "kept"), "copies")
    again = known.select("host", "content", "page").join(several, ["host", "content"]).filter("page != kept").select("page")
    return known.join(stored(spark, again, "again"), "page", "left_anti")


def _vectors(tokens: DataFrame, *more: Column) -> DataFrame:
    """host, key, pages and vector of tokens (host, page, key, n), and ``more`` sums."""
    return tokens.groupBy("host", "key").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), *more)


def templates(pages: DataFrame) -> DataFrame:
    """The elements of every host's template: host, key, parent, pages, vector (of the class), outer
    (vector of the class in whose slot the element's class lies; its own where the parent is in it),
    depth, holds, and of the pages without a marked article: open_pages, open_times, words."""
    spark = pages.sparkSession
    each = pages.select("host", "page", (~F.col("marked")).cast("int").alias("unmarked"), F.explode("tags").alias("t")).select("host", "page", "unmarked", "t.*")
    found = _vectors(
        each, F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.bool_or("holds").alias("holds"), F.sum("unmarked").alias("open_pages"),
        F.sum(F.col("n") * F.col("unmarked")).alias("open_times"), F.sum(F.col("words") * F.col("unmarked")).alias("words"),
    )
    found = stored(spark, found.filter(F.col("pages") >= LEAST_PAGES), "elements")
    parents = found.select("host", F.col("key").alias("parent"), F.col("vector").alias("outer"))
    return found.join(parents, ["host", "parent"], "left")


def fixed_texts(pages: DataFrame, template: DataFrame) -> DataFrame:
    """(host, key) of the texts that are in the class of the element around them."""
    each = pages.select("host", "page", F.explode("texts").alias("t")).select("host", "page", "t.*")
    texts = _vectors(each, F.max("parent").alias("parent")).filter(F.col("pages") >= LEAST_PAGES)
    around = template.select("host", F.col("key").alias("parent"), "pages", "vector")
    return stored(pages.sparkSession, texts, "texts").join(around, ["host", "parent", "pages", "vector"]).select("host", "key")


def main_slots(pages: DataFrame, template: DataFrame) -> DataFrame:
    """(host, slot): the element with the main text of the host's pages that don't mark their article."""
    spark = pages.sparkSession
    whole = pages.filter(~F.col("marked")).groupBy("host").agg(F.count("*").alias("all_pages"), F.sum("words").alias("all_words"))
    whole = stored(spark, whole.filter(F.col("all_pages") >= LEAST_PAGES), "unmarked")
    once = template.filter(F.col("holds") & (F.col("open_times") == F.col("open_pages"))).join(whole, "host")
    most = (F.col("open_pages") >= MAIN_PAGES * F.col("all_pages")) & (F.col("words") >= MAIN_SHARE * F.col("all_words")) & (F.col("words") > 0)
    return once.filter(most).groupBy("host").agg(F.max_by("key", F.struct("depth", "words", "key")).alias("slot"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``; other columns are ignored.

    A null page counts as empty; a page without article text gives an empty text. Blocks are
    joined by two newlines, in page order; white space within a block is one space. Repeated rows
    and ids are pages of their own; equal pages of a host count once in its template. Pages without
    a host (null or odd URLs) have no template, nor have hosts of fewer than LEAST_PAGES different
    pages: there tags, roles and names alone decide. Fixed texts that make up over half of a page
    are kept, as such pages are copies of one another. Pages of any length are read whole, one by
    one. An empty table gives no rows.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = stored(spark, parsed(pages, id_col, url_col, html_col), "pages")
    single = different_pages(rows)
    template = stored(spark, templates(single), "template")
    fixed = stored(spark, fixed_texts(single, template), "fixed")
    slots = stored(spark, main_slots(single, template), "slots")
    # Fixed texts by page: a few keys each.
    held = rows.filter("host IS NOT NULL").select("host", "page", F.explode("texts.key").alias("key")).join(fixed, ["host", "key"], "left_semi")
    held = stored(spark, held.groupBy("page").agg(F.collect_set("key").alias("fixed")), "held")
    out = rows.join(held, "page", "left").join(slots, "host", "left")
    is_fixed = lambda b: F.coalesce(F.array_contains("fixed", b["text_key"]), F.lit(False))
    length = lambda blocks: F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    copies = 2 * length(F.filter("blocks", is_fixed)) > length(F.col("blocks"))
    place = F.get(F.filter("tags", lambda t: (t["key"] == F.col("slot")) & (t["n"] == 1)), F.lit(0))
    inside = lambda b, i: F.col("marked") | F.col("place").isNull() | b["heading"] | ((i >= F.col("place.first")) & (i < F.col("place.last")))
    kept = F.filter("blocks", lambda b, i: (F.col("copies") | ~is_fixed(b)) & inside(b, i))
    out = out.withColumns({"copies": copies, "place": place})
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
