"""Main texts against a plain reading, templates against vectors that are really built, odd pages."""

import html as entities
import random
import re
from collections import Counter, defaultdict

import pytest

from evenkeel.llm import html_templates as ht, queries
from evenkeel.llm.html_blocks import ARTICLE, Page, best_region

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def kept(html):
    blocks = Page(html).blocks
    return [b[0] for b in blocks if b[3] == best_region(blocks)]


def test_query_against_a_plain_reading(spark):
    def plain(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        return "\n\n".join(b for b in blocks if b)

    got = {r.page_id: r for r in queries.op13_html(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        found = got[r.page_id]
        assert (found.url, found.text, found.n_chars) == (r.url, plain(r.html), len(plain(r.html)))


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("", []),
        ("plain &lt;b&gt; text", ["plain <b> text"]),
        ("<p>one<p>two<br>three</p>four", ["one", "two three", "four"]),
        ("<article><h1> A \n\t title</h1><p>x<b>y</b>z &amp;&nbsp;&copy;</p></article><p>not this</p>", ["A title", "xyz & ©"]),
        ("<article><p>a<br><p><b>b<br><p>c</article>", ["a", "b", "c"]),
        ("<script>if (a<b) '</p>';</script><style>p{}</style><p>x</p><!-- <p>no</p> --><textarea><p>no</textarea>", ["x"]),
        ("<header>top</header><nav><ul><li><a href='/'>home</a></ul></nav><p>x</p><aside>side</aside><footer>end</footer>", ["x"]),
        ("<article><header><h1>T</h1></header><p>x</p><footer>by me</footer><section id=comments><p>no</p></section></article>", ["T", "x"]),
        ("<article><p>x</p><div class='ad-slot'>no</div><form><label>no</label></form><div class='CookieNotice'>no</div></article>", ["x"]),
        ("<body class='with-nav menu'><main class='has-sidebar'><div class='no-comments'><p>x</p></div><div role=complementary>no</div></main><p>no</p>", ["x"]),
        ("<article><p>a <span class=ad>no <i>no</i></span> b</p><p>c</p></article>", ["a b", "c"]),
        ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table></article>", ["a", "b", "c", "d", "e f", "g"]),
        ("<div title='a > b' data-x=\"<p>\">x</div><p class=it's>y</p><p>don't</p>", ["x", "y", "don't"]),
        ("a < b and 3 <4 </> <?php no ?><![CDATA[no]]>c", ["a < b and 3 <4 c"]),
        ("<p>x</p></div></article></p>y<b", ["x", "y"]),
        ("<p>x<a href='/never closed", ["x"]),
        ("<p>x</p><script>never closed <p>no</p>", ["x"]),
        ("<ARTICLE><P CLASS=x>A</P></ARTICLE>", ["A"]),
    ],
)
def test_blocks(page, blocks):
    assert kept(page) == blocks


def site(rng, n, marked):
    """Pages of one template: a notice and a slogan without telling names, an article, a varied side part."""
    words = lambda k: " ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(k))
    out = []
    for _ in range(n):
        paragraphs = [words(rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        inner = f"<h1>{words(3)}</h1><div class='x1'>Our offer: only today</div>{body}"
        side = f"<div class='x7'><p>{words(2)}</p></div>"
        start = "<article>" if marked else "<div class='c3'>"
        page = f"<html><body><div class='x2'><p>We use crumbs</p></div>{start}{inner}{'</article>' if marked else '</div>'}{side}</body></html>"
        title = re.search("<h1>(.*?)</h1>", page)[1]
        out.append((page, "\n\n".join([title, *paragraphs])))
    return out


@pytest.mark.parametrize("marked", [True, False])
def test_templates_leave_the_article(spark, marked):
    rng = random.Random(1)
    pages = site(rng, 12, marked)
    rows = [(i, f"https://a.example.org/{i}", p) for i, (p, _) in enumerate(pages)]
    rows += [(100 + i, f"https://few.example.org/{i}", p) for i, (p, _) in enumerate(pages[:3])]  # too few for a template
    rows += [(200, None, pages[0][0]), (201, "no url", pages[0][0])]
    got = {r.page_id: r.text for r in ht.main_texts(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert [got[i] for i in range(12)] == [text for _, text in pages]
    for i, page in [(100, 0), (101, 1), (200, 0), (201, 0)]:
        assert got[i].split("\n\n") == kept(pages[page][0])


def test_copies_and_common_passages_stay(spark):
    """Equal pages, near copies, and a passage or title that many pages of a host share are no template."""
    rng = random.Random(2)
    one = site(rng, 1, True)[0][0]
    rows = [(i, f"http://copy.example/{i}", one) for i in range(40)]
    rows += [(100 + i, f"http://near.example/{i}", f"<article><p>{'same words ' * 50}</p><h2>{i}</h2></article>") for i in range(9)]
    passage = "a passage that many pages quote"
    common = [f"<article><h1>{'News' if i % 2 else i}</h1><p>{passage}</p><p>own text {i}</p></article>" for i in range(30)]
    rows += [(200 + i, f"http://common.example/{i}", p) for i, p in enumerate(common)]
    got = {r.page_id: r.text for r in ht.main_texts(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    for i, _, page in rows:
        assert got[i].split("\n\n") == kept(page)


def test_template_against_built_vectors(spark):
    """Classes, and fixed texts in them, from occurrence vectors written out in full."""
    rng = random.Random(3)
    pages = [p for p, _ in site(rng, 9, True)] + [p for p, _ in site(rng, 8, False)]
    pages = [p.replace("We use crumbs", "Varied %d" % i) if i % 3 else p for i, p in enumerate(pages)]
    rows = [(i, "http://a.example/", p) for i, p in enumerate(pages)] + [(50, "http://a.example/", pages[0])]
    parsed = ht.parsed(spark.createDataFrame(rows, PAGES).coalesce(1), "page_id", "url", "html").cache()
    single = ht.different_pages(parsed)
    assert single.count() == len(pages)
    vectors, texts, around = defaultdict(dict), defaultdict(dict), {}
    for i, page in enumerate(pages):
        for t in Page(page).tokens.values():
            vectors[t.key][i] = t.count
        blocks = [b for b in Page(page).blocks if b[3] == best_region(Page(page).blocks)]
        for (element, key), n in Counter((b[1], b[2]) for b in blocks).items():
            texts[key][i], around[key] = n, element
    vectors = {k: v for k, v in vectors.items() if len(v) >= ht.LEAST_PAGES}
    template = ht.templates(single)
    got = template.collect()
    assert {r.key: r.pages for r in got} == {k: len(v) for k, v in vectors.items()}
    classes = defaultdict(set)
    for r in got:
        classes[r.pages, r.vector].add(r.key)
    expected = defaultdict(set)
    for key, v in vectors.items():
        expected[tuple(sorted(v.items()))].add(key)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))
    fixed = {k for k, v in texts.items() if len(v) >= ht.LEAST_PAGES and vectors.get(around[k]) == v}
    assert {r.key for r in ht.fixed_texts(single, template).collect()} == fixed != set()


def test_odd_rows(spark):
    rows = [(1, "http://a.example/", None), (1, "http://a.example/", ""), (None, None, "<p>x</p>"), (3, "http://a.example/", "<p>x</p>"), (3, "http://a.example/", "<p>x</p>")]
    rows += [(4, "http://b.example/", "<article>" + "<p>word &amp; word</p>" * 60_000 + "</article>"), (5, "http://b.example/", "<div>" * 20_000 + "deep" + "</div>" * 9)]
    rows += [(6, "http://b.example/", "<a b='" * 20_000), (7, "http://b.example/", "<li>" * 5_000 + "x" + "<p>" * 5_000)]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], PAGES + ", page int, host string")
    found = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in ht.main_texts(df).collect()), key=repr)
    long = "\n\n".join(["word & word"] * 60_000)
    want = [(1, "http://a.example/", "", 0)] * 2 + [(None, None, "x", 1)] + [(3, "http://a.example/", "x", 1)] * 2
    want += [(4, "http://b.example/", long, len(long)), (5, "http://b.example/", "deep", 4), (6, "http://b.example/", "", 0), (7, "http://b.example/", "x", 1)]
    assert found == sorted(want, key=repr)


def test_empty_table(spark):
    found = ht.main_texts(spark.createDataFrame([], PAGES))
    assert found.count() == 0 and found.columns == ["page_id", "url", "text", "n_chars"]


def test_regions():
    assert best_region(Page("<main><p>x</p><article><p>y</p></article></main>").blocks) == ARTICLE
