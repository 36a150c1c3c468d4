"""One HTML page as the blocks of text that may belong to its article, and as structural tokens.

A helper of ``html_templates``: it knows nothing of other pages. Tags are read as browsers do in
the cases that matter for text: raw elements, comments, quoted attributes, implied ends of
paragraphs and list items, stray and missing end tags. Every step is linear in the page.

An element's token is its path: the names and class words from the top of the page, digits left
out, as a chained 64-bit hash, so deep pages cost no more than flat ones.
"""

from __future__ import annotations

import re
from html import unescape

import xxhash

# What HTML says about elements, and the words by which sites name what is not article.
RAW = "script style textarea title xmp iframe noembed noframes noscript".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head nav footer aside form dialog menu template svg math object canvas audio video select button datalist".split()) | set(RAW)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody tfoot thead tr ul".split()
)
CELLS = {"td", "th", "br"}  # apart from what is beside them, within one block
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager comment comments commentlist disqus respond replies share sharing social related recommended "
    "recommendations widget toolbar footer masthead login signup".split()
)
OUTSIDE_NAMES = {"header"}  # of the page, but an article may have one of its own
STATES = ("has-", "with-", "no-", "is-", "not-")  # such words tell about the element, they do not name it
HOLDERS = {"body", "div", "section", "center", "fieldset", "table", "tbody", "tr"}  # elements that may be a site's main slot
NEVER = {"html", "body", "main"}  # not dropped for their names
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table", "select", "menu", "dir"}  # an implied end stays within these

NONE, MAIN, ARTICLE = 0, 1, 2
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>""")  # a bracket in a quoted value ends no tag
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


class Frame:
    """An open element."""

    __slots__ = ("name", "key", "depth", "block", "dropped", "region", "words", "first")

    def __init__(self, name, key, depth, block, dropped, region, first):
        self.name, self.key, self.depth, self.block, self.dropped, self.region = name, key, depth, block, dropped, region
        self.words, self.first = 0, first


class Token:
    """A path: how often it occurs, the words below its elements, and the blocks of the first."""

    __slots__ = ("key", "parent", "count", "words", "depth", "holds", "first", "last")

    def __init__(self, key, parent, depth, holds, first):
        self.key, self.parent, self.depth, self.holds, self.first = key, parent, depth, holds, first
        self.count, self.words, self.last = 0, 0, None


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Page:
    """``blocks``: (text, key of the element, key of the text in it, region, heading) of all text that
    no name or tag rules out; ``tokens``: the paths of the page in order of their first element."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.tokens: dict[int, Token] = {}
        self.stack = [Frame("", 0, 0, True, False, NONE, 0)]
        self.open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.links = 0  # open links
        self.words = 0  # of the block so far, outside links
        self.read(html)
        self.flush()
        while len(self.stack) > 1:
            self.pop()

    def read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                return
            if lt > at:
                self.text(html[at:lt])
            after = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                # An empty comment may end at once.
                end = lt + 4 if html.startswith(("<!-->", "<!--->"), lt) else html.find("-->", lt + 4)
                at = size if end < 0 else html.index(">", end) + 1
            elif after in ("!", "?"):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            elif name := _NAME.match(html, lt + 2 if after == "/" else lt + 1):
                found = _END.match(html, name.end())
                if found is None:
                    return  # an unfinished tag is no text
                at = found.end()
                tag = name[0].lower()
                if after == "/":
                    self.end_tag(tag)
                    continue
                self.start_tag(tag, html[name.end() : at - 1])
                if tag in _RAW_END:
                    close = _RAW_END[tag].search(html, at)
                    at = size if close is None else close.start()
            elif after == "/":
                end = html.find(">", lt)  # "</" without a name is a comment
                at = size if end < 0 else end + 1
            else:
                self.text("<")
                at = lt + 1

    def text(self, raw: str) -> None:
        if not self.stack[-1].dropped:
            text = unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if not self.links:
                self.words += len(text.split())

    def flush(self) -> None:
        """What has gathered becomes a block of the innermost open block element."""
        if not self.pieces:
            return
        text, words = " ".join("".join(self.pieces).split()), self.words
        self.pieces, self.words = [], 0
        if text:
            frame = next(f for f in reversed(self.stack) if f.block)
            text_key = signed(xxhash.xxh64_intdigest(text, frame.key))
            self.blocks.append((text, signed(frame.key), text_key, frame.region, frame.name == "h1"))
            frame.words += words

    def push(self, name: str, block: bool, dropped: bool, region: int, classes: str) -> None:
        parent = self.stack[-1]
        key = xxhash.xxh64_intdigest(f"{name}.{_DIGITS.sub('', classes)}", parent.key)
        self.stack.append(Frame(name, key, parent.depth + 1, block, dropped, region, len(self.blocks)))
        self.open[name] = self.open.get(name, 0) + 1
        if block and not dropped:
            token = self.tokens.setdefault(key, Token(signed(key), signed(parent.key), parent.depth + 1, name in HOLDERS, len(self.blocks)))
            token.count += 1

    def pop(self) -> None:
        frame = self.stack.pop()
        self.open[frame.name] -= 1
        self.stack[-1].words += frame.words
        if token := self.tokens.get(frame.key) if frame.block and not frame.dropped else None:
            token.words += frame.words
            token.last = len(self.blocks) if token.last is None else token.last

    def pop_to(self, name: str) -> None:
        while self.stack[-1].name != name:
            self.pop()
        self.pop()

    def start_tag(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        if name == "a":
            self.links += 1
        if block or name in CELLS:
            if block:
                self.flush()
            elif not self.stack[-1].dropped:
                self.pieces.append(" ")
            if block and self.open.get("p") and next(f for f in reversed(self.stack) if f.block).name == "p":
                self.pop_to("p")
            self.close_implied(name)
        if name in VOID:
            return
        words = {"class": "", "id": "", "role": "", "itemprop": ""}
        if attributes.strip(" /"):
            for found in _ATTRIBUTE.finditer(attributes):
                words[found[1].lower()] = words[found[1].lower()] or found[2] or found[3] or found[4] or ""
        parent = self.stack[-1]
        region = parent.region
        if name == "article" or words["itemprop"] == "articleBody":
            region = ARTICLE
        elif name == "main" or words["role"] == "main":
            region = max(region, MAIN)
        dropped = parent.dropped or name in DROPPED or self.named(name, words, region) or (name == "header" and region == NONE)
        if block or name in ("td", "th") or dropped:
            self.push(name, block, dropped, region, words["class"])

    def named(self, name: str, words: dict[str, str], region: int) -> bool:
        """True where role, class or id say that the element is not article."""
        if name in NEVER or words["itemprop"] == "articleBody":
            return False
        if words["role"].lower() in ROLES:
            return True
        for word in f"{words['class']} {words['id']}".split():
            parts = {x.lower() for x in _WORDS.findall(word)}
            if not word.lower().startswith(STATES) and (parts & NAMES or region == NONE and parts & OUTSIDE_NAMES):
                return True
        return False

    def close_implied(self, name: str) -> None:
        closes = CLOSES.get(name)
        if closes and any(self.open.get(x) for x in closes):
            for frame in reversed(self.stack):
                if frame.name in LISTS:
                    return
                if frame.name in closes:
                    self.pop_to(frame.name)
                    if name != "tr" or frame.name == "tr":
                        return
                    return self.close_implied(name)

    def end_tag(self, name: str) -> None:
        if name == "a":
            self.links = max(0, self.links - 1)
        if name in BLOCKS:
            self.flush()
        elif name in CELLS and not self.stack[-1].dropped:
            self.pieces.append(" ")
        if self.open.get(name):
            self.pop_to(name)
            if name in BLOCKS:
                self.links = 0  # a link that was left open


def best_region(blocks: list[tuple]) -> int:
    """The innermost kind of region that holds any text."""
    return max((b[3] for b in blocks), default=NONE)
