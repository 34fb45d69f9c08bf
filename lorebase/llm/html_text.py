"""The main text of raw web pages, by composite text density.

One pass makes a light tree of the page's elements, with the closing tags that HTML lets authors leave out. A second sums, from the
leaves up, characters, tags, link characters and link tags of each element. An element's density is its characters per tag, adjusted
for links by a logarithm whose base follows the page's share of link characters (held at e at least, so pages almost without links don't blow
it up). The block element with the greatest sum of its children's densities holds the article; the least density on the path from
the body down to it is the threshold for what stands outside of it. Where most of the text is in an <article> (or else in <main>), that
bounds the result; an <article> is taken whole.

What can be told by its element, role or class isn't weighed at all: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments of readers (SKIPPED, SKIPPED_ROLES, SKIPPED_NAMES). A <header> inside an article gives its headings only; what is merely named an article's header stays. A form that
holds an article or a first heading is a wrapper, not a form.

Character references are decoded, white space (as Unicode has it, no-break space included) inside a block becomes one space, <br> is white
space, blocks are trimmed and joined by a newline. A table's row is a block, its cells are not.

Null or empty html, and pages without text, give an empty text. Broken markup is read as far as it goes. Rows are independent: repeated
ids and rows stay, no shuffle; other columns are ignored. Time is linear in the length of the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: HTML's void elements, those whose content is no markup, those that are part of a line, those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Elements that end an open one of the second list, unless one of the third is open inside of it.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, roles and names (parts of class and id) that don't hold the article.
SKIPPED = frozenset("head title script style noscript template iframe object embed applet svg canvas audio video map nav menu header footer aside form button select textarea input dialog fieldset datalist search noembed noframes".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note status".split())
SKIPPED_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promotion banner banners
nav navbar navigation navi menu menus menubar breadcrumb breadcrumbs pagination pager toolbar topbar header masthead footer sidebar sidebars aside rail
cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer warning popup modal overlay paywall
comment comments commentlist disqus respond reply replies discussion feedback
share sharing social related recommended recommendations teaser teasers newsletter subscribe subscription signup login search widget widgets form copyright hidden
""".split())
#: Words of class names that say the next one isn't this element itself.
_NOT_SELF = frozenset("has with no without not show hide".split())
#: Words that make a header the article's own.
_OF_ARTICLE = frozenset("article post entry content story".split())
_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if "=" in text or "hidden" in text.lower() else {}


def _skipped_by_name(a: dict[str, str], in_article: bool) -> bool:
    for names in (a.get("class", ""), a.get("id", "")):
        for name in names.split():
            parts = [x.lower() for x in _NAME_PART.findall(name)]
            for i, x in enumerate(parts):
                before = parts[i - 1] if i else ""
                if x in SKIPPED_NAMES and before not in _NOT_SELF and not (x == "header" and (in_article or before in _OF_ARTICLE)):
                    return True
    return False


class Page:
    """The elements of a page in page order: a parent stands before its children. pieces: (element, block, text), blocks in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.skipped, self.body_like = ["body"], [-1], [False], [False]
        self.pieces: list[tuple[int, int, str]] = []
        self._open, self._counts, self._block, self._html = [0], Counter(), 0, html
        self._read()

    def _read(self) -> None:
        html, at = self._html, 0
        while (m := _MARKUP.search(html, at)) is not None:
            self._text(html[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(name)
                continue
            attributes = m[3] or m[6] or ""
            self._start(name, attributes)
            if name in RAW and not attributes.endswith("/"):
                end = _RAW_END[name].search(html, at)
                at = end.start() if end else len(html)
        self._text(html[at:])

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._open[-1], self._block, entities.unescape(text) if "&" in text else text))

    def _pop(self, n: int = 1) -> None:
        for i in self._open[len(self._open) - n :]:
            self._counts[self.tag[i]] -= 1
            if self.tag[i] not in INLINE:
                self._block += 1
        del self._open[len(self._open) - n :]

    def _pop_to(self, names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Closes the innermost open element of these names, unless one of within is open inside of it."""
        if not any(self._counts[x] for x in names):
            return
        for n, i in enumerate(reversed(self._open[1:]), 1):
            if self.tag[i] in names:
                return self._pop(n)
            if self.tag[i] in within:
                return None

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):
            return
        if name in CLOSES_P and self._counts["p"]:
            self._pop_to(("p",), ("button", "table", "td", "th", "object", "caption"))
        if name in CLOSES:
            self._pop_to(*CLOSES[name])
        if name == "br" or name == "wbr":
            if name == "br":
                self._text(" ")
            return
        if name in ("td", "th"):
            self._text(" ")
        if name not in INLINE:
            self._block += 1
        if name in VOID:
            self._count_void(name)
            return
        up = self._open[-1]
        a = _attributes(attributes)
        skip = self.skipped[up]
        if skip and name in HEADINGS and self._counts["article"] and self._in_header_alone():
            skip = False
        elif not skip:
            skip = name in SKIPPED or a.get("role", "").lower() in SKIPPED_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN_STYLE.search(a.get("style", "")))
            skip = skip or (name != "main" and _skipped_by_name(a, bool(self._counts["article"])) and not (name == "article" and not self._counts["article"] and not self._counts["main"] and "comment" not in a.get("class", "").lower()))
        self.tag.append(name)
        self.parent.append(up)
        self.skipped.append(skip)
        self.body_like.append("articleBody" in a.get("itemprop", ""))
        if not attributes.endswith("/") or name in INLINE or name in CLOSES_P:
            self._open.append(len(self.tag) - 1)
            self._counts[name] += 1

    def _in_header_alone(self) -> bool:
        """Whether a header inside an article is what has the open element left out."""
        for i in reversed(self._open):
            if self.skipped[i] and not self.skipped[self.parent[i]]:
                return self.tag[i] == "header"
        return False

    def _count_void(self, name: str) -> None:
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.skipped.append(self.skipped[self._open[-1]])
        self.body_like.append(False)

    def _close(self, name: str) -> None:
        if not self._counts[name]:
            return
        if name not in INLINE:
            return self._pop_to((name,))
        for n, i in enumerate(reversed(self._open[1:]), 1):
            if self.tag[i] == name:
                return self._pop(n)
            if self.tag[i] not in INLINE:
                return None

    def unwrap_forms(self) -> None:
        """Forms that hold the page's article aren't left out."""
        n = len(self.tag)
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            holds[i] = holds[i] or self.tag[i] in ("article", "main", "h1")
            if holds[i] and self.parent[i] > 0:
                holds[self.parent[i]] = True
        freed = [False] * n
        for i in range(1, n):
            up = self.parent[i]
            if self.skipped[i] and not self.skipped[up] and self.tag[i] == "form" and holds[i]:
                self.skipped[i], freed[i] = False, True
            elif freed[up] and self.skipped[i]:
                self.skipped[i] = self.tag[i] in SKIPPED or self.tag[i] in ("label", "legend")
            freed[i] = freed[i] or (freed[up] and not self.skipped[i])


def _totals(page: Page) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Characters, tags, link characters and link tags of what isn't skipped in each element, and link characters and all characters of the page."""
    n = len(page.tag)
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    chars, tags, link_chars, link_tags, whole = [0] * n, [0] * n, [0] * n, [0] * n, [0, 0]
    for i, _, text in page.pieces:
        c = len("".join(text.split()))
        whole[0] += c if in_link[i] else 0
        whole[1] += c
        if not page.skipped[i]:
            chars[i] += c
            link_chars[i] += c if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if not page.skipped[i]:
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
        elif tags[i]:  # headings of a header that is left out
            tags[up], link_tags[up], chars[up], link_chars[up] = tags[up] + tags[i], link_tags[up] + link_tags[i], chars[up] + chars[i], link_chars[up] + link_chars[i]
    return chars, tags, link_chars, link_tags, whole


def density(chars: int, tags: int, link_chars: int, link_tags: int, page_links: int, page_chars: int) -> float:
    """Characters per tag, by the logarithm of how few of both are links."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + page_links / max(1, page_chars) * chars + math.e)
    return chars / max(1, tags) * math.log(max(1.0, chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / math.log(max(base, math.e))


def _content(page: Page) -> list[bool]:
    """Whether each element's own text is part of the article."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags, whole = _totals(page)
    dense = [density(chars[i], tags[i], link_chars[i], link_tags[i], *whole) for i in range(n)]
    sums = [0.0] * n
    for i in range(n - 1, 0, -1):
        if not page.skipped[i] and page.tag[i] not in INLINE:
            up = page.parent[i]
            while up > 0 and page.tag[up] in INLINE:
                up = page.parent[up]
            sums[up] += dense[i]
    most = max((i for i in range(n) if not page.skipped[i]), key=lambda i: (sums[i], -i))

    def outermost(name: str) -> int:
        found = [i for i in range(1, n) if (page.tag[i] == name or (name == "article" and page.body_like[i])) and not page.skipped[i]]
        best = max(found, key=lambda i: (chars[i], -i), default=-1)
        return best if best > 0 and 2 * chars[best] >= chars[0] else -1

    inside = [False] * n
    root = outermost("article")
    if root < 0:
        root = max(outermost("main"), 0)
        path, i = [most], most
        while i > 0:
            i = page.parent[i]
            path.append(i)
        threshold, on_path = min(dense[i] for i in path), set(path)
        bounded = [i == root for i in range(n)]
        for i in range(n):
            up = page.parent[i]
            bounded[i] = bounded[i] or (i > 0 and bounded[up])
            inside[i] = i == most or (i > 0 and inside[up]) or (bounded[i] and i not in on_path and page.tag[i] not in INLINE and dense[i] >= threshold)
            if i > 0 and not inside[i] and page.tag[i] in INLINE and up in on_path and bounded[i] and dense[i] >= threshold:
                inside[i] = True
    else:
        for i in range(root, n):
            inside[i] = i == root or inside[page.parent[i]]
    return [a and not s for a, s in zip(inside, page.skipped, strict=True)]


def main_text(html: str | None) -> str:
    """The article of a page, one line a block."""
    if not html:
        return ""
    page = Page(html)
    if "form" in page.tag:
        page.unwrap_forms()
    inside = _content(page)
    blocks: dict[int, list[str]] = {}
    for i, block, text in page.pieces:
        if inside[i]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
