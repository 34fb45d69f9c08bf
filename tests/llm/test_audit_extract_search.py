"""Filter audit, HTML extraction and lexical search against brute force, with nulls, empty, long and repeated rows and clashing columns."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from html.parser import HTMLParser
from itertools import permutations

import pytest
from lorebase.llm import filter_audit, html_text, lexical_search
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASHES = ["mask", "part", "known", "good", "toxic", "least", "first", "n", "c", "s", "e", "bit", "applied", "item", "item_id", "score", "rank", "r", "terms", "tfs", "term", "task_group", "kept", "text_key", "html", "page_id"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})


# filter audit


def audit_by_hand(docs, labels):
    good, toxic = ({i for i, *l in labels if l[at] == 1 and i is not None} for at in (0, 1))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        ws = WORDS.findall(t)
        copy = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in docs)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        rows.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone), f)
                shapley[part, f] += len(gone)
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def test_filter_audit(spark):
    r = random.Random(5)
    texts = [None, "", " \n", "a # b", "UP low", "w " * 300, " ".join(map(str, range(250))), " ".join(f"v{i}" for i in range(250)) + " %", "é" * 40, "x\x1cy b\x85c " * 120, "Z" * 100_000]
    docs = [(r.choice([None, *range(20)]), r.choice(texts), r.choice(["en", "de", None, ""])) for _ in range(150)] + [(50 + i, "copy # of one text", "en") for i in range(60)]
    labels = [(r.choice([None, *range(80)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(70)]
    df, lf = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.filter_audit(clashing(df), clashing(lf.withColumnRenamed("toxic", "tox")).drop("toxic").withColumnRenamed("tox", "toxic"))
    got = {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for x in out.collect()}
    assert got == audit_by_hand(docs, labels)
    assert len(got) == out.count() == 600 * 3
    assert filter_audit.filter_audit(df.limit(0), lf).count() == 0
    assert filter_audit.filter_audit(df, lf.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


# lexical search


def terms(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERMS.findall(t or "")]


def search_by_hand(docs, items, k):
    docs = [(i, c) for i, t in docs if (c := Counter(terms(t)))]
    n_docs, n_all = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item_id, text in items:
        found = []
        for i, c in docs:
            m = 75 + 25 * c.total() * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item_id, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block_terms, block_postings, parts", [(1_000_000, 2_000_000, 3), (7, 5, 5)])
def test_lexical_search(spark, monkeypatch, block_terms, block_postings, parts):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", block_postings)
    r = random.Random(7)
    words = ["a", "A", "Be", "é", "É", "日本", "x1", "café", "zz", "\x1c", "-", "q_q", "the", "The"]
    text = lambda n: r.choice([" ", "\n", "."]).join(r.choice(words) for _ in range(r.randint(0, n)))
    docs = [(r.choice([None, *range(40)]), r.choice([None, text(30)])) for _ in range(120)] + [(100 + i, "the same text") for i in range(30)] + [(200, "the " * 20_000 + "zz")]
    items = [(r.choice([None, *range(9)]), r.choice([None, "", "--", text(8)])) for _ in range(25)] + [(77, "the the same a")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(x) for x in lexical_search.ranked_search(clashing(df.drop("item_id")), clashing(it), 5).select("item_id", "rank", "doc_id", "score").collect())
    assert got == search_by_hand(docs, items, 5)
    assert lexical_search.ranked_search(df.limit(0), it).count() == 0
    assert lexical_search.ranked_search(df, it.limit(0)).count() == 0


def test_lengths_beyond_64_bits():
    import numpy as np

    assert lexical_search.lengths(np.array([10**7, 3]), 5 * 10**10, 10**12).tolist() == [75 + 25 * 10**7 * 5 * 10**10 // 10**12, 75 + 25 * 3 * 5 * 10**10 // 10**12]


# HTML extraction


def test_sample_pages(spark):
    """The sample's pages are an <article> of h1 and p elements; cut by pattern here."""
    out = html_text.extract_pages(clashing(spark.read.parquet(f"{SF}/pages.parquet"))).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


A, B, C = "The first paragraph of the story goes on for a while, long enough to be read.", "Second, it says more & more things about them, and then some more of it.", "In the end it stops, as all stories do, here with a last long sentence of its own."
WANT = f"Title\n{A}\n{B}\n{C}"
BODY = f"<p>{A}</p><p>{B.replace('&', '&amp;')}</p><p>{C}</p>"
MENU = "".join(f"<li><a href='/{i}'>Item {i}</a>" for i in range(9))
TEMPLATES = {
    "article": f"<html><head><title>Title - site</title></head><body><header><h2>Site</h2></header><nav><ul>{MENU}</ul></nav><article><h1>Title</h1>{BODY}</article><footer>&copy; all rights</footer></body></html>",
    "divisions": f"<body><div id=top-menu>{MENU}</div><div id='content'><h1>Title</h1>{BODY}</div><div class='sidebar'><p>{A}</p></div><div id=footer>about us and contact</div>",
    "plain menus": f"<body><div><ul>{MENU}</ul></div><div><h1>Title</h1>{BODY}</div><div><ul>{MENU}</ul></div></body>",
    "comments": f"<main><h1>Title</h1>{BODY}<section class='comments'><article class='comment'><p>{A}</p><p>{B}</p></article><article class=comment><p>{C}</p></article></section></main>",
    "notices": f"<div class='cookie-notice'><p>{A}</p><p>{B}</p></div><article><h1>Title</h1><aside>{BODY}</aside>{BODY}<div class=ad>{A}</div><form><label>Mail</label><input></form></article>",
    "raw": f"<article><script>var a='<p>x</p>';if(a<b)c()</script><style>p{{}}</style><!-- <p>no</p> --><h1>Title</h1>{BODY}<noscript>{A}</noscript></article>",
    "unclosed": f"<body><article><h1>Title</h1><p><b>{A}<br><p>{B}<p>{C}",
    "upper case": f"<BODY><ARTICLE><H1>Title</H1>{BODY.replace('<p>', '<P CLASS=x>').replace('</p>', '</P>')}</ARTICLE><NAV>menu</NAV></BODY>",
    "header in article": f"<article><header><h1>Title</h1><span>By someone</span></header>{BODY}<footer>Filed under this</footer></article>",
    "named header": f"<div class=page-header>Site</div><div class=post><div class='post-header'><h1>Title</h1></div>{BODY}<div class='post-footer'>Tags</div></div>",
    "header in article by name": f"<article><div class=header><h1>Title</h1></div>{BODY}</article>",
    "form around all": f"<form id=aspnet><nav>{MENU}</nav><article><h1>Title</h1>{BODY}</article><label>Search</label><input><select><option>x<option>y</select></form>",
    "white space": f"<article>\n <h1>\n Title\t</h1>{BODY.replace(' ', chr(10) + ' &#32;')}\n<p> &nbsp; </p></article>",
    "attributes": f"<article data-x='a>b' title=\"</article>\"><h1 class=has-sidebar>Title</h1>{BODY}</article>",
    "hidden": f"<article><h1>Title</h1><div hidden>{A}</div><p style='display: none'>{B}</p><p aria-hidden=true>{C}</p>{BODY}</article>",
    "sections": f"<div class=post><h1>Title</h1><div><p>{A}</p></div><div><p>{B.replace('&', '&amp;')}</p><p>{C}</p></div></div><div id=related>{BODY}</div>",
}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_templates(name):
    assert html_text.main_text(TEMPLATES[name]) == WANT


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<article>a<b>b</b> c<br>d</article>", "ab c d"), ("<article><p>x &lt;b&gt; &amp;amp; &#233; &eacute &bogus; 1 < 2</p></article>", "x <b> &amp; é é &bogus; 1 < 2"),
    ("<article><ul><li>one<li>two<ul><li>three</ul><li>four</ul></article>", "one\ntwo\nthree\nfour"), ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b\nc"), ("<article><p>a</p>b<p>c</article>", "a\nb\nc"), ("<article>a<script>", "a"), ("<article>a<", "a<"),
    ("<article><p>a b c\x1cd</p></article>", "a b c d"),
])
def test_pieces_of_pages(page, want):
    assert html_text.main_text(page) == want


def test_rows_of_pages(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<article>x</article>"), (1, "u", "<article>x</article>")], "page_id long, url string, html string")
    assert Counter(map(tuple, html_text.extract_pages(clashing(df)).collect())) == Counter([(None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)])
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_long_pages():
    many = "".join(f"<p>{A} {i}</p>" for i in range(20_000))
    assert html_text.main_text(f"<body>{many}</body>").count("\n") == 19_999
    assert html_text.main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert html_text.main_text("</p></div>" * 50_000 + "<b>" * 50_000 + "x") == "x"


class Tree(HTMLParser):
    """Well-formed pages as nested lists (tag, children)."""

    def __init__(self, page):
        super().__init__()
        self.root = ("body", [])
        self.open = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open[-1][1].append((tag, []))
        self.open.append(self.open[-1][1][-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def measures(node, in_link=False):
    """(characters, tags, link characters, link tags) by the definitions, by recursion."""
    link = in_link or node[0] == "a"
    total = [0, 0, 0, 0]
    for x in node[1]:
        if isinstance(x, str):
            n = len(re.sub(r"\s", "", x))
            total[0] += n
            total[2] += n * link
        else:
            c, t, lc, lt = measures(x, link)
            total = [total[0] + c, total[1] + t + 1, total[2] + lc, total[3] + lt + (x[0] == "a")]
    return total


def text_by_hand(page):
    root = Tree(page).root
    whole = measures(root)

    def dense(node):
        c, t, lc, lt = measures(node)
        if not c:
            return 0.0
        base = max(math.e, math.log(c / max(1, c - lc) * lc + whole[2] / max(1, whole[0]) * c + math.e))
        return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base)

    blocks = []

    def walk(node, path):
        blocks.append((node, path))
        for x in node[1]:
            if not isinstance(x, str) and x[0] != "a":
                walk(x, [*path, node])

    walk(root, [])
    sums = [sum(dense(x) for x in n[1] if not isinstance(x, str) and x[0] != "a") for n, _ in blocks]
    most, path = blocks[max(range(len(blocks)), key=lambda i: (sums[i], -i))]
    path = [*path, most]
    threshold = min(dense(n) for n in path)
    lines, line = [], []

    def cut():
        lines.append(" ".join("".join(line).split()))
        line.clear()

    def emit(node, inside):
        for x in node[1]:
            if isinstance(x, str):
                if inside:
                    line.append(x)
            elif x[0] == "a":
                emit(x, inside or (any(x is n for n in path)) or (any(node is n for n in path) and dense(x) >= threshold))
            else:
                cut()
                emit(x, inside or x is most or (not any(x is n for n in path) and dense(x) >= threshold))
                cut()

    emit(root, root is most)
    cut()
    return "\n".join(x for x in lines if x)


def test_density_by_definition():
    r = random.Random(11)
    word = lambda: "w" * r.randint(1, 9)

    def make(depth):
        kind = r.random()
        if depth == 0 or kind < 0.25:
            return "<p>" + " ".join(word() for _ in range(r.randint(0, 40))) + "</p>"
        if kind < 0.45:
            return "<ul>" + "".join(f"<li><a>{word()}</a></li>" for _ in range(r.randint(0, 6))) + "</ul>"
        return "<div>" + "".join(make(depth - 1) for _ in range(r.randint(0, 5))) + "</div>"

    for _ in range(300):
        page = "".join(make(3) for _ in range(r.randint(1, 4)))
        assert html_text.main_text(page) == text_by_hand(page), page
