"""Main texts: the style tree against a plain merge of all pages, sites without any marks, odd markup and odd rows."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from verbena.llm.maintext import GAMMA, PAGES, Page, _seed, main_texts

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()


def sentence(r, n=12):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def site(host, n, r, content="div", menu="div"):
    """Pages without a mark in names or classes: a menu, a column of offers, a text, a last line."""
    same = [sentence(r, 3) for _ in range(4)]
    out = []
    for i in range(n):
        paragraphs = [sentence(r) for _ in range(r.randrange(1, 6))]
        body = f"<{menu} class=x1>" + "".join(f"<div>{s}</div>" for s in same) + f"</{menu}>"
        body += f"<{content} class=x2><h2>{i} {paragraphs[0]}</h2>" + "".join(f"<p>{p}" for p in paragraphs) + f"</{content}><div class=x3>Offers of {host}, page {i}<p>All about {host}</div>"
        out.append((f"https://{host}/{i}", f"<html><body>{body}</body></html>", "\n\n".join([f"{i} {paragraphs[0]}", *paragraphs])))
    return out


def plain(rows):
    """The same weights by dictionaries, then each page's text."""
    layouts, texts, seen = defaultdict(Counter), defaultdict(Counter), set()
    for url, html in rows:
        host = (url or "").split("/")[2] if url else ""
        if not html or (host, html) in seen:
            continue
        seen.add((host, html))
        laid, held = defaultdict(set), set()
        for node, layout, own in Page(html, _seed(host)).nodes():
            laid[node].add(layout)
            if own:
                held.add((node, re.sub(r"\d+", "0", own.lower())))
        for node, styles in laid.items():
            layouts[node][frozenset(styles)] += 1
        for node, text in held:
            texts[node][text] += 1
    weights = {}
    for node, counts in layouts.items():
        n = sum(counts.values())
        if n >= PAGES:
            entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) / math.log2(n)
            held = texts[node]
            content = 1 - sum(math.log2(c) for c in held.values()) / len(held) / math.log2(n) if held else None
            weights[node - 2**64 if node >= 2**63 else node] = (entropy, len(counts), content)
    return ["" if not html else Page(html, _seed((url or "").split("/")[2] if url else "")).text(weights) for url, html in rows]


def test_sites_without_marks(spark):
    r = random.Random(3)
    pages = site("a.example", 40, r) + site("b.example", 9, r, "section", "table") + site("small.example", PAGES - 1, r)
    pages += [pages[0]] * 30  # copies count once
    rows = [(i, u, h) for i, (u, h, _) in enumerate(pages)]
    got = {p["page_id"]: p["main_text"] for p in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(rows))] == plain([(u, h) for _, u, h in rows])
    for i, (u, _, want) in enumerate(pages):
        assert (got[i] == want) == ("small" not in u)


def test_what_elements_say_of_themselves():
    html = """<!doctype html><html><head><title>T</title><style>p{}</style><body class="has-sidebar"><div id="cookieNotice">We use cookies</div>
    <header><h1>Site</h1></header><nav>Menu</nav><form action=x>Search<input></form><main><article><header><h1>Title &amp; more</h1></header>
    <p>One&nbsp;two <b>three<br>four<p>Five &lt;six&gt; <script>var x="</p>";</script><ul><li>a<li>b</ul><aside>See too</aside>
    <div class="social-share">Share</div><blockquote>Quote</blockquote><footer>By me</footer></article>
    <section class="comments"><article class="comment"><p>First!</article></section></main><div hidden>x</div><div style="display: none">y</div><footer>Imprint</footer>"""
    assert Page(html, 1).text({}).split("\n\n") == ["Title & more", "One two three four", "Five <six>", "a", "b", "Quote"]
    marked = """<div id="page-header"><h1>Site</h1></div><div class="leftSide">More</div><div class="post"><div class="post-header"><h1>Own title</h1></div><p>Text <span class="ad">Buy</span>goes <b hidden>x</b>on</p>
    <div class="alert">Closed today</div><div class="adBox">Buy</div><div id="toc">1 2 3</div><p class="lead">End</p><div class="reader-comments"><p>First!</p></div></div>"""
    assert Page(marked, 1).text({}).split("\n\n") == ["Own title", "Text goes on", "End"]
    assert Page("<form><nav><ul><li>never closed<article><h1>A</h1>b</article>", 1).text({}) == "A\n\nb"
    assert Page("<body><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>Text with <a>a link</a>", 1).text({}) == "Text with a link"
    assert Page("no markup < at all &copy; <", 1).text({}) == "no markup < at all © <"
    assert Page("<p>cut off <a href='x", 1).text({}) == "cut off"


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x" + "</i>" * 50_000, '<a "' * 50_000, "<a ='\"" * 50_000 + ">", "<p>" + "<b>" * 30_000 + "<div>" * 30_000, "<!--" * 50_000, "&" * 200_000])
def test_hostile_markup_takes_no_long_time(html):
    start = time.perf_counter()
    Page(html, 1).text({})
    assert time.perf_counter() - start < 10


def test_odd_rows(spark):
    """Null and empty pages have no text, a null url is a host of its own, columns may have any names, very long texts stay whole."""
    long = " ".join(WORDS * 20_000)
    rows = [(1, None, "<p>a", "x"), (1, "http://h/", None, None), (None, "http://h/", "", "y"), (1, None, "<p>a", "x"), (2, "nonsense", f"<article>{long}</article>", "")]
    df = spark.createDataFrame(rows, "key long, url string, html string, weights string")
    got = sorted((r["main_text"] for r in main_texts(df).collect()), key=len)
    assert got == ["", "", "a", "a", long]
    assert main_texts(df).columns == [*df.columns, "main_text"]
    assert main_texts(df.limit(0)).count() == 0
    assert GAMMA < 1
