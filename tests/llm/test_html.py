import random
import re
import time
from html import escape

import pyarrow.parquet as pq
import pytest

from glossa.llm import html_text
from glossa.llm.html_text import extract_text, main_text

ARTICLE = "<article><h1>Head &amp; line</h1><p>One\n two<br>three<p>Short.</p><div class='ad-box'>Buy</div><p>Last <span class=ad>x</span>word &copy</article>"
LONG = "Words that go on for a good while, so that the sum of the lengths surges past the threshold."


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain text only", "plain text only"), ("a < b", "a < b"),
    (f"<nav>Menu<ul><li>a</ul></nav>{ARTICLE}<footer>Foot</footer>", "Head & line\n\nOne two three\n\nShort.\n\nLast word ©"),
    (f"<nav>Menu {ARTICLE}", "Head & line\n\nOne two three\n\nShort.\n\nLast word ©"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>cut off</p><p cla", "cut off"), ("<article>a<script>if (a<b) '</p>'</script>b</article>", "ab"),
    ("<main><h1>T</h1><section id=comments><p>Nice!</p></section><p>x</p></main>", "T\n\nx"), ("<article><!-- <p>no</p> --><p title='a>b'>yes</p></article>", "yes"),
    (f"<header>Site</header><div><p>{LONG}</p><p>Tiny.</p></div><div class=sidebar><p>{LONG}</p></div><form><p>{LONG}</p></form>", f"{LONG}\n\nTiny."),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"), ("<article><p>&lt;b&gt; &#233; &nbsp;x</p></article>", "<b> é x"),
    ("<article><p class=notice>n<p>kept</article>", "kept"), ("<article><p>" + "w " * 50_000 + "</article>", ("w " * 50_000).strip()),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_query(spark):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 47, 47]
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    (f"<div><p>{LONG}</p></div><aside><article>teaser</article></aside>", LONG), (f"<main><p>{LONG}</p></main><aside><article>teaser</article></aside>", LONG),
    (f"<nav><article>teaser</article></nav><main><p>{LONG}</p></main>", LONG), (f"<nav>Menu <article><p>{LONG}</p></article><nav>x</nav>", LONG),
    (f"<form><article><p>{LONG}</p></article></form>", LONG), (f"<div><p>{LONG}</p></div><article><p>Short note</p></article>", f"{LONG}\n\nShort note"),
    (f"<h1>T</h1><p>a</p><p>b</p><p>c</p><p>{LONG}</p>", f"T\n\na\n\nb\n\nc\n\n{LONG}"), (f"<div><p>{LONG}</p>" + "<p><a href=x>link</a></p>" * 4 + "</div>", LONG),
    (f"<p>{LONG}</p>" + "<p><a href=x>menu</a></p>" * 3 + "<p>tail</p>", LONG), (f"<p>{LONG}</p>" + "<p><a href=x>menu</a></p>" * 2 + "<p>tail</p>", f"{LONG}\n\ntail"),
])
def test_sums_choose_the_range(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p>One short.</p></article><p>x</p><article><p>Another one.</p></article>", "One short.\n\nAnother one."),
    (f"<article><p>{LONG}</p><ul>" + "".join(f"<li><a href=x>{x}</a>" for x in "abcd") + f"</ul><p>{LONG}</p></article>", f"{LONG}\n\na\n\nb\n\nc\n\nd\n\n{LONG}"),
    (f"<article><p>{LONG}</p><p><a href=x>{LONG}</a></p></article>", f"{LONG}\n\n{LONG}"), (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n\n{LONG}"),
    (f"<main><h2 id=related>Related work</h2><p>{LONG}</p></main>", f"Related work\n\n{LONG}"), (f"<main><h2 id=comments>Comments on this</h2><p>{LONG}</p></main>", f"Comments on this\n\n{LONG}"),
    (f"<main><section id=search><h2>Search</h2><p>{LONG}</p></section></main>", f"Search\n\n{LONG}"), (f"<header><h1>Site</h1></header><main><p>{LONG}</p><div class=related>more</div><footer>f</footer></main>", LONG),
    (f"<main><p>{LONG}</p><div id=comments><p>{LONG}</p></div></main>", LONG), (f"<div id=search><p>{LONG} q</p></div><main><p>{LONG}</p></main>", LONG),
])
def test_an_article_keeps_what_is_not_marked(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_windows_against_a_plain_version(monkeypatch, block):
    monkeypatch.setattr(html_text, "BLOCK", block)
    rnd = random.Random(block)
    for _ in range(400):
        sizes = [rnd.choice((0, 0, 3, 20, 60)) for _ in range(rnd.randint(0, 25))]
        surge = rnd.choice((0, 10, 50, 80))
        sums = [sum(sizes[i : i + block]) for i in range(len(sizes))]
        assert html_text.window_sums(sizes) == sums
        want = [False] * len(sizes)
        for i in range(len(sizes)):  # runs of windows that are not empty, each from its first surge on
            if sums[i] > surge:
                lo = i
                while lo and sizes[lo - 1]:
                    lo -= 1
                hi = i
                while hi < len(sizes) and sums[hi]:
                    hi += 1
                for k in range(lo, hi):
                    want[k] = sizes[k] > 0
        assert html_text.between_surge_and_dive(sizes, surge) == want


def test_windows_alone_find_the_article_of_given_pages():
    """With the element's name taken away the windows give the same text on all pages."""
    pages = [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    bare = [re.sub(r"(</?)article\b", r"\1div", p) for p in pages]
    assert [main_text(p) for p in pages] == [main_text(p) for p in bare] and all(map(main_text, pages))


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><p hidden>{LONG}</p><p class='social-science'>a</p><p id=related-work>b</p></article>", f"{LONG}\n\na\n\nb"),
    (f"<div class='content with-sidebar'><p>{LONG}</p></div>", LONG), (f"<div class='cookie-banner'>{LONG}</div><div id=sidebar-left><p>{LONG}</p></div><p>{LONG} x</p>", f"{LONG} x"),
    (f"<div><p>{LONG}</p></div><section id='comments'><article id='reply-12'><p>{LONG}</p></article>", LONG), (f"<main><p>{LONG}</p></main><article class='comment'><p>Nice</p></article>", LONG),
    (f"<div class=sidebar><article>{LONG} y</article></div><div><p>{LONG}</p></div>", LONG), (f"<div class=menu><div id=page><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='nav-container'><article><p>{LONG}</p></article></div>", LONG), (f"<ul><li><a href=x>{LONG}</a></ul><p>{LONG}</p>", LONG),
])
def test_marked_parts(page, text):
    assert main_text(page) == text


def test_pages_put_together(spark):
    """Random pages around a known article, with and without an element of its own, give that article back."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abdeilnorstu&<é日") for _ in range(rnd.randint(1, 9)))
    said = lambda lo, hi: " ".join(word() for _ in range(rnd.randint(lo, hi)))
    aside = [
        lambda: "<nav><ul>" + "".join(f"<li><a href='/{i}'>{escape(said(1, 3))}</a></li>" for i in range(rnd.randint(1, 9))) + "</ul></nav>",
        lambda: f"<div class='{rnd.choice(['ad', 'ad-box', 'cookie-banner', 'share', 'sidebar right'])}'><p>{escape(said(20, 90))}</p></div>",
        lambda: f"<aside><p>{escape(said(20, 90))}</p></aside>", lambda: f"<form><p>{escape(said(20, 60))}</p><input name=q></form>", lambda: "<script>if (a<b) { x('</p>') }</script><style>p{}</style>",
        lambda: f"<!-- <p>{said(20, 40)}</p> -->", lambda: f"<section id=comments><p>{escape(said(20, 60))}</p></section>",
    ]
    for _ in range(300):
        parts = [said(15, 120) for _ in range(rnd.randint(1, 8))]
        body = "".join(f"<p{rnd.choice(['', ' class=x', ' hidden'])}>{escape(p).replace(' ', rnd.choice([' ', '  ', chr(10), '<br>']))}" + rnd.choice(["</p>", ""]) for p in parts)
        for part in range(rnd.randint(0, 2)):
            body += "" if not part else rnd.choice(aside[1:])()
        tag = rnd.choice(["article", "main", "div", "div class=content"])
        page = "<html><head><title>t</title></head><body>" + "".join(rnd.choice(aside)() for _ in range(rnd.randint(0, 4))) + f"<{tag}>{body}</{tag.split()[0]}>" + "".join(rnd.choice(aside)() for _ in range(rnd.randint(0, 4))) + "<footer>f</footer></body></html>"
        assert main_text(page) == "\n\n".join(" ".join(p.split()) for p in parts), page


def test_time_grows_with_the_length_alone():
    def took(n):
        t = time.perf_counter()
        main_text("<section><p>some text here</p></b></section2>" * n + f"<nav><article><p>{LONG}</p></article></nav>" * 3)
        return time.perf_counter() - t

    took(500)
    assert took(16_000) < 30 * took(1_000) + 0.5
