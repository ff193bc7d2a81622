"""Operator 4: pages with a known article."""

import html
import re
import time

import pytest

from cairn.llm.html_text import extract, main_text

P = ["Paragraph one of the article, with a comma, and quite some length to it.", "The second paragraph goes on, in another tone, about the same thing.", "Short end."]
PROSE = "".join(f"<p>{x}</p>" for x in P)
WANT = "\n\n".join(P)
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
NOISE = [
    NAV, '<div class="menu"><a href="/x">One</a> <a href="/y">Two</a></div>', "<header><p>Site name, the best site on the web, ever made by anyone.</p></header>", "<footer>&copy; 2024, all rights, and more words, reserved by the owners of this.</footer>",
    '<aside class="sidebar"><p>Something else, that you, dear reader, may like to read as well.</p></aside>', '<div id="cookie-notice"><p>We use cookies, as all sites do, and you should accept them, please.</p></div>',
    '<div class="ad">Buy this, and that, and also this, for a very good price, today only, here.</div>', '<form><p>Your name, your address, your number, and the rest of what we ask.</p><input name="x"></form>',
    '<script>var t = "</p><p>not, a, paragraph, at, all, but, code, in, a, script</p>";</script>', "<style>p{margin:0}</style>", "<!-- <p>hidden, in, a, comment, of, the, page, here</p> -->",
    '<section id="comments"><article class="comment"><p>First, great text, I like it, a lot, thank you, friend.</p></article></section>', '<div class="comment-list"><p>Nice, but, too long, for me, as a reader, of such pages.</p></div>',
    '<div role="complementary"><p>More, from, this, author, and others, of the same kind.</p></div>', '<p hidden>Hidden text, not for, anyone, to see, at any time.</p>', '<div style="display: none"><p>Also hidden, not for, anyone, to see, at any time.</p></div>',
    '<div class="share"><a href="#">Tweet</a><a href="#">Mail</a></div>', "<noscript><p>Please, switch on, the scripts, of your browser, now.</p></noscript>",
]


@pytest.mark.parametrize("body", [
    "<article><h1>T</h1>{p}</article>", "<main><h1>T</h1>{p}</main>", '<div id="content"><h1>T</h1>{p}</div>', '<div class="wrap"><h1>T</h1><div class="text">{p}</div></div>',
    "<article><header><h1>T</h1></header><section>{p}</section></article>", "<table><tr><td><h1>T</h1>{p}</td></tr></table>", '<div class="page-with-sidebar"><article><h1>T</h1>{p}</article></div>',
])
@pytest.mark.parametrize("where", [0, 1])
def test_article_in_noise(body, where):
    inner = body.format(p=PROSE)
    if where:
        page = "<html><head><title>T, and more, of it</title></head><body>" + "".join(NOISE[:6]) + inner + "".join(NOISE[6:]) + "</body></html>"
    else:
        page = "".join(NOISE) + inner
    assert main_text(page) == "T\n\n" + WANT


def test_noise_inside_the_article():
    page = "<article><h1>T</h1>" + "".join(NOISE).join(f"<p>{x}</p>" for x in P) + "</article>"
    assert main_text(page) == "T\n\n" + WANT


@pytest.mark.parametrize("page", [
    "<article>{a}<section id='discussion'>{b}</section></article>", "<article>{a}<section id='related-work'>{b}</section></article>", "<article>{a}<div id='notice-of-results'>{b}</div></article>",
    "<article class='post comments-open'>{a}{b}</article>", "<div class='content has-comments'>{a}{b}</div>", "<div id='content'>{a}<section id='discussion'>{b}</section></div>",
    "<div><section>{a}</section><section>{b}</section></div>", "<body><div>{a}</div><div>{b}</div></body>", "<article>{a}<div class='feedback-loops'>{b}</div></article>",
])
def test_names_that_only_look_like_noise(page):
    long = [f"Paragraph {i} of the long part, with a comma, another, and quite some length to it, so that it has points." for i in range(12)]
    a, b = "<h1>T</h1>" + "".join(f"<p>{x}</p>" for x in long), "<h2 id='discussion'>Discussion</h2><p>A short part.</p>"
    page = NAV + page.format(a=a, b=b) + NOISE[3] + '<div id="comments-area"><p>First, great text, I like it, a lot, friend.</p></div>'
    assert main_text(page) == "\n\n".join(["T", *long, "Discussion", "A short part."])


def test_blocks_and_references():
    page = "<article><p>A &amp; B &lt;x&gt;,\n\t two&nbsp;&eacute; &#233;<br>next <b>bold</b><i>er</i> <a href='/x'>link</a>.<p>Open, paragraph, without, an end<ul><li>one<li>two, three</ul><pre>a\n b</pre><blockquote>Quote, here, it is.</blockquote></article>"
    assert main_text(page) == "A & B <x>, two é é next bolder link.\n\nOpen, paragraph, without, an end\n\none\n\ntwo, three\n\na b\n\nQuote, here, it is."


@pytest.mark.parametrize("page", [None, "", " ", "<!--", "<html></html>", "<script>x", "<p></p>", "<nav>a</nav>"])
def test_no_text(page):
    assert main_text(page) == ""


def test_broken_and_long_pages():
    assert main_text("<p>Only, a, paragraph, that, is, never, closed <b>and cut of") == "Only, a, paragraph, that, is, never, closed and cut of"
    assert main_text("just text") == "just text"
    assert main_text('<p title="a > b">1 < 2, and 3 > 2, as, everyone, knows, by, now</p>') == "1 < 2, and 3 > 2, as, everyone, knows, by, now"
    for page in ("<div>" * 100_000 + "deep, text", "<p>word, " * 50_000, "<a title=\"" * 50_000, "<" * 100_000, "<li>" * 50_000, "<!--" * 50_000, "<script>" * 20_000, "&" * 100_000, "<table>" * 30_000 + "<td>" * 30_000):
        t = time.time()
        main_text(page)
        assert time.time() - t < 20
    long = "<article>" + "".join(f"<p>Paragraph {i}, of many, in a long, long page.</p>" for i in range(20_000)) + "</article>"
    assert main_text(long).count("\n\n") == 19_999


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", "<p>same, same, same, same, same, same</p>", "y"), (2, None, "", "z")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got == [(1, "", 0), (1, "same, same, same, same, same, same", 38 - 4), (2, "", 0)]
    clash = spark.createDataFrame([(1, "u", "<p>a, b, c, d</p>", 7)], "page_id long, url string, html string, n_chars int")
    assert [tuple(r) for r in extract(clash).collect()] == [(1, "u", "a, b, c, d", 10)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
