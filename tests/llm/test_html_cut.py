"""Pages with known articles, and cuts against every labelling."""

import itertools
import random
import time

import pytest

from bugloom.llm import html_cut as hc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><p>My great site, since 1999.</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and we like them. Do you?</p></div>
%s
<aside><h3>Popular</h3><p>Another story that you may like to read.</p></aside>
<form><label>Search</label><input name="q"><button>Go</button></form>
<section id="comments"><h2>Comments</h2><p>I do not agree with this at all!</p></section>
<footer>&copy; 2024 My site &middot; All rights reserved.</footer><script>var t="</p>";</script></body></html>"""
TEXT = ["The Title &amp; more", "First paragraph,\n   with <b>bold</b> and <a href='x'>a link</a>.",
        "Second&nbsp;one; 1 &lt; 2.", "Short."]
WANT = "The Title & more\nFirst paragraph, with bold and a link.\nSecond one; 1 < 2.\nShort."


@pytest.mark.parametrize("opened, closed", [
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"),
    ("<div id='wrap'><div><article class=post>", "</article></div></div>"), ("<article>", ""),
])
def test_article_alone_is_kept(opened, closed):
    body = f"<h1>{TEXT[0]}</h1>" + "".join(f"<p>{t}</p>" for t in TEXT[1:])
    if not closed:
        opened, closed = opened, "</article>"
        body = body.replace("</p>", "")
    assert hc.main_text(PAGE % (opened + body + closed)) == WANT


def test_parts_inside_an_article():
    inside = (
        "<article><header><h1>Head line</h1></header><p>One sentence is here.</p>"
        '<div class="ad">Buy this now, it is great.</div><!-- <p>no</p> --><ul><li>First item'
        "<li>Second item</ul><p>Line<br>break</p><noscript>Enable it.</noscript>"
        "<blockquote>Said someone.</blockquote><footer>Tags: a, b</footer></article>"
    )
    assert hc.main_text(PAGE % inside) == (
        "Head line\nOne sentence is here.\nFirst item\nSecond item\nLine break\nSaid someone."
    )


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), (" \n", ""), ("<nav><a>x</a></nav>", ""), ("<p>a < b & c</p>", "a < b & c"),
    ("<p>broken <b", "broken <b"), ("<article><p>x<!-- never closed", "x"),
    ("<article><p title='a > b'>quoted</p></article>", "quoted"),
    ("<article>&#x41;&#66;&eacute;&nosuch;</article>", "ABé&nosuch;"),
])
def test_odd_pages(html, text):
    assert hc.main_text(html) == text


@pytest.mark.parametrize("html", [
    "<div>" * 50_000 + "x", "<p>word " * 50_000, "<a <a " * 50_000, '<a "' * 100_000, "<" * 100_000,
    "</div>" * 100_000, "<td>a</td>" * 30_000, "<!--" * 50_000, "<b><p>x" * 20_000,
    "<div><b></i>" * 20_000, "&" * 200_000,
])
def test_very_long_pages_take_no_time(html):
    began = time.process_time()
    hc.main_text(html)
    assert time.process_time() - began < 20


def test_cut_is_the_least_of_all():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 7)
        weights = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 2, 3]) for _ in range(n)]
        edges = [(a, b, rng.choice([0.5, 1, 2])) for a, b in itertools.combinations(range(n), 2)
                 if rng.random() < 0.6]

        def cost(label):
            return sum(
                max(0, w) if not x else max(0, -w) for w, x in zip(weights, label)
            ) + sum(c for a, b, c in edges if label[a] != label[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(hc.minimum_cut(weights, edges)) == pytest.approx(best)


def test_neighbours_decide_on_weak_blocks():
    assert hc.minimum_cut([3, -0.4, 3], [(0, 1, 1), (1, 2, 1)]) == [True, True, True]
    assert hc.minimum_cut([-3, 0.4, -3], [(0, 1, 1), (1, 2, 1)]) == [False, False, False]


def test_table(spark):
    page = PAGE % f"<article><p>{TEXT[3]}</p></article>"
    rows = [(1, "u", page, "old", 5), (1, "u", page, "old", 5), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, more int")
    got = hc.extracted(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["more"] or 0) for r in got) == [
        (0, "", 0, 0), (1, "Short.", 6, 5), (1, "Short.", 6, 5)
    ]
    assert hc.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html, text", [
    ('<p>One <svg class="i"/> two.</p><p>Three.</p>', "One two.\nThree."),
    ("<p>One <svg/> two.</p><p>Three <SVG><title>no</title><path d='M0'/></SVG >more.</p>", "One two.\nThree more."),
    ("<p>One <math/> two.</p><p>Three.</p>", "One two.\nThree."),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p><p>So.</p>", "Let x=1 hold.\nSo."),
    *[(f"<p>One <{t} a='/'> two.</p><p>Three.</p>", "One two.\nThree.") for t in ("object", "video", "audio", "canvas", "svg", "math")],
    *[(f"<p>One <{t}><p>no</p></{t}> two.</p><p>Three <{t}>.</p>", "One two.\nThree .") for t in ("object", "video", "audio", "canvas", "svg")],
    ("<p>One <iframe src='x'>no</iframe> two.</p>", "One two."),
])
def test_only_embedded_elements_are_dropped(html, text):
    assert hc.main_text(f"<article>{html}</article>") == text


@pytest.mark.parametrize("html", [
    "<svg>" * 100_000, "<video><svg/>" * 50_000, "<svg></svg>" * 50_000, "<math>x" * 50_000,
    "<svg>" + "<object>" * 100_000 + "</svg>", "<svg></object>" * 50_000,
])
def test_embedded_elements_take_no_time(html):
    began = time.process_time()
    hc.main_text(html)
    assert time.process_time() - began < 20


TWO = "<p>The first plain paragraph of it.</p><p>The second plain paragraph of it.</p>"
TWO_TEXT = "The first plain paragraph of it.\nThe second plain paragraph of it."


@pytest.mark.parametrize("body", [
    f'<article class="overflow-hidden">{TWO}</article>',
    f'<div class="overflow-hidden"><article>{TWO}</article></div>',
    f'<div class="page has-sidebar"><article>{TWO}</article></div>',
    f'<div aria-hidden="false"><article>{TWO}</article></div>',
    f'<div data-id="comment"><article>{TWO}</article></div>',
    f'<div title="class=ad hidden"><article>{TWO}</article></div>',
    f'<div id="search-results-related"><main>{TWO}</main></div>',
    f'<div class="comments"><main>{TWO}</main></div>',
    f'<article>{TWO.replace("<p>", "<p class=share-price>")}</article>',
    f'<article class="is-hidden-mobile">{TWO}</article>',
    f'<div class="no-sidebar js-modal"><div class="story">{TWO}</div></div>',
])
def test_names_that_say_nothing_of_the_article(body):
    assert hc.main_text(PAGE % body) == TWO_TEXT


@pytest.mark.parametrize("opened, closed", [
    ("<form method=post action='/'>", "</form>"), ('<div class="modal">', "</div>"),
    ('<form id=f><div class="search">', "</div></form>"), ('<div id="header">', "</div>"),
])
def test_an_element_around_the_page_is_no_boilerplate(opened, closed):
    inside = f"<h1>A head line</h1>{TWO}"
    nav = '<div class="nav"><a href="/a">Home</a></div><div class=ad><p>Buy this now.</p></div>'
    want = f"A head line\n{TWO_TEXT}"
    assert hc.main_text(f"<body>{opened}{nav}<article>{inside}</article>{closed}</body>") == want
    assert hc.main_text(f"<body>{opened}{nav}<div>{inside}</div>{closed}</body>") == want


@pytest.mark.parametrize("part", [
    f'<section class="comments-area">{TWO * 20}</section>', f'<div id="sidebar-left">{TWO}</div>',
    f'<div class="ad-slot">{TWO}</div>', f'<div class="cookie-notice-2">{TWO}</div>',
    f'<form class="contact">{TWO}</form>', f"<div hidden>{TWO}</div>", f"<div hidden=''>{TWO}</div>",
    f'<div aria-hidden="true">{TWO}</div>', f'<div style="color:red; display : none">{TWO}</div>',
    f'<div class="related-posts"><article>{TWO}</article></div>', f"<nav>{TWO}</nav>",
    f'<section id="comments"><article class="comment">{TWO * 20}</article></section>',
])
def test_parts_named_as_boilerplate_are_dropped(part):
    article = f"<article><h1>A head line</h1>{TWO}</article>"
    for body in (article + part, part + article, f'<div class="page">{article}{part}</div>'):
        assert hc.main_text(f"<body>{body}</body>") == f"A head line\n{TWO_TEXT}"


def test_signs_for_content_do_not_add_up():
    page = (
        '<main class="content"><article class="post"><div class="entry-content"><div class="body">'
        '<p>First paragraph is here.</p><div class="ad"><p>' + "Buy this now, it is great. " * 20
        + "</p></div><p>Second one is here.</p></div></div></article></main>"
    )
    assert hc.main_text(page) == "First paragraph is here.\nSecond one is here."


@pytest.mark.parametrize("html", [
    "<form>" * 50_000 + "<p>Some text is here.</p>", "<div class=ad><p>Word is here.</p></div>" * 20_000,
    "<div " + "a=1 " * 100_000 + "class=ad><p>x", "<div class='" + "ad-" * 100_000 + "'><p>x",
    "<div class=ad><p>One is here.</p>" * 20_000,
])
def test_signs_take_no_time(html):
    began = time.process_time()
    hc.main_text(html)
    assert time.process_time() - began < 20


def test_pages_far_above_a_slice(spark):
    page = PAGE % f"<article>{TWO * 20_000}</article>"
    pages = spark.createDataFrame([(k, page) for k in range(3)], "page_id int, html string")
    want = len("\n".join([TWO_TEXT] * 20_000))
    assert [r["n_chars"] for r in hc.extracted(pages.coalesce(1)).collect()] == [want] * 3
