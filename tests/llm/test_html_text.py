"""Main text of pages: the surge and dive rule against a plain version, and page shapes."""

import random
import time

import pytest

from ledgerline.llm import html_text

LONG = "A sentence that is surely long enough to be taken for text of the page."


def page(body, head="<head><title>t</title></head>"):
    return f"<html>{head}<body>{body}</body></html>"


def plain(weights):
    """Places kept, straight from the rule: i lies in a stretch if its window has weight; a stretch counts if one surges."""
    n, w = len(weights), html_text.WINDOW
    sums = [sum(weights[i : i + w]) for i in range(n)]
    stretch, runs = [], []
    for i in range(n):
        if sums[i] > 0:
            stretch.append(i)
        if stretch and (sums[i] == 0 or i + 1 == n):
            runs.append(stretch)
            stretch = []
    main = [r for r in runs if max(sums[i] for i in r) >= html_text.SURGE]
    if not main and runs:
        main = [max(runs, key=lambda r: max(sums[i] for i in r))]
    return [i for r in main for i in r if weights[i]]


def test_surge_and_dive():
    rng = random.Random(3)
    for _ in range(300):
        body, words, weights = [], [], []
        for k in range(rng.randrange(0, 40)):
            kind = rng.randrange(5)
            if kind == 0:
                body.append(f"<nav>menu {k}</nav>")
                weights += [0] * (2 * html_text.WINDOW)
                words += [""] * (2 * html_text.WINDOW)
                continue
            text = f"{k} " + "x" * rng.choice([1, 3, 10, 60])
            if kind == 1:
                body.append(f"<p><a href=u>{text}</a></p>")
                weights.append(max(1, len(text) // 4))
            else:
                body.append(f"<div>{text}</div>")
                weights.append(len(text))
            words.append(text)
        got = html_text.extract(page("".join(body)))
        assert got.split("\n") == ([words[i] for i in plain(weights)] or [""])


@pytest.mark.parametrize(
    "html, want",
    [
        (page(f"<article><h1>T</h1><p>{LONG}</p></article>", "<head><meta charset=utf-8><title>t</title>"), f"T\n{LONG}"),
        (f"<html><head><title>t</title><style>p{{}}</style><p>{LONG}", LONG),
        (f"<p>{LONG}<title>never closed", f"{LONG}never closed"),
        (page(f"<div class='has-sidebar'><article><h1>T</h1><p>{LONG}</p></article><div class='left sidebar'><p>{LONG}</p></div></div>"), f"T\n{LONG}"),
        (page(f"<div class='sidebar-left'><main><p>{LONG}</p></main></div>"), LONG),
        (page(f"<article><div class='post-header'><h1>T</h1></div><p>{LONG}</p><div class=ad>Buy</div><p>end</p></article>"), f"T\n{LONG}\nend"),
        (page(f"<article><header><h1>T</h1></header><p class=related-work>{LONG}</p><ul class=related-posts><li>other</ul><footer>f</footer></article>"), f"T\n{LONG}"),
        (page(f"<p class='legal-news form-guide'>{LONG}</p><div class=comments-area><article class=comment><p>{LONG} I say.</p></article></div>"), LONG),
        (page(f"<article><p>{LONG}</p><section id=comments><article><p>{LONG} I say.</p></article></section></article>"), LONG),
        (page("<article><p>Short.</p></article><div>" + LONG + "</div>"), "Short."),
        (page(f"<p>x</p><nav>menu</nav><p>{LONG}</p><p>tail</p><nav>menu</nav><p>y</p>"), f"{LONG}\ntail"),
        (page("<nav>menu</nav><footer>f</footer>"), ""),
        (page(f"<p>&lt;b&gt; &amp;amp; caf&eacute;&nbsp; {LONG}\n\t two</p><br>three"), f"<b> &amp; café {LONG} two\nthree"),
        (page(f"<p>{LONG} <b>bold<p>next</p> <div hidden>no</div><div style='display: none'>no</div>"), f"{LONG} bold\nnext"),
        (None, ""),
        ("", ""),
        ("<", "<"),
        ("<script>var a='<p>'", ""),
    ],
)
def test_shapes(html, want):
    assert html_text.extract(html) == want


def test_deep_and_long():
    for body in ("<div>" * 100_000 + LONG, "<p><span>" * 50_000 + LONG, "<div>" + "<b>" * 100_000 + LONG + "</i>" * 100_000, "<title>" * 20_000 + LONG, f"<p>{LONG}</p>" * 20_000):
        began = time.process_time()
        assert LONG in html_text.extract(body)
        assert time.process_time() - began < 3


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, `a.b` string"
    rows = [(1, "u", page(f"<p>{LONG}</p>"), "clash", "x"), (1, "u", page(f"<p>{LONG}</p>"), "clash", "x"), (None, None, None, None, None), (2, None, "", "", "")]
    got = html_text.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, got)) == sorted(map(str, [*[r for r in got if r["page_id"] == 1], *[r for r in got if r["page_id"] != 1]])) and len(got) == 4
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] == 1] == [(LONG, len(LONG))] * 2
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] != 1)
    assert html_text.main_text(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("inside,want", [
    ('<p>one <span class="ad">BUY NOW</span> two</p>', "one two"), ("<p>one <button>Copy link</button> two</p>", "one two"), ("<p>one <label>Term</label>two</p>", "one two"), ('<p>one <a class="share-link" href="#">Share on X</a> two</p>', "one two"),
    ("<p>one <span hidden>secret</span> two</p>", "one two"), ('<p>one <span class="ad"><b>BUY</b> <i>NOW</i></span> two</p>', "one two"), ('<p>one</p><span class="ad">BUY</span><p>two</p>', "one\ntwo"), ('<div>one <span class="ad"><div>BUY</div></span> two</div>', "one\ntwo"),
    ('<h2 id="search">Search</h2><p>one</p>', "Search\none"), ('<h2 id="legal">Legal</h2><h3 id="comments">Comments</h3><h4 id="navigation">Navigation</h4>', "Legal\nComments\nNavigation"), ('<h2 class="ad">Buy</h2><p>one</p>', "one"),
])
def test_inline_noise_and_headings(inside, want):
    long = "A sentence that is long enough to be the main text of any page, whatever stands around it."
    for page in (f"<html><body><nav>Menu</nav><article>{inside}<p>{long}</p></article></body></html>", f"<html><body><main>{inside}<p>{long}</p></main><footer>x</footer></body></html>"):
        assert html_text.extract(page) == f"{want}\n{long}"


def test_inline_noise_outside_an_article():
    long = "A sentence that is long enough to be the main text of any page, whatever stands around it."
    assert html_text.extract(f'<div>{long} <span class="ad">BUY NOW</span> and more.</div>') == f"{long} and more."


def test_short_articles_are_kept():
    long = "A sentence that is long enough to be the main text of any page, whatever stands around it."
    between = "<div>a</div><div>b</div><div>c</div><div>d</div>"
    assert html_text.extract(f"<article><p>{long}</p></article>{between}<article><p>Short.</p></article>") == f"{long}\nShort."
