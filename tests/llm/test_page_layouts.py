"""Page text: broken and deep markup, and pages of other layouts than the given ones."""
import time

import pytest

from docquarry.llm.html_text import main_text

WORDS = [" ".join(f"word{k * 40 + j}" for j in range(40)) + "." for k in range(5)]
PARTS = "".join(f"<p>{w}</p>" for w in WORDS)
TEXT = "\n".join(WORDS)
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(8)) + "</ul>"
REMARKS = "".join(f"<div><p>I say {w}</p></div>" for w in WORDS * 2)


def quick(html, limit):
    start = time.perf_counter()
    text = main_text(html)
    assert time.perf_counter() - start < limit
    return text


def test_cut_off_tags_are_markup_and_cost_nothing():
    for quote in "\"'":
        cut = "<p>text</p><a " + f"b={quote}c{quote} " * 200
        assert quick(cut, 0.1) == "text"
        assert quick(cut + f"d={quote}never closed", 0.1) == "text"
        assert quick("<p>text</p>" + f"<a b={quote}" * 3000, 1) == "text"
    assert quick("<p>text</p>" + "<a " * 30_000, 2) == "text"
    assert quick("<p>text</p><!-- " * 5000, 2) == "text"
    assert quick("<p>text</p><!DOCTYPE " + "x" * 100_000, 1) == "text"
    assert main_text('<p title="a > b" data-x=\'<i>\'>one</p><p class=x/y>two</p><p = "q">three</p>') == "one\ntwo\nthree"


@pytest.mark.parametrize("opening, closing", [("<b>", "</i>"), ("<div>", "</span>"), ("<ul><li>", "</p>"), ("<x-a>", "</x-b>"), ("<b>", "<p>"), ("<i>", "<tr>")])
def test_depth_is_no_matter(opening, closing):
    assert quick(opening * 100_000 + "deep" + closing * 20_000, 5) == "deep"


@pytest.mark.parametrize("page", [
    f"<nav>{MENU}</nav><article>{{}}</article><footer>foot</footer>",
    f'<div class="nav-menu">{MENU}</div><div class="post">{{}}</div><div class="site-footer">All rights</div>',
    f'<div id="header">{MENU}</div><div id="content"><div id="main">{{}}</div><div id="sidebar">{MENU}</div></div>',
    f'<table><tr><td class="menu">{MENU}</td><td>{{}}</td></tr></table>',
    f'<main><header><p class="notice">Cookies!</p></header><section>{{}}</section><div id="comments">{REMARKS}</div></main>',
    f'<div class="wrapper has-sidebar"><div class="entry-content">{{}}</div><aside>{MENU}</aside></div>',
    f'<form id="f">{MENU}<div>{{}}</div><input name=q><select><option>1</select></form>',
    f'<div role="navigation">{MENU}</div><div role="main">{{}}</div><div role="contentinfo">foot</div>',
    f'<div class="related-posts">{MENU}</div>{{}}<div class="share-links">{MENU}</div>',
    f'<div class="layout"><div class="column left">{MENU}</div><div class="column"><div>{{}}</div></div></div><div class="cookie-banner"><p>We use them</p></div>',
    f'<ins class="adsbygoogle"></ins><div class="ad-slot">Buy now</div><section><div><div>{{}}</div></div></section><div class="newsletter-signup">Join</div>',
])
def test_layouts(page):
    assert main_text(f"<html><head><title>t</title><style>p{{}}</style></head><body>{page.format(PARTS)}</body></html>") == TEXT


def test_names_inside_the_text_tell_topics():
    html = f'''<body><div class="nav">{MENU}</div><div class="post">{PARTS}<h2 class="section search-methods">How we searched</h2><p>{WORDS[0]}</p>
        <div class="related work"><p>{WORDS[1]}</p></div><div class="related">{MENU}</div></div></body>'''
    assert main_text(html) == "\n".join([TEXT, "How we searched", WORDS[0], WORDS[1]])


def test_references_stay():
    titles = [f"A study of the {k}th kind of things in the world" for k in range(6)]
    listed = "<ol>" + "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(titles)) + "</ol>"
    want = "\n".join([TEXT, "References", *titles])
    assert main_text(f"<body><nav>{MENU}</nav><article>{PARTS}<h2>References</h2>{listed}</article></body>") == want
    assert main_text(f'<body><div class="nav">{MENU}</div><div>{PARTS}<h2>References</h2>{listed}</div></body>') == want
    assert main_text(f"<body><article>{PARTS}{MENU}</article></body>") == "\n".join([TEXT, *(f"Topic {k}" for k in range(8))])
    assert main_text(f"<body><div>{PARTS}{MENU}</div></body>") == TEXT
