"""What the densities decide, odd markup, and time that grows with the page."""

import math
import time

import duckdb
import numpy as np
import pytest

from riskloom.llm import html

LONG = "The long paragraph of an article with many words in it that goes on. " * 4
BODY = "".join(f"<p>{LONG}{i}</p>" for i in range(6))
NEUTRAL = ['<div class="bottom">Copyright 2024 Someone LEAK</div>', '<div class="c7">Buy the best shoes now LEAK</div>',
           "<table><tr><td>Mon LEAK</td><td>9-5</td></tr><tr><td>Tue</td><td>9-5</td></tr></table>",
           '<div class="x1"><p>Nice article, thanks! LEAK</p><p>I do not agree.</p></div>', '<div class="q"><a href="/">LEAK</a><a href="/b">two</a></div>']


@pytest.mark.parametrize("extra", NEUTRAL)
@pytest.mark.parametrize("page", ["<body><h1>Title</h1><div class=k>{}</div>{}</body>", "<body><article><h1>Title</h1>{}</article>{}</body>", "<body>{1}<div class=k><h2>Title</h2>{0}</div></body>"])
def test_boilerplate_without_telling_names_stays_out(page, extra):
    text = html.main_text(page.format(BODY, extra))
    assert "LEAK" not in text and text.startswith("Title\n") and text.count("long paragraph") == 24


def test_sections_beside_the_best_one_stay():
    page = f"<article><h1>Top</h1><section>{BODY}</section><section><h2>End</h2><p>{LONG[:200]}</p></section></article>"
    assert html.main_text(page).count("\n") == 8
    page = f"<div id=a><h1>Top</h1><div>{BODY}</div><div><h2>End</h2><p>{LONG[:200]}</p></div></div><p>© LEAK</p>"
    text = html.main_text(page)
    assert text.startswith("Top\n") and "End" in text and "LEAK" not in text


def test_without_densities_nothing_is_left(monkeypatch):
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    texts = [html.main_text(p) for p in pages]
    assert all(texts)
    monkeypatch.setattr(html, "densities", lambda tree, chars: np.zeros(len(tree.tag)))
    assert not any(map(html.main_text, pages))


def test_densities_choose_between_areas(monkeypatch):
    page = "<div id=a>" + "<p>first area here with words</p>" * 5 + "</div><div id=b>" + '<p><a href="/">second area of links</a></p>' * 5 + "</div>"
    assert "first" in html.main_text(page) and "second" not in html.main_text(page)
    real = html.densities
    monkeypatch.setattr(html, "densities", lambda tree, chars: 1 / (1 + real(tree, chars)))
    assert "second" in html.main_text(page)


def ancestry(tree, node):
    out = [node]
    while tree.parent[out[-1]] >= 0:
        out.append(tree.parent[out[-1]])
    return out


def plain_density(tree, chars):
    """The composite density of each element, every sum taken anew over what stands in it."""
    nodes = range(len(tree.tag))
    every, linked_in_all = sum(chars), sum(c for c, k in zip(chars, tree.link, strict=True) if k)
    out = []
    for node in nodes:
        inside = [k for k in nodes if node in ancestry(tree, k)]
        c, lc = sum(chars[k] for k in inside), sum(chars[k] for k in inside if tree.link[k])
        t, lt = max(1, len(inside) - 1), max(1, sum(tree.link[k] for k in inside if k != node))
        base = math.log(c / max(1, c - lc) * lc + linked_in_all / max(1, every) * c + math.e)
        ratio = math.log(max(1.0, c / max(1, lc) * t / lt))
        out.append(c / t * max(ratio / math.log(base) if base > 1 + 1e-9 else ratio / math.log(1 + 1e-9), 1e-6) if c else 0.0)
    return out


@pytest.mark.parametrize("page", [
    "<div><p>aaaa bbbb cccc</p><p>dd <a>link</a></p><ul><li><a>e</a></li><li>f</li><li>g</li></ul></div><p>tail of it",
    "<div><a>only</a><a>links <b>here</b></a></div>", "<p></p><div> </div>", "<nav><a>x</a></nav><article><h1>Title</h1><p>text text text</p></article>"])
def test_densities_equal_a_plain_version_on_small_trees(page):
    tree = html.Tree(page)
    chars = np.zeros(len(tree.tag), int)
    for node, _, text in tree.texts:
        chars[node] += len("".join(text.split()))
    np.testing.assert_allclose(html.densities(tree, chars), plain_density(tree, chars.tolist()))


@pytest.mark.parametrize("page,text", [
    ('<p class="x>Second</p><p>more</p>', "Second\nmore"), ('<div title="5" tall">txt</div>', "txt"), ('<p title="a > b">in</p>', "in"),
    ('<p class="x>one</p><p class="y">two</p>', "one\ntwo"), ("<p>a<!-- <p>b</p>", "a"), ("<p>a<script>var x = '<p>'", "a"), ("<p>a < b & c</p>", "a < b & c"),
    ("<title>t</title><p>a</p><style>p{}</style><p>b<br>c", "a\nb c"), ("<p>kept</p><a href=", "kept"), ("", "")])
def test_odd_markup(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "x", '<p title="x' * 90_000, "<i>" * 20_000 + "<div>" + "<b>x" * 20_000 + "</i>" * 20_000,
                                  "<p title='" + "a=\"" * 200_000, "<!--" * 100_000, "<li><p>x" * 50_000, "</div>" * 100_000])
def test_long_pages_take_seconds(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 8
