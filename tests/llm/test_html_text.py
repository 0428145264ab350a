"""HTML extraction: block cutting by cases, the LSTM against plain loops and numeric gradients, held-out pages, awkward tables."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalyte.llm import html_text
from catalyte.llm.html_text import DIM, blocks_of, path_rows, text_features

SMALL = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in blocks_of(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a  b\n c<br>d<b>e</b>f</p>g", ["a b c def", "g"]),
        ("<p><b>open<br><p>next</p>", ["open", "next"]),
        ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>", ["one", "two", "three", "four"]),
        ("x &amp;amp; y&nbsp;&eacute;&#x41;&#66 &unknown; &lt;p&gt;", ["x &amp; y éAB &unknown; <p>"]),
        ("<script>var a = '<p>no</p>';</script>yes<style>p{}</style><textarea>no</textarea><!-- <p>no --> end", ["yes end"]),
        ("<script>never closed <p>no", []),
        ("a<!-- never closed <p>no", ["a"]),
        ("<title>no</title><h1>T</h1>", ["T"]),
        ("<td title='a>b'>cell</td><TD>two", ["cell", "two"]),
        ("<p title=\"never closed>one<p>two", ["one", "two"]),
        ("1 < 2 <3 and a<b", ["1 < 2 <3 and a"]),
        ("</p></div></x>stray", ["stray"]),
        ("<!DOCTYPE html><?php x ?>t", ["t"]),
        ("<table><tr><td>a<td>b<tr><td><table><tr><td>c</table>d</table>", ["a", "b", "c", "d"]),
        ("<svg><text>no</text></svg><noscript>n</noscript>", ["n"]),
        ("", []),
        ("  \n ", []),
        ("<", ["<"]),
        ("</", []),
        ("\x00<p>\x00a", ["\x00", "\x00a"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    found = blocks_of('<div class="mainContent side-bar"><p id=x>text <a href="/">link</a></p></div><A>out</A>')
    assert found[0].path == ("div", ".main", ".content", ".side", ".bar", "p", ".x") and found[0].linked == 4 and found[1].linked == 3


def test_odd_pages_take_linear_time():
    for page in ("<" * 300_000, "<a" * 200_000, '<a b="' * 100_000, "<p>" * 20_000 + "t", "</p>" * 100_000, "&" * 300_000, "<!--" * 100_000, "<script>" * 50_000, "<a '\">" * 100_000):
        blocks_of(page)


def plain_lstm(net, paths, features):
    """One page, one block and one gate at a time."""
    x = [np.concatenate([net.params[0][p].sum(0), f]) for p, f in zip(paths, features)]
    outs = []
    for way in range(2):
        w, u, b = net.params[1 + 3 * way : 4 + 3 * way]
        h, c, hs = np.zeros(net.hidden), np.zeros(net.hidden), []
        for v in x[::-1] if way else x:
            i, f, o, g = np.split(v @ w + h @ u + b, 4)
            c = c / (1 + np.exp(-f)) + np.tanh(g) / (1 + np.exp(-i))
            h = np.tanh(c) / (1 + np.exp(-o))
            hs.append(h)
        outs.append(hs[::-1] if way else hs)
    return np.array([np.concatenate([a, b, v]) @ net.params[7] + net.params[8][0] for a, b, v in zip(*outs, x)])


def some_pages(rng, sizes):
    return [([np.unique(rng.integers(0, 50, rng.integers(1, 6))) for _ in range(n)], rng.normal(size=(n, DIM - html_text.PATH_DIM)).astype(np.float32)) for n in sizes]


def test_network_runs_whole_pages():
    """Pages side by side, in parts of 1,024 blocks, give what a plain loop over all blocks gives."""
    rng = np.random.default_rng(1)
    pages = some_pages(rng, (3, 0, 1, 2500, 17, 1024, 1025))
    labelled = [(p, f, rng.integers(0, 2, len(p))) for p, f in some_pages(rng, (5, 9))]
    net = html_text.train(labelled, hidden=5, epochs=2)
    for (paths, features), got in zip(pages, net.logits(pages)):
        assert len(got) == len(paths)
        if len(paths):
            np.testing.assert_allclose(got, plain_lstm(net, paths, features), rtol=1e-3, atol=1e-3)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    pages = [(p, f, rng.integers(-1, 2, len(p))) for p, f in some_pages(rng, (4, 7, 2))]
    net = html_text.train(pages, hidden=3, epochs=1)
    net.params[:] = [p.astype(np.float64) for p in net.params]
    grads = html_text.gradients(net, pages)

    def loss():
        z = np.concatenate([plain_lstm(net, p, f)[y >= 0] for p, f, y in pages])
        y = np.concatenate([y[y >= 0] for _, _, y in pages])
        return np.mean(np.logaddexp(0, z) - y * z)

    for p, g in zip(net.params, grads):
        at = np.argsort(-np.abs(g).ravel())[:4]
        for k in at:
            old = p.flat[k]
            p.flat[k] = old + 1e-4
            up = loss()
            p.flat[k] = old - 1e-4
            down = loss()
            p.flat[k] = old
            assert abs((up - down) / 2e-4 - g.flat[k]) < 1e-3 + 0.02 * abs(g.flat[k])


@pytest.fixture(scope="module")
def net(spark):
    return html_text.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))


def labels(net, page):
    found = blocks_of(page)
    z = net.logits([([path_rows(b.path) for b in found], np.array([text_features(b) for b in found]))])[0]
    return {b.text: bool(v > 0) for b, v in zip(found, z)}


def test_query_keeps_exactly_the_articles(spark):
    """All pages: the article element's blocks, found by a plain cut of the markup."""

    def article(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:h1|p)>", inner))
        return "\n\n".join(x for x in parts if x)

    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = html_text.op12_html_text(spark, SMALL).collect()
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in got} == {(p.page_id, p.url, article(p.html), len(article(p.html))) for p in pages.values()} and len(got) == len(pages)


def test_pages_of_other_makes(net):
    """Frames that no sampled page has: what is kept and what is left out."""
    page = """<body><div id="masthead"><a href="/">The Daily</a></div><ul class="navbar"><li><a>Home</a></li><li><a>Sport</a></li></ul>
      <div class="cookie-consent">We use cookies. <button>Accept</button></div>
      <div class="content"><h1>A title for it</h1><p>The first paragraph tells what happened, and where.</p><p>The second adds a detail; it is longer, as they are.</p>
      <ul><li>one point of the list</li><li>another point of the list</li></ul><div class="advert">Buy two, get one free!</div><p>The last paragraph ends the story.</p></div>
      <div class="sidebar"><h3>Most read</h3><p>Another story that is not this one.</p></div>
      <form class="newsletter"><label>Your mail</label></form>
      <section id="comments"><h3>2 comments</h3><div class="comment"><p>I was there and saw it, it is all true.</p></div></section><footer>All rights reserved.</footer>"""
    got = labels(net, page)
    wanted = {"A title for it", "The first paragraph tells what happened, and where.", "The second adds a detail; it is longer, as they are.", "one point of the list", "another point of the list", "The last paragraph ends the story."}
    assert {t for t, kept in got.items() if kept} == wanted


def test_held_out_frames(net):
    """Made-up frames that training never saw: at least 97 of 100 blocks right."""
    rng = np.random.default_rng(404)
    sample = {y: [rng.normal(size=DIM - html_text.PATH_DIM).astype(np.float32) * 0.3 for _ in range(50)] for y in (0, 1)}
    pages = html_text.frames(sample, rng, 150)
    right = [((z > 0) == (y == 1)).mean() for z, (_, _, y) in zip(net.logits([p[:2] for p in pages]), pages)]
    assert np.mean(right) >= 0.97


def test_awkward_tables(spark):
    long = "<article><h1>Long</h1>" + "<p>many words of one paragraph, again.</p>" * 5_000 + "</article><footer>&copy; x</footer>"
    page = "<nav><a>Home</a></nav><article><h1>T</h1><p>A paragraph, twice.</p></article><footer>&copy; x</footer>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", None), (3, "u", ""), (4, "u", long), (5, "u", "<nav>only a menu</nav>"), (6, "u", "\x00 &#0; <")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "h": F.lit("kept")})
    got = {(r.page_id, r.text) for r in html_text.extract(df).collect()}
    assert {(1, "T\n\nA paragraph, twice."), (None, "T\n\nA paragraph, twice."), (2, ""), (3, "")} <= got and html_text.extract(df).count() == len(rows)
    whole = next(t for k, t in got if k == 4)
    assert whole.count("\n\n") == 5_000
    assert html_text.extract(df.limit(0)).collect() == []
    empty = html_text.extract(spark.createDataFrame([(1, None)], "page_id long, html string")).collect()
    assert [(r.text, r.n_chars, r.html) for r in empty] == [("", 0, None)]
