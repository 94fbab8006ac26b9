"""Blocks of pages, the network against plain loops, and whole texts of held-out pages."""

import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import extraction
from tallyforge.llm.blocks import leaves
from tallyforge.llm.layouts import layouts

NEWS = """<html><body><div id="cookie-banner">We use cookies. <button>OK</button></div><header><h2>Site</h2><nav><a href=/>Home</a></nav></header>
<div class="container"><div class="post-content"><h1>A fine  title</h1><p>The first paragraph of the <b>story</b> goes on,<br>as they do.</p>
<div class="ad-slot">Buy this thing now.</div><p>Short.<p>Salt &amp; p&eacute;pper&nbsp;!<script>var x = "</p>";</script><ul><li>one<li>two</ul>
<div class="share-buttons"><a href=#>Tweet</a></div></div><aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Some other story</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked it.</p></div></section></div><form><label>Email</label><input></form><footer>&copy; 2020</footer></body></html>"""
NEWS_TEXT = "A fine title\nThe first paragraph of the story goes on, as they do.\nShort.\nSalt & pépper !\none\ntwo"


def texts(html):
    return [leaf.text for leaf in leaves(html)]


@pytest.mark.parametrize("html, want", [
    (None, []), ("", []), ("  \n ", []), ("plain & simple", ["plain & simple"]), ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
    ("<p>a<br>b <i>c</i>d</p>", ["a b cd"]), ("a<!-- <p>x</p> -->b<!--never ends", ["ab"]), ("<style>p{}</style>x<script>if (a<b) '</p>'</script>y", ["xy"]),
    ("<script>never ends <p>x</p>", []), ("<a title='1 > 0'>x</a>", ["x"]), ("<a title=don't>x</a><p>y", ["x", "y"]), ("1 < 2 &lt;p&gt; &#65;&#x42; &amp", ["1 < 2 <p> AB &"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<P>A</P><p", ["A"]),
    ("<textarea>x</textarea><title>t</title>y<svg><text>z</text></svg>", ["y"]), ("</p></div>x</b>", ["x"]),
])
def test_blocks(html, want):
    assert texts(html) == want


def test_paths_are_closed():
    """What an end tag leaves open is not in the path of what follows."""
    path = lambda html: leaves(html)[-1].path
    assert path("<nav><ul><li><b>a</ul></nav><p>x") == path("<p>x")
    assert path("<div><p><b>a<br><p>x") == path("<div><p>x")
    assert path("<div><span></div>x") == path("x")
    assert path("<p class='Ads menuItem'>x") == path("<p class=ad id='menu-item'>x")
    deep = leaves("<div>" * 20000 + "x")
    assert len(deep) == 1 and len(deep[0].path) == 16


def test_layouts_label_every_block():
    for html, labels in layouts(80, ["some words of <an> article & more"], []):
        assert len(leaves(html)) == len(labels)


def small(seed=0):
    pages = [leaves(h) for h, _ in layouts(4, [], [], seed)] + [leaves("<p>one")]
    net = extraction.BlockLSTM(seed)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net, pages


def test_network_against_loops():
    """Both directions, step by step, for each page by itself."""
    net, pages = small()
    got = net.probabilities(extraction.Pages(pages))
    want, n = [], extraction.STATES
    logistic = lambda x: 1 / (1 + np.exp(-x))
    for page in pages:
        x = net.inputs(extraction.Pages([page])).astype(np.float64)
        states = {}
        for d, order in (("f", range(len(page))), ("b", reversed(range(len(page))))):
            h = c = np.zeros(n)
            for t in order:
                z = net.p[f"x{d}"].T @ x[t] + net.p[f"h{d}"].T @ h + net.p[f"c{d}"]
                i, f, o, g = logistic(z[:n]), logistic(z[n : 2 * n]), logistic(z[2 * n : 3 * n]), np.tanh(z[3 * n :])
                c = f * c + i * g
                h = o * np.tanh(c)
                states[d, t] = h
        want += [logistic(np.concatenate([states["f", t], states["b", t], x[t]]) @ net.p["out"] + net.p["bias"])[0] for t in range(len(page))]
    assert np.allclose(got, want, atol=1e-5)


def test_slopes():
    net, pages = small(1)
    held = extraction.Pages(pages)
    labels = np.random.default_rng(0).integers(0, 2, len(held.measures)).astype(float)
    slopes = net.slopes(held, labels)[1]
    for name in ("out", "bias", "xf", "xb", "hf", "hb", "cf", "cb", "path", "word"):
        at = np.unravel_index(np.abs(slopes[name]).argmax(), slopes[name].shape)
        was, loss = net.p[name][at], []
        for step in (1e-4, -1e-4):
            net.p[name][at] = was + step
            loss.append(net.slopes(held, labels)[0])
        net.p[name][at] = was
        assert abs((loss[0] - loss[1]) / 2e-4 - slopes[name][at]) < 2e-3 * (abs(slopes[name][at]) + 0.01), name


def plain(html):
    """The blocks of the given pages' article, by regular expressions."""
    body = re.search("<article>(.*?)</article>", html, re.S)[1]
    parts = (" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?p>|</?h1>", body))
    return "\n".join(p for p in parts if p)


def test_whole_pages(spark):
    """All pages of a given table, and pages in layouts that it doesn't have; with null, empty, repeated and very long ones."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    long = "<body><nav><a>Home</a></nav><article>" + "<p>a paragraph of words.</p>" * 20000 + "</article><footer>© us</footer>"
    odd = [(1000, "u", NEWS), (1001, None, None), (1002, "u", ""), (1000, "u", NEWS), (None, "u", "<script>x</script>"), (1003, "u", long)]
    frame = given.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumns({n: F.lit("x") for n in ("blocks", "text", "path", "linked")})
    rows = extraction.extract(frame).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == given.count() + 6 and all(r.n_chars == len(r.text) for r in rows)
    assert got[1000] == NEWS_TEXT and got[1001] == got[1002] == got[None] == "" and got[1003].count("\n") == 19999
    right = [got[r.page_id] == plain(r.html) for r in given.collect()]
    assert np.mean(right) >= 0.98


def test_empty_table(spark):
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_held_out_layouts():
    r = layouts(700, [], [], 1)
    net = extraction.BlockLSTM()
    net.fit([(leaves(h), labels) for h, labels in r[:500]], epochs=6)
    held = [(leaves(h), labels) for h, labels in r[500:]]
    sure = net.probabilities(extraction.Pages([p for p, _ in held]))
    assert np.mean((sure >= 0.5) == np.array([x for _, labels in held for x in labels])) > 0.98
