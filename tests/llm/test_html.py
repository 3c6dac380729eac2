from __future__ import annotations

import html as entities
import random
import re
import time

import numpy as np
import pytest

from granary.llm import html
from granary.llm.queries import op3_html_extraction


@pytest.fixture(scope="module")
def model():
    return html.fit([], made=600)


def test_tree_and_text():
    nodes = html.parse("<body>a<p>b <b>c</b>d<p>e<br>f<ul><li>g<li>h</ul><script>x<p></script><!-- <p>no --><div class='x>y'>i &amp;\n\t&lt;p&gt;</div></zzz>")
    assert [n.tag for n in nodes] == ["page", "body", "p", "p", "ul", "li", "li", "div"]
    assert html.text_of(nodes, np.ones(len(nodes), bool)) == "a b cd e f g h i & <p>"
    for odd in ("", "<", "<p", "plain", "<p></p></p>", "<b><p>x</b>y</p>", "<!--", "<script>", "a<br/>b", "<a href='x"):
        html.text_of(html.parse(odd), np.ones(len(html.parse(odd)), bool))


def test_broken_markup_takes_linear_time():
    for page in ("a<b " * 60_000, '<p class="x>text</p>' * 5_000, "<" * 100_000, "<i>" * 20_000 + "x", "<!-- " * 20_000, "<p>x" * 20_000):
        began = time.time()
        nodes = html.parse(page)
        html.text_of(nodes, np.ones(len(nodes), bool))
        assert time.time() - began < 20
    assert html.text_of(html.parse('<p class="x>one</p><p>two'), np.ones(9, bool)) == "one two"


def test_unmatched_tags_take_linear_time():
    n = 20_000
    for page in (
        "<b>" * n + "</i>" * n, "<div>" * n + "</span>" * n, "<svg>" * n, "<noscript>x" * n, "<p><button>" + "<b>" * n + "<div></div>" * n,
        "<li><ul>" + "<div>" * n + "<li></li>" * n, "<div>" * n + "<td></td>" * n,
    ):
        began = time.time()
        assert html.parse(page)
        assert time.time() - began < 5
    assert [x.tag for x in html.parse("<ul><li>a<ul><li>b<p>c<li>d</ul><li>e</ul><p>f<b>g<div>h</div>")] == \
        ["page", "ul", "li", "ul", "li", "p", "li", "li", "p", "div"]


def test_decoding_is_the_best_consistent_choice():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 7)
        nodes = [html.Node("page", frozenset(), -1, 0)]
        for i in range(1, n):
            p = r.randrange(i)
            nodes.append(html.Node("p", frozenset(), p, nodes[p].depth + 1, ["x" * r.randint(0, 30)]))
        logit = np.array([r.gauss(0, 2) for _ in range(n)])
        weight = np.array([1 + np.log1p(sum(map(len, x.parts))) for x in nodes])
        best, choice = -np.inf, None
        for code in range(3**n):
            state = [code // 3**i % 3 for i in range(n)]
            if state[0] or any(state[i] < state[nodes[i].parent] for i in range(1, n)):
                continue
            value = sum(w * -np.logaddexp(0, -v if s == 1 else v) for s, v, w in zip(state, logit, weight))
            if value > best + 1e-9:
                best, choice = value, [s == 1 for s in state]
        assert html.decoded(nodes, logit).tolist() == choice


def test_boosting_learns():
    r = np.random.default_rng(0)
    x = r.standard_normal((3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    fitted = html.boosted(x[:2000], y[:2000])
    assert np.mean((fitted.logit(x[2000:]) > 0) == y[2000:]) > 0.93


def test_unseen_made_pages(model):
    r, right, n = random.Random(999), 0, 150
    for _ in range(n):
        nodes = html.parse(html.made_page(r, "many kinds of words for pages".split()))
        main = html.text_of(nodes, np.array(html._marked(nodes)))
        right += html.text_of(nodes, html.decoded(nodes, model.logit(html.features(nodes)))) == main
    assert right / n > 0.85


PAGE = """<html><head><title>T</title></head><body><header><h2>Site name</h2><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice"><p>We use cookies on this site, please accept them.</p><button>OK</button></div>
<div id="content"><article><h1>The &amp; title</h1><p>A first   paragraph of the article, with <i>inline</i> text.</p>
<div class="advert"><p>Buy now and save a lot of money today.</p></div><p>Another paragraph, somewhat longer than the first one was.</p></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this article, it is far too short.</p></div></section></div>
<aside class="sidebar"><ul><li><a href=/a>Popular one</a></li></ul></aside><form><label>Search</label><input></form><footer><p>All rights reserved by us.</p></footer>"""


def test_page_by_hand_and_odd_rows(spark, model):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", 5), (1, "u", PAGE, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = html.extract_main_text(pages, model).collect()
    main = "The & title A first paragraph of the article, with inline text. Another paragraph, somewhat longer than the first one was."
    assert sorted((r.page_id or 0, r.url, r.text) for r in out if r.url) == sorted([(1, "u", main), (1, "u", main), (0, "v", "")])
    assert html.extract_main_text(pages.limit(0), model).count() == 0
    assert html.trained(pages.limit(0), made=30).trees


def test_query_on_given_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op3_html_extraction(spark, sf_dir).collect()
    right = 0
    for r in rows:
        inside = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(entities.unescape(re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " ", inside))).split())
        right += r.text == want and r.n_chars == len(want)
    assert len(rows) == len(pages) and right >= 0.97 * len(rows)
