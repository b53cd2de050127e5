import html
import re
import time

import numpy as np
import pytest
from helpers import plain, table, with_clashing
from pyspark.sql import functions as F

from retailcast.llm.block_labeller import Shape, _bags, _gradients, _scores, fit, initial, inputs_of, label_pages
from retailcast.llm.html_blocks import blocks_of
from retailcast.llm.html_layouts import layouts
from retailcast.llm.main_text import Settings, main_text, main_texts, trained

SCHEMA = "page_id long, url string, html string"


def article_of(source):
    """The test pages name their article; brute force takes it by that name alone."""
    inside = re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1]
    inside = re.sub(r"</?(?:p|h1|br)>", " ", inside)
    return " ".join(html.unescape(re.sub(r"</?b>", "", inside)).split())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_articles_of_the_test_pages(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
    want = [(r.page_id, r.url, article_of(r.html)) for r in pages.collect()]
    got = main_texts(pages)
    assert plain(got.drop("n_chars")) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_held_out_layouts():
    pages, labels = layouts(400, seed=99)
    found = label_pages(pages, trained())
    wrong = sum(int((f != t).sum()) for f, t in zip(found, labels))
    assert wrong < 0.01 * sum(len(t) for t in labels)
    assert sum((f == t).all() for f, t in zip(found, labels)) > 0.85 * len(pages)


OTHER = """<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept all</button></div>
<header class="site-header"><a href="/">The Daily</a><p>News for all of us every day</p></header>
<ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">Contact</a></li></ul>
<div id="content"><h1>A &amp; B</h1><p>First   paragraph of <b>bold</b>ness&nbsp;here, which is long enough to read.</p>
<!-- <p>hidden</p> --><div class="advert"><p>Buy now and save a lot of money on everything.</p></div>
<p>Second paragraph, with a <a href="/x">link</a> &lt;tag&gt; in it.<p>Third one is not closed<ul><li>an item of a list</li></ul>
<form><label>Your name</label><input name=n><textarea>typed</textarea></form></div>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with the first paragraph of this article.</p></div></div>
<div class="sidebar"><h3>Most popular</h3><p>Another story that many people have read this week.</p></div>
<footer><p>All rights reserved.</p></footer></body></html>"""


def test_another_layout():
    assert main_text(OTHER) == (
        "A & B First paragraph of boldness here, which is long enough to read. Second paragraph, with a link <tag> in it. Third one is not closed an item of a list"
    )


def test_blocks():
    text = lambda source: [b.text for b in blocks_of(source)]
    assert text(None) == text("") == text(" \n ") == text("<!-- only") == text("<p") == []
    assert text("a < b and 1 <2") == ["a < b and 1 <2"]
    assert text("x<script>var a = '</p><p>'</script>y<style>p{}</style>z") == ["xyz"]
    assert text("<p title='a > b' data=\"<p>\">one<br>two<p>three") == ["one two", "three"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert text("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert text("&amp;amp; &copy &#x41; &unknown; &am") == ["&amp; © A &unknown; &am"]
    assert text("<head><title>t</title><p>body</p>") == ["body"]
    assert text("</div></p></li>stray<div>in</div>") == ["stray", "in"]
    assert text("<a href=x>link</a> rest") == ["link rest"] and blocks_of("<a>link</a>")[0].links == 1


def test_parsing_takes_time_in_proportion():
    for piece in ("<div>", "<a <a ", "<p title=\"x", "<!-- x", "<script>", "</p>", "<td>x", "&amp", "<ul><li>x", "<b "):
        start = time.perf_counter()
        blocks_of(piece * 40_000)
        assert time.perf_counter() - start < 10, piece


def test_odd_pages(spark):
    long = "<body><article>" + "<p>word and word again, as before.</p>" * 6000 + f"<p>{'x' * 100_000}</p></article><footer>All rights reserved.</footer>"
    rows = [(1, None, None), (2, "u", ""), (None, "v", "<article><p>no id of its own here.</p></article>"), (3, "w", long), (4, "z", "just text"), (4, "z", "just text")]
    got = main_texts(with_clashing(spark.createDataFrame(rows, SCHEMA)).withColumn("text", F.lit("t")).withColumn("n_chars", F.lit(1)))
    found = {(r.page_id, r.url): r.text for r in got.collect()}
    assert got.count() == 6 and found[1, None] == found[2, "u"] == "" and found[None, "v"] == "no id of its own here." and found[4, "z"] == "just text"
    assert found[3, "w"].count("word and") == 6000 and found[3, "w"].endswith("x" * 100_000)
    assert main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_do_not_depend_on_their_company():
    pages, _ = layouts(60, seed=5)
    weights = trained()
    together = label_pages(pages, weights)
    for page, labels in zip(pages, together):
        assert np.array_equal(label_pages([page], weights)[0], labels)


def test_gradients_equal_differences():
    """The way back through both directions, against small changes of the loss."""
    shape = Shape(path_buckets=16, path_size=3, word_buckets=8, word_size=2, hidden=4)
    pages, labels = layouts(3, seed=3)
    weights = {n: v.astype(np.float64) + 0.1 for n, v in initial(shape, 1).items()}

    def loss(w):
        total = 0.0
        for found, truth in zip(_raw_scores(pages, w, shape), labels):
            total += np.sum(np.log1p(np.exp(-np.abs(found))) + np.maximum(found, 0) - found * truth)
        return total / sum(map(len, labels))

    grads = _gradients([_bags(p, shape) for p in pages], labels, weights, shape, np.random.default_rng(0), 0.0)
    draw = np.random.default_rng(2)
    for name, grad in grads.items():
        for _ in range(3):
            at = tuple(draw.integers(0, n) for n in grad.shape)
            moved = {side: {k: v.copy() for k, v in weights.items()} for side in (-1, 1)}
            for side in (-1, 1):
                moved[side][name][at] += side * 1e-2
            assert (loss(moved[1]) - loss(moved[-1])) / 2e-2 == pytest.approx(grad[at], abs=2e-3), name


def _raw_scores(pages, weights, shape):
    for page in pages:
        for block in page:
            node = block.node
            while node is not None:
                node.memo.clear()
                node = node.parent
        yield _scores(inputs_of(page, weights, shape)[None], np.array([len(page)]), weights, shape)[0]


def test_fit_is_repeatable():
    pages, labels = layouts(20, seed=4)
    a, b = (fit(pages, labels, epochs=1) for _ in range(2))
    assert all(np.array_equal(a[n], b[n]) for n in a)
    assert Settings() == Settings()
