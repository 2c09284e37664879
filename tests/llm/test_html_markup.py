"""Broken, deep and long markup: linear time, nothing lost, ancestors known at any depth."""

from __future__ import annotations

import time

import pytest

from foliant.llm.html_blocks import Contexts, blocks, text_features
from foliant.llm.html_text import default_field


def texts(page):
    return [b[0] for b in blocks(page, Contexts())]


@pytest.mark.parametrize(
    "page",
    ["<script ", "<a ", "<a '", '<a ">', "<p class=\"x'>", "<!", "<!--", "<!-- x -->", "<", "</", "<template>", "<iframe>", "<b>", "<div>", "</p>", "<li>", "<svg>", "&", "<div class=x></i>", "<ul><div><li></li>"],
)
def test_a_megabyte_of_broken_markup(page):
    c = Contexts(frozenset(default_field().index))
    began = time.process_time()
    blocks(page * (1_000_000 // len(page)) + "<p>end</p>", c)
    assert time.process_time() - began < 6  # seconds for a quadratic scan would be thousands


@pytest.mark.parametrize("first", ["<b>", "<i><div>" + "<b>" * 100, "<li><ul>" + "<div>" * 100, "<section>"])
def test_ends_and_items_never_walk_the_stack(first):
    page = first + "<div>" * 100_000 + "<b>" * 100_000 + "</i></section></li><li></li>" * 30_000
    began = time.process_time()
    blocks(page, Contexts(frozenset()))
    assert time.process_time() - began < 6


def test_ancestors_at_any_depth():
    (deep,) = blocks("<article>" + "<div>" * 5000 + "<p>text", Contexts())
    assert {"in:article", "in:p", "in:div"} <= deep[1] and deep[2] == "p"


@pytest.mark.parametrize("tag", ["svg", "math", "object", "canvas", "noscript", "template", "iframe"])
def test_unclosed_elements_keep_the_rest(tag):
    assert texts(f"<p>before</p><{tag}><p>after one</p><p>after two</p>") == ["before", "after one", "after two"]


@pytest.mark.parametrize("tag", ["svg", "math", "object", "canvas", "noscript"])
def test_embedded_text_stays(tag):
    assert texts(f"<p>before <{tag}>inner</{tag}> after</p>") == ["before inner after"]


def test_silent_elements():
    assert texts("<p>a</p><script>if (a < b) '</p>'</script><style>p{}</style><template><p>no</p></template><iframe>no</iframe><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><SCRIPT x='>'>no</Script ><p>b</p><!-- no --><!doctype html><?php no ?><p>c") == ["a", "b", "c"]


def test_quotes():
    assert texts("<p title='a > b'>x</p><p title=\"it's\">y</p>") == ["x", "y"]
    assert texts("<p>it's</p><p title='>z</p><p>w</p>") == ["it's", "z", "w"]
    assert texts("1 < 2 and <3 <p>b</p> a <b") == ["1 < 2 and <3", "b", "a <b"]


def test_lists_tables_and_paragraphs_close():
    near = [(b[0], b[2]) for b in blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table><p>h<div>i", Contexts())]
    assert near == [("a", "li"), ("b", "li"), ("c", "li"), ("d", "li"), ("e", "td"), ("f", "td"), ("g", "td"), ("h", "p"), ("i", "div")]


def test_features_of_the_whole_block():
    long = "word " * 500
    assert "claim" in text_features(long + "all rights reserved", "p", 0) and "digit" in text_features(long + "7", "p", 0)


def test_article_of_the_pages_table(spark, sf_dir):
    """The table's pages put their text in one article element: a plain parser says what it holds."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.on, self.out = False, [""]

        def handle_starttag(self, tag, attrs):
            self.on = self.on or tag == "article"
            self.out[-1] += " " if tag == "br" else ""
            if tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "td", "th", "blockquote", "pre", "hr", "figure", "figcaption"):
                self.out.append("")

        def handle_endtag(self, tag):
            if tag == "article":
                self.on = False
            if tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "td", "th", "blockquote", "pre"):
                self.out.append("")

        def handle_data(self, data):
            if self.on:
                self.out[-1] += data

    model, wrong, n = default_field(), 0, 0
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        a = Article()
        a.feed(row["html"] or "")
        want = "\n\n".join(t for t in (" ".join(x.split()) for x in a.out) if t)
        wrong += model.texts([row["html"]])[0] != want
        n += 1
    assert n > 100 and wrong / n < 0.02, f"{wrong} of {n}"
