"""Shredding, rendering and selectors on small documents."""

import pytest
from pyspark.sql import functions as F

from bindery.operators.render import render_html
from bindery.operators.selectors import match_selectors, parse_selector
from bindery.sources.html import html_nodes, shred_html


def page_rows(spark, sources):
    return spark.createDataFrame(
        [("s", i, f"https://example.com/{i}", h) for i, h in enumerate(sources)], "site string, page_id long, url string, html string"
    )


def body(spark, sources):
    out = render_html(html_nodes(page_rows(spark, sources)), scope="body").orderBy("page_id").collect()
    return [r.html for r in out]


CASES = [
    ("<p>a<p>b", "<p>a</p><p>b</p>"),
    ("<p><b>x<br><p>y", "<p><b>x<br></b></p><p><b>y</b></p>"),
    ("<ul><li>a<li>b</ul>t", "<ul><li>a</li><li>b</li></ul>t"),
    ("<table><tr><td>1<td>2</table>", "<table><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"),
    ("a &lt; b &amp; c&nbsp;d", "a &lt; b &amp; c&nbsp;d"),
    ('<a href="?a=1&copy=2&amp;b">x</a>', '<a href="?a=1&amp;copy=2&amp;b">x</a>'),
    ("<a href=1>x<a href=2>y</a>", '<a href="1">x</a><a href="2">y</a>'),
    ('<script>if (a < b) "</p>"</script>x', "x"),
    ('x<script>if (a < b) "</p>"</script>', 'x<script>if (a < b) "</p>"</script>'),
    ("<div>open", "<div>open</div>"),
    ("x</p>y", "x<p></p>y"),
    ("<img src='a b'>t", '<img src="a b">t'),
    ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"),
    ("5 < 6 and <b class>c</b>", '5 &lt; 6 and <b class="">c</b>'),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<p>a<div>b</div>c</p>", "<p>a</p><div>b</div>c<p></p>"),
    ("<!-- c -->x<!-- d -->", "x<!-- d -->"),
    ("", ""),
]


def test_tree_building_and_rendering(spark):
    got = body(spark, [c[0] for c in CASES])
    assert [g for g in got] == [c[1] for c in CASES]


def test_document_round_trip(spark):
    source = '<!DOCTYPE html><html lang="en"><head><title>T &amp; U</title><meta charset="utf-8"></head><body class="k"><p>x</p></body></html>'
    out = render_html(html_nodes(page_rows(spark, [source]))).first().html
    assert out == source


def test_rendering_is_a_fixed_point(spark):
    once = body(spark, [c[0] for c in CASES])
    assert body(spark, once) == once


def test_intervals_nest():
    for source, _ in CASES:
        open_ends = []
        for pos, end, *_ in sorted(shred_html(source)):
            while open_ends and open_ends[-1] < pos:
                open_ends.pop()
            assert end >= pos and (not open_ends or end <= open_ends[-1])
            open_ends.append(end)


def test_result_does_not_depend_on_partitions(spark):
    pages = page_rows(spark, [c[0] for c in CASES])
    one = render_html(html_nodes(pages.repartition(1))).orderBy("page_id").collect()
    five = render_html(html_nodes(pages.repartition(5).orderBy(F.rand(1)))).orderBy("page_id").collect()
    assert one == five


SELECTORS = [
    ("nav a", ["1", "2"]),
    (".menu a", ["2", "3"]),
    ("#top", ["nav"]),
    ("a[href]", ["1", "2", "3", "4"]),
    ('a[rel="next"]', ["4"]),
    ('[class*="ain"] a', ["3"]),
    ('a[href^="/x"]', ["2"]),
    ('a[href$=".md"]', ["3"]),
    ('a:contains("Next")', ["4"]),
    ("nav .menu a, #foot a", ["2", "4"]),
    ("a.c.d", ["1"]),
    ("figure:empty", ["f1"]),
    ("a[[broken", []),
    ("p > a", []),
]


def test_selectors(spark):
    source = (
        '<nav id="top" data-k="nav"><a class="c d" data-k="1" href="a">A</a><div class="menu"><a data-k="2" href="/x/y">B</a></div></nav>'
        '<div class="main menu"><a data-k="3" href="z.md">C</a></div><div id="foot"><a data-k="4" rel="next" href="n">Go <i>Next</i></a></div>'
        '<figure data-k="f1"><!-- c --></figure><figure data-k="f2"> </figure>'
    )
    nodes = html_nodes(page_rows(spark, [source]))
    out = match_selectors(nodes, [s for s, _ in SELECTORS]).orderBy("pos")
    found = {}
    for r in out.select("selector_idx", F.col("attrs")["data-k"].alias("k")).collect():
        found.setdefault(r.selector_idx, []).append(r.k)
    assert [found.get(i, []) for i in range(len(SELECTORS))] == [e for _, e in SELECTORS]


@pytest.mark.parametrize("text", ["", "a >", "> a", "a > > b", "a[", "a:hover", "a,,b", "h1 + p", "li:first-child"])
def test_selectors_not_understood(text):
    assert parse_selector(text) is None
