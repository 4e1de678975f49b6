"""Selectors as tests of single rows, against matching by loops over the open elements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bindery.operators.content import remove_noise
from bindery.operators.links import link_audit
from bindery.operators.normalize import first_heading, fix_heading_hierarchy, resolve_links
from bindery.operators.render import render_html, with_link_text
from bindery.operators.selectors import Matcher, match_selectors, parse_selector
from bindery.sources import html as H
from bindery.sources.html import html_nodes, shred_html
from bindery.sources.nodes import bucketed_nodes

TAGS = "div section p span a ul li em".split()
CLASSES = ["x", "y", "x-y", "nav", "a.b"]
SELECTORS = [
    "div", ".x", "#k", "div.x", "div p", "div > p", "section div > .x", "div > section > p", ".x .y", ".x > .y > .x", "*.nav", "* > #k",
    "[title]", '[title="a b"]', '[title*="b"]', '[title^="a"]', '[title$="b"]', '[title~="b"]', '[lang|="en"]', '[class*="-"]', '[title*=""]',
    'div[title="a b"].x p', "ul > li a", '[title="a b"] > span', "#k .x, section > p", "li.y > *",
]


def random_page(seed):
    r = random.Random(seed)

    def element(depth):
        tag = r.choice(TAGS)
        attrs = ""
        if r.random() < 0.6:
            attrs += f' class="{" ".join(r.sample(CLASSES, r.randint(1, 2)))}"'
        if r.random() < 0.2:
            attrs += ' id="k"'
        if r.random() < 0.3:
            attrs += f' title="{r.choice(["a b", "ab", "b", "a", ""])}"'
        if r.random() < 0.2:
            attrs += f' lang="{r.choice(["en", "en-GB", "english", "de"])}"'
        inside = "".join(element(depth + 1) if r.random() < 0.8 else "text" for _ in range(r.randint(0, 3))) if depth < 6 else "leaf"
        return f"<{tag}{attrs}>{inside}</{tag}>"

    return "<body>" + "".join(element(0) for _ in range(4)) + "</body>"


def holds(compound, tag, attrs):
    got = lambda name: attrs.get(name)
    tests = [compound.tag in (None, tag)]
    tests += [got("id") == i for i in compound.ids]
    tests += [c in (got("class") or "").split() for c in compound.classes]
    for name, op, value in compound.attrs:
        v, have = value or "", got(name)
        tests.append(have is not None)
        if have is None or op is None:
            continue
        tests.append(
            {
                "=": have == v,
                "*=": v != "" and v in have,
                "^=": v != "" and have.startswith(v),
                "$=": v != "" and have.endswith(v),
                "~=": v in re.split(r"\s+", have),
                "|=": have == v or have.startswith(v + "-"),
            }[op]
        )
    return all(tests)


def chain_holds(chain, path):
    if not chain or not path or not holds(chain[-1], *path[-1]):
        return not chain
    if len(chain) == 1:
        return True
    if chain[-1].child:
        return chain_holds(chain[:-1], path[:-1])
    return any(chain_holds(chain[:-1], path[:i]) for i in range(1, len(path)))


def by_loops(source):
    """Per row its position, whether it is an element, its elements from the root, and the selectors it matches."""
    rows = shred_html(source)
    for row in rows:
        around = [r for r in rows if r[3] == "element" and r[0] < row[0] < r[1]]
        path = [(r[4], r[5]) for r in around] + ([(row[4], row[5])] if row[3] == "element" else [])
        yield row, path


@pytest.fixture(scope="module")
def pages():
    return [(i, random_page(i)) for i in range(30)]


@pytest.fixture(scope="module")
def nodes(spark, pages):
    rows = [("s", i, source) for i, source in pages]
    return html_nodes(spark.createDataFrame(rows, "site string, page_id long, html string")).cache()


def matches(selector, path):
    return any(chain_holds(chain, path) for chain in parse_selector(selector))


def test_selectors_match_as_loops_do(nodes, pages):
    got = {(r.page_id, r.pos, r.selector_idx) for r in match_selectors(nodes, SELECTORS).collect()}
    wanted = {
        (i, row[0], k) for i, source in pages for row, path in by_loops(source) if row[3] == "element" for k, s in enumerate(SELECTORS) if matches(s, path)
    }
    assert got == wanted
    # all but one of an empty value, and one that chance may leave out, match somewhere
    assert len({k for *_, k in wanted}) >= len(SELECTORS) - 2


def test_rows_within_matching_elements(nodes, pages):
    for some in (SELECTORS[:6], SELECTORS[6:12], SELECTORS[12:], ["p", "#k", ".nav"]):
        m = Matcher.over(nodes, some)
        got = {(r.page_id, r.pos) for r in m.nodes.filter(m.within(some)).collect()}
        wanted = {
            (i, row[0]) for i, source in pages for row, path in by_loops(source) if any(matches(s, path[:n]) for s in some for n in range(1, len(path) + 1))
        }
        assert got == wanted


def test_no_shuffle_and_no_window(nodes):
    fresh = html_nodes(nodes.select("site", "page_id", F.lit("<p>x</p>").alias("html")).distinct())
    for df in (match_selectors(fresh, SELECTORS), remove_noise(fresh, ["main > .ad .x", "p > b"], empty=False)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
        assert "Exchange" not in plan and "Window" not in plan


def test_only_link_texts_are_shuffled(nodes, pages):
    wanted = F.col("tag").isin("a", "em")
    got = {(r.page_id, r.pos): r.inner_text for r in with_link_text(nodes, F.coalesce(wanted, F.lit(False))).collect()}
    for i, source in pages:
        rows = shred_html(source)
        for row in rows:
            if row[4] in ("a", "em"):
                text = "".join(r[8] for r in rows if r[3] == "text" and row[0] < r[0] < row[1]) if row[4] == "a" else ""
                assert got[i, row[0]] == text


def test_a_stored_node_table_is_not_shuffled_again(spark, pages, nodes):
    rows = [("s", i, source, f"https://s/{i}") for i, source in pages]
    df = spark.createDataFrame(rows, "site string, page_id long, html string, url string")
    stored = bucketed_nodes(df, carry=("url",), buckets=5)
    assert stored.count() == nodes.count()
    operators = {
        "noise": render_html(remove_noise(stored)),
        "heading": first_heading(stored),
        "audit": link_audit(stored, ["a"]),
        "links": resolve_links(stored),
        "headings": fix_heading_hierarchy(stored),
    }
    for name, out in operators.items():
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString(), name
    both = operators["heading"].join(operators["audit"], ["site", "page_id"])
    assert "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
    plain = html_nodes(df, carry=("url",))
    assert sorted(map(tuple, first_heading(plain).collect())) == sorted(map(tuple, operators["heading"].collect()))
    assert sorted(map(tuple, render_html(remove_noise(plain)).collect())) == sorted(map(tuple, operators["noise"].collect()))


def test_deep_pages_and_marks_in_values(spark):
    deep = "<div>" * 2000 + "x"
    odd = f'<div title="a{H.LEVEL}b{H.PART}.x{H.PART}c"><p>t</p></div>'
    df = spark.createDataFrame([("s", 1, deep), ("s", 2, odd), ("s", 3, None)], "site string, page_id long, html string")
    rows = html_nodes(df)
    assert rows.agg(F.max(F.length("ancestors"))).first()[0] < 20 * H.MAX_LEVELS
    assert match_selectors(rows, ["div p", ".x p"]).select("page_id", "selector_idx").collect() == [(2, 0)]
    assert rows.filter("page_id = 1").count() == 2004
