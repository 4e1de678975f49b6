"""One shred from page to content, held against parsing and normalising one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from bindery.operators.clean import clean_pages
from bindery.operators.content import parse_pages
from bindery.operators.normalize import normalize_pages
from bindery.sources.pages import read_pages
from bindery.sources.profiles import Profile

SCHEMA = "site string, page_id long, url string, html string"
PIECES = [
    "text here ", "\n\n \n\n", "  \t ", "&nbsp;", " a &lt; b &amp; c ", "<b>bold  text</b>", "<p>para <i>x</i>", "</p>", "<div class='  '>", "</div>", "<ul><li>one<li>two</ul>",
    "<h1>One</h1>", "<h3>Three</h3>", "<h6>Six</h6>", "<a href='/in'>in</a>", "<a href='https://other.org/x'>out <em> of </em>  here</a>", "<a href='https://other.org/'> <img src='i.png'> </a>",
    "<a href='mailto:x'>m <!-- c --> n <script>s</script> o</a>", "<a href='#f'>f</a>", "<a href=''></a>", "<a></a>", "<img src='a.png' alt=' two  words '>", "<img src='data:x'>", "<span></span>",
    "<font color=red>old <blink>x</blink></font>", "<script>if (a < b) {}</script>", "<style>p {}</style>", "<nav>menu</nav>", "<p class='ad'>advert</p>", "<!-- note -->", "<br>", "<pre>\n  code\n\n\n\n  more</pre>",
    "<table><tr><td>cell<td>other</table>", "<div hidden>gone</div>", "<meta name=x>", "<link rel=next href=y>", "<p title='a \t b\n\n\n\nc' style='x' data-k=1 onclick=f()>attrs</p>", "<textarea> a\n\n\n\nb </textarea>",
]


def random_page(seed):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice(PIECES) for _ in range(n))
    head = r.choice(["", "<title>Site page | Site</title>", "<title> </title><meta charset=utf-8>"])
    shapes = [
        "{0}",
        "<article>{0}</article>",
        "<main>{0}</main><section>{1}</section>",
        "<div class=content>{0}</div>{1}",
        "<div class=post>{1}</div><article>{0}</article>",
        "<link rel=x href=y><title>In body</title> {0}",
        "<article><meta name=a> \n <base target=q>{0}</article>",
        "<article>\n\n\n\n {0} \n\n\n</article>",
    ]
    body = r.choice(shapes).format(some(r.randint(0, 25)), some(r.randint(0, 6)))
    return f"<html><head>{head}</head><body>{body}</body></html>"


def compare(pages, **options):
    two = normalize_pages(parse_pages(pages, options.get("profiles")), remove_external=options.get("remove_external", False))
    columns = ["page_id", "url", "profile", "crawl_title", "title", "content", "images", "error_code"]
    wanted = {r.page_id: r for r in two.select(columns).collect()}
    got = {r.page_id: r for r in clean_pages(pages, **options).select(columns).collect()}
    assert got.keys() == wanted.keys()
    for i, row in wanted.items():
        assert got[i] == row, (i, row.content, got[i].content)
    return wanted


@pytest.mark.parametrize("external", [False, True])
def test_random_pages(spark, external):
    rows = [(f"s{i % 3}", i, f"https://s{i % 3}.org/d/{i}.html", random_page(1000 * external + i)) for i in range(400)]
    rows += [("s0", 900, "https://s0.org/e", ""), ("s0", 901, "https://s0.org/n", None), ("s0", 902, "not a url", random_page(5))]
    found = compare(spark.createDataFrame(rows, SCHEMA), remove_external=external)
    assert len({r.error_code for r in found.values()}) == 2


def test_given_pages_and_a_profile(spark):
    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    compare(pages)
    compare(pages, profiles=[Profile("mine", url_patterns=["."], content=["body > article"], title=["h1"], exclude=["p > b"])])


def test_one_shred_and_one_shuffle(spark):
    pages = spark.createDataFrame([("s", 1, "https://s.org/", random_page(3), 7)], SCHEMA + ", order int")
    df = clean_pages(pages, carry=("order",))
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1
    assert df.select(F.col("order")).first()[0] == 7


@pytest.mark.parametrize("exclude", [["x"], ["p:empty"]])
def test_parts_grow_with_the_html(spark, monkeypatch, exclude):
    pages = spark.createDataFrame([("s", i, f"https://s.org/{i}", random_page(i) + "<p>more</p>" * 90) for i in range(60)], SCHEMA)
    mine = [Profile("mine", url_patterns=["."], exclude=exclude)]
    cuts = {"parse": lambda: parse_pages(pages, mine), "clean": lambda: clean_pages(pages, mine)}
    whole = {n: sorted(cut().select("page_id", "title", "content", "error_code").collect()) for n, cut in cuts.items()}
    # as if the table were larger
    monkeypatch.setattr("bindery.sources.nodes.SLICE_CHARS", 1500)
    for n, cut in cuts.items():
        out = cut()
        assert out.rdd.getNumPartitions() >= 40
        assert sorted(out.select("page_id", "title", "content", "error_code").collect()) == whole[n]
