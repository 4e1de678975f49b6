"""Link extraction, filters, site classification and crawling on small sites."""

from pyspark.sql import functions as F

from bindery.operators import crawl as W
from bindery.operators import links as L
from bindery.sources.html import html_nodes
from bindery.sources.profiles import Profile

BASE = "https://example.com/"
# selectors, base, html, expected (href, text) pairs
NAV = [
    ([".sidebar-nav a"], BASE, '<div class="sidebar-nav"><a href="/a">One</a><a href="/b">Two</a><a href="/c">Three</a></div>',
     [("a", "One"), ("b", "Two"), ("c", "Three")]),
    (["nav a"], BASE + "book/index.html", '<nav><a href="./intro.html">I</a><a href="/book/x">X</a><a href="/other">O</a></nav>',
     [("book/intro.html", "I"), ("book/x", "X")]),
    (["nav a"], BASE, '<nav><a href="/in">In</a><a href="https://else.org/">Out</a></nav>', [("in", "In")]),
    (["nav a"], BASE, '<nav><a href="javascript:f()">J</a><a href="mailto:x@y">M</a><a href="/ok">K</a><a>no</a></nav>', [("ok", "K")]),
    (["nav a"], BASE, '<nav><a href="/icon"><img src="i.png"></a><a href="/t"> Text </a></nav>', [("t", "Text")]),
    (["nav a"], BASE, '<nav><a href="/p">P</a><a href="/p">Again</a><a href="/p#s">Section</a></nav>', [("p", "P")]),
    ([".none a", ".toc a"], BASE, '<ul class="toc"><li><a href="/x">X <b>y</b></a></ul>', [("x", "X y")]),
    ([".b a", "nav a"], BASE, '<nav><a href="/1">1</a></nav><div class="b"><a href="/2">2</a><a href="/1">one</a></div>', [("2", "2"), ("1", "one")]),
    (["nav a"], BASE, '<nav><a href="/s.css">S</a><a href="/h" title="Hint"></a><a href="/api/x">A</a></nav>', [("h", "Hint")]),
    # an unusable first occurrence does not count as seen
    (["nav a"], BASE, '<nav><a href="/late"></a><a href="/late">Late</a></nav>', [("late", "Late")]),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "site string, page_id long, url string, html string")


def test_nav_links(spark):
    for selectors in {tuple(n[0]) for n in NAV}:
        group = [n for n in NAV if tuple(n[0]) == selectors]
        df = pages(spark, [("s", i, n[1], n[2]) for i, n in enumerate(group)])
        out = L.extract_nav_links(html_nodes(df, carry=("url",)), list(selectors)).orderBy("page_id", "order").collect()
        for i, n in enumerate(group):
            mine = [r for r in out if r.page_id == i]
            assert [(r.href.removeprefix(BASE), r.text) for r in mine] == n[3]
            assert [r.order for r in mine] == list(range(len(mine)))


def test_links_off_site_when_asked(spark):
    df = pages(spark, [("s", 0, BASE, NAV[2][2])])
    out = L.extract_nav_links(html_nodes(df, carry=("url",)), ["nav a"], same_site_only=False)
    assert out.count() == 2


def test_selectors_per_profile(spark):
    html = '<nav><a href="/n">N</a></nav><div class="t"><a href="/t">T</a></div>'
    df = pages(spark, [("a", 0, BASE, html), ("b", 1, BASE, html)]).withColumn("profile", F.col("site"))
    links = L.extract_nav_links(html_nodes(df, carry=("url", "profile")), {"a": [".t a", "nav a"], "b": ["nav a"]})
    got = {k: [r.text for r in links.filter(f"site = '{k}'").orderBy("order").collect()] for k in "ab"}
    assert got == {"a": ["T", "N"], "b": ["N"]}


def test_all_links_and_chapter_links(spark):
    html = (
        '<header><a href="/">Home</a></header><main><a href="/one">Chapter One</a><a href="/two">x</a></main>'
        '<footer><a href="/t">Terms of use</a><a href="/s.js">S</a><a href="/e"></a><a href="/tw">Twitter</a><a href="/si">Sign in</a></footer>'
    )
    links = L.extract_all_links(html_nodes(pages(spark, [("s", 0, BASE, html)]), carry=("url",)))
    assert [r.text for r in links.orderBy("order").collect()] == ["Home", "Chapter One", "x", "Terms of use", "", "Twitter", "Sign in"]
    assert [r.text for r in L.filter_chapter_links(links).collect()] == ["Chapter One"]


def test_link_audit(spark):
    html = (
        '<nav><a>none</a><a href="#x">h</a><a href="/a">A</a><a href="/a#b">A</a><a href="https://o.org/">O</a>'
        '<a href="/z.png">Z</a><a href="/q"></a></nav>'
    )
    row = L.link_audit(html_nodes(pages(spark, [("s", 0, BASE, html)]), carry=("url",))).first()
    names = ("matched", "no_href", "unresolvable", "duplicate", "off_site", "asset", "no_text", "page_links", "anchor_links")
    assert [row[n] for n in names] == [7, 1, 1, 1, 1, 1, 1, 1, 0]


def test_profiles_and_strategy(spark):
    rows = [
        ("a", 0, "https://x.github.io/b/", "<p>x"),
        ("b", 1, "https://x.org/", "<script src=gitbook.js></script>"),
        ("c", 2, "https://jekyllrb.com/", '<div class="sidebar">'),
        ("d", 3, "https://x.org/", '<a rel="next" href="2">'),
        ("e", 4, "https://x.org/", "<p>x"),
        ("f", 5, "https://x.org/", '<ul ID="TOC">'),
        ("g", 6, "https://raw.githubusercontent.com/", "x"),
    ]
    df = pages(spark, rows)
    out = L.select_strategy(df, L.has_pagination(html_nodes(df))).orderBy("page_id").collect()
    assert [(r.profile, r.strategy) for r in out] == [
        ("docsify", "sidebar"), ("gitbook", "sidebar"), ("jekyll", "sidebar"), ("default", "pagination"),
        ("default", "auto"), ("default", "sidebar"), ("github-pages", "sidebar"),
    ]


def test_next_link(spark):
    htmls = [
        '<a href="x">Next</a><a rel="next" href="r">go</a>',
        '<a rel="next" href="#">go</a><a rel="next" href="r2">go</a><a class="next" href="c">n</a>',
        '<div class="next"><a href="d">n</a></div>',
        '<button aria-label="Next">n</button>',
        "<p>Next</p>",
        '<a href="p">weiter »</a>',
    ]
    df = pages(spark, [("s", i, BASE, h) for i, h in enumerate(htmls)])
    out = {r.page_id: r.next_url.removeprefix(BASE) for r in L.find_next_link(html_nodes(df, carry=("url",))).collect()}
    assert out == {0: "r", 1: "c", 2: "d", 5: "p"}


def chain_site(site, n, loop_to=None):
    """Pages 1..n of a site, each naming the next; the last may point back."""
    rows = []
    for i in range(n):
        to = i + 1 if i + 1 < n else loop_to
        link = "" if to is None else f'<a rel="next" href="/p{to}">next</a>'
        rows.append((site, 1000 * (ord(site) - 96) + i, f"https://{site}.org/p{i}", f"<title>{site}{i}</title><p>{link}"))
    return rows


def test_follow_chain(spark):
    rows = chain_site("a", 40) + chain_site("b", 7, loop_to=3) + chain_site("c", 1)
    df = pages(spark, rows)
    chain, missing = W.crawl_pagination(df.filter("url like '%/p0'"), df, W.page_index(df))
    got = {}
    for r in chain.orderBy("site", "order").collect():
        got.setdefault(r.site, []).append((r.page_id % 1000, r.order))
    assert got == {"a": [(i, i) for i in range(40)], "b": [(i, i) for i in range(7)], "c": [(0, 0)]}
    assert missing.count() == 0


def test_long_chains_are_followed_to_their_end(spark):
    edges = spark.range(1206).selectExpr("'s' site", "id page_id", "id + 1 next_id").filter("page_id < 1205")
    seeds = spark.createDataFrame([("s", 5)], "site string, page_id long")
    out = W.follow_chain(seeds, edges)
    assert (out.count(), out.agg(F.max("page_id")).first()[0], out.agg(F.max("order")).first()[0]) == (1201, 1205, 1200)


def test_crawl_sites(spark):
    side = [
        ("s", 1, "https://s.org/", '<title>Seed</title><div class="sidebar"><a href="/b">Bee</a><a href="/a/">Ay</a><a href="/lost">Lost</a></div>'),
        ("s", 2, "https://s.org/a", "<p>a"),
        ("s", 3, "https://s.org/b", "<title>B page</title>"),
        ("s", 4, "https://s.org/unlinked", "<p>u"),
    ]
    own = [
        ("o", 10, "https://o.org/", '<div class="sidebar"><a href="/x">Xx</a><a href="/">Start here</a></div>'),
        ("o", 11, "https://o.org/x", "<p>x"),
    ]
    plain = [
        ("p", 20, "https://p.org/", '<p><a href="/y">Why</a><a href="/">Start here</a></p>'),
        ("p", 21, "https://p.org/y", "<p>y"),
    ]
    walk = [(s, i + 100, u, h) for s, i, u, h in chain_site("w", 3)]
    df = pages(spark, side + own + plain + walk)
    crawled, errors = W.crawl_sites(df)
    got = [(r.site, r.order, r.url.split("/")[-1], r.title) for r in crawled.orderBy("site", "order").collect()]
    assert got == [
        ("o", 0, "x", "Xx"), ("o", 1, "", "Start here"),
        ("p", 0, "", ""), ("p", 1, "y", "Why"),
        ("s", 0, "", "Seed"), ("s", 1, "b", "B page"), ("s", 2, "a", "Ay"),
        ("w", 0, "p0", "w0"), ("w", 1, "p1", "w1"), ("w", 2, "p2", "w2"),
    ]
    assert [tuple(r) for r in errors.collect()] == [("s", "https://s.org/lost", "CRAWL_FAILED")]


def test_crawl_of_missing_site(spark):
    df = pages(spark, [("s", 1, "https://s.org/", "<p>x")])
    seeds = spark.createDataFrame([("s", 1), ("gone", 9)], "site string, page_id long")
    _, errors = W.crawl_sites(df, seeds)
    assert [tuple(r) for r in errors.collect()] == [("gone", None, "NO_CHAPTERS_FOUND")]


def test_crawl_with_a_user_profile(spark):
    mine = Profile("mine", url_patterns=[""], strategy="pagination", next_selector="a.more")
    rows = [("s", 1, "https://s.org/1", '<a class="more" href="2">m</a>'), ("s", 2, "https://s.org/2", '<a rel="next" href="3">'), ("s", 3, "https://s.org/3", "")]
    crawled, _ = W.crawl_sites(pages(spark, rows), profiles=[mine])
    assert [r.page_id for r in crawled.orderBy("order").collect()] == [1, 2]


def test_canonical_pages(spark):
    rows = [("s", 3, "https://s.org/a/", "3"), ("s", 2, "https://s.org/a#x", "2"), ("s", 5, "https://s.org/a?b", "5"), ("t", 1, "https://s.org/a", "1")]
    assert sorted(r.page_id for r in W.canonical_pages(pages(spark, rows)).collect()) == [1, 2, 5]
