"""Noise removal, content selection, clean-up and normalisation on small documents."""

import pytest
from pyspark.sql import functions as F

from bindery.operators import content as C
from bindery.operators import images as I
from bindery.operators import normalize as N
from bindery.operators.quality import fail_fast, split_errors
from bindery.operators.render import render_html
from bindery.sources.html import html_nodes
from bindery.sources.profiles import PRESETS, Profile

URL = "https://example.com/book/page.html"
LONG = "This is the main content of the chapter, long enough to count as content for the book."


def pages(spark, htmls, url=URL):
    return spark.createDataFrame([("s", i, url, h) for i, h in enumerate(htmls)], "site string, page_id long, url string, html string")


def bodies(spark, htmls, operator, url=URL):
    nodes = html_nodes(pages(spark, htmls, url), carry=("url",))
    return [r.html for r in render_html(operator(nodes), scope="body").orderBy("page_id").collect()]


NOISE = [
    ('<p>Content</p><script>alert(1)</script><noscript>n</noscript><style>x</style>', "<p>Content</p>"),
    ('<nav><a href="/">Home</a></nav><main><p>Main</p></main><footer><p>C</p></footer>', "<main><p>Main</p></main>"),
    ('<p>A</p><div class="social-share x">S</div><div class="share-buttons"><button>B</button></div>', "<p>A</p>"),
    ('<div class="ad">Buy</div><p>Real</p><aside class="ads">More</aside><i class="adx">k</i>', '<p>Real</p><i class="adx">k</i>'),
    ('<div class="comments"><p>u</p></div><div id="disqus_thread"></div><p>k</p>', "<p>k</p>"),
    ('<p class="x-sponsored">s</p><p hidden>h</p><p aria-hidden="true">a</p><p aria-hidden="false">k</p>', '<p aria-hidden="false">k</p>'),
    ('<link rel="stylesheet" href="a"><p>t<!-- c --></p>', "<p>t</p>"),
    ('<p>Real</p><p></p><div> \n </div><span> </span><p>More</p>', "<p>Real</p><p>More</p>"),
    ('<p><img src="i.png"></p><div></div><p>T</p>', '<p><img src="i.png"></p><p>T</p>'),
    ('<div><section><p> </p><article></article></section><!-- c --></div><div><br></div>', "<div><br></div>"),
    ('<div class="mine">m</div><div class="keep">k</div>', '<div class="keep">k</div>'),
]


def test_remove_noise(spark):
    got = bodies(spark, [h for h, _ in NOISE], lambda n: C.remove_noise(n, [".mine"]))
    assert got == [e for _, e in NOISE]


def test_remove_noise_options(spark):
    html = '<nav>n</nav><div class="mine">m</div><p></p><!-- c -->'
    only = lambda n: C.remove_noise(n, [".mine"], merge=False, empty=False, comments=False)
    assert bodies(spark, [html], only) == ["<nav>n</nav><p></p><!-- c -->"]


def brute_empty(tree):
    """Repeated removal, as a model: drop leaves among the five tags until nothing changes."""
    tag, children = tree
    kept = [c if isinstance(c, str) else brute_empty(c) for c in children]
    kept = [c for c in kept if c is not None]
    text = "".join(c for c in kept if isinstance(c, str)).strip()
    if tag in C.MAY_BE_EMPTY and not text and not any(not isinstance(c, str) for c in kept):
        return None
    return (tag, kept)


def write(tree):
    tag, children = tree
    return f"<{tag}>" + "".join(c if isinstance(c, str) else write(c) for c in children) + f"</{tag}>"


def test_empty_elements_match_repeated_removal(spark):
    import random

    rnd = random.Random(7)

    def grow(depth):
        kids = [grow(depth - 1) if rnd.random() < 0.6 and depth else rnd.choice([" ", "x", "", "\n"]) for _ in range(rnd.randint(0, 3))]
        return (rnd.choice(["div", "span", "section", "b", "article"]), kids)

    trees = [("main", [grow(5) for _ in range(3)]) for _ in range(150)]
    got = bodies(spark, [write(t) for t in trees], C.remove_empty_elements)
    assert got == [write(brute_empty(t)) for t in trees]


def test_attribute_operators(spark):
    html = '<p onclick="f()" ondrag="g" data-x="1" id="k">t</p>'
    assert bodies(spark, [html], C.remove_event_attrs) == ['<p ondrag="g" data-x="1" id="k">t</p>']
    assert bodies(spark, [html], C.remove_data_attrs) == ['<p onclick="f()" ondrag="g" id="k">t</p>']


PARSE = [
    # html, title, content starts with / None for an error, number of images
    (f"<title>T</title><nav>N</nav><article><h1> Chapter <b>One</b> </h1><p>{LONG}</p></article>", "Chapter One", "<h1>", 0),
    (f"<header><h1>H</h1></header><main><h1>Main</h1><p>{LONG}</p></main>", "Main", "<h1>Main", 0),
    (f"<title>Page Title | My Site</title><article><p>{LONG}</p></article>", "Page Title", "<p>This", 0),
    (f"<title>A - B - C</title><article><p>{LONG}</p></article>", "A - B", "<p>This", 0),
    (f"<article><p>{LONG}</p></article>", "Untitled", "<p>This", 0),
    (f'<article><h1>I</h1><p>{LONG}<img src="/a.jpg" alt="A"><img src="https://x.org/b.png"><img src="/a.jpg"><img src="data:x"><img></p></article>', "I", "<h1>", 2),
    # too short for the selectors: the longest block, then the body
    (f'<article>short</article><section><p>{LONG} {LONG}</p></section><div class="post">{LONG}</div>', "Untitled", "<p>This", 0),
    ("<article>short</article><section>tiny</section><p>Not enough text for a block, but enough for a body.</p>", "Untitled", "<article>short", 0),
    ("<p>hi</p>", "Untitled", None, None),
    (f'<article><h1></h1><h1>Second</h1><p>{LONG}</p></article><p class="title">By class</p>', "By class", "<h1>", 0),
    (f'<article><p>{LONG}</p><a href="/e"> </a><a href="/i"><img src="i.png"></a>  x\t y</article>', "Untitled", "<p>This", 1),
]


def test_parse_pages(spark):
    out = C.parse_pages(pages(spark, [p[0] for p in PARSE])).orderBy("page_id").collect()
    for row, (_, title, start, images) in zip(out, PARSE, strict=True):
        assert row.title == title
        if start is None:
            assert (row.content, row.error_code) == (None, "NO_CONTENT_FOUND")
        else:
            assert row.content.startswith(start) and row.error_code is None
            assert len(row.images) == images
    assert [i.original_url for i in out[5].images] == ["/a.jpg", "https://x.org/b.png"]
    assert out[5].images[0].alt_text == "A" and out[5].images[0].original_html == '<img src="/a.jpg" alt="A">'
    assert out[10].content.endswith('<a href="/i"><img src="i.png"></a> x y')


def test_profiles_choose_their_selectors(spark):
    html = f'<div class="page-inner"><section class="normal"><h1>G</h1><p>{LONG}</p></section></div><article><h1>D</h1><p>{LONG}</p></article>'
    df = pages(spark, [html, html]).withColumn("profile", F.expr("if(page_id = 0, 'gitbook', 'default')"))
    out = C.parse_pages(df).orderBy("page_id").collect()
    assert ["<h1>G" in out[0].content, "<h1>D" in out[1].content] == [True, True]
    mine = Profile("mine", url_patterns=[""], content=[".page-inner"], title=["article h1"])
    row = C.parse_pages(pages(spark, [html]), [mine]).first()
    assert row.title == "D" and row.content.startswith("<section")
    assert set(PRESETS) == {"default", "docsify", "gitbook", "jekyll", "github"}


def test_every_page_is_good_or_rejected(spark):
    df = pages(spark, [p[0] for p in PARSE])
    good, bad = split_errors(C.parse_pages(df))
    ids = [r.page_id for r in good.collect()] + [r.page_id for r in bad.collect()]
    assert sorted(ids) == list(range(len(PARSE)))
    with pytest.raises(Exception, match="NO_CONTENT_FOUND"):
        fail_fast(C.parse_pages(df)).select("page_id").collect()
    assert fail_fast(good.withColumn("error_code", F.lit(None).cast("string"))).count() == len(PARSE) - 1


def test_clean_content(spark):
    df = spark.createDataFrame(
        [("s", 0, '<div><p>First</p>\n\n \n\n<p>Second</p><script>x</script><a href="/1">k</a><a href="/2"></a><a href="/3"><img src="i"></a> \t z</div>')],
        "site string, page_id long, content string",
    )
    out = C.clean_content(df).first().content
    assert out == '<div><p>First</p>\n\n<p>Second</p><a href="/1">k</a><a href="/3"><img src="i"></a> z</div>'


def test_clean_html(spark):
    html = (
        '<p style="x" data-a="1" onload="f" ONCLICK="g" foo="b" id="i" aria-label="l" class=" ">t</p><font color="r" title="k">f</font>'
        '<center>c</center><my-tag id="m" role="x" aria-a="1"><tt>q</tt></my-tag><a href="h" target="_b">l</a>'
    )
    assert bodies(spark, [html], N.clean_html) == [
        '<p id="i" aria-label="l">t</p><span title="k">f</span><span>c</span><div id="m"><span>q</span></div><a href="h">l</a>'
    ]


HEADINGS = [
    ("<h1>a</h1><h3>b</h3><h5>c</h5>", "123", "123"),
    ("<h2>a</h2><h3>b</h3><h4>c</h4>", "123", "123"),
    ("<h3>a</h3><h1>b</h1><h3>c</h3>", "212", "111"),
    ("<h1>a</h1><h2>b</h2>", "12", "12"),
    ("<p>x</p>", "", ""),
    ("<h4>a</h4><h6>b</h6><h2>c</h2>", "231", "121"),
]


def test_headings(spark):
    import re

    htmls = [h for h, *_ in HEADINGS]
    for operator, at in ((N.fix_heading_hierarchy, 1), (N.normalize_chapter_headings, 2)):
        got = bodies(spark, htmls, operator)
        assert ["".join(re.findall(r"<h(\d)", g)) for g in got] == [h[at] for h in HEADINGS]
        assert bodies(spark, got, operator) == got
    kept = bodies(spark, ['<h2 id="x" class="c">a <b>b</b></h2>'], N.fix_heading_hierarchy)
    assert kept == ['<h1 id="x" class="c">a <b>b</b></h1>']


def test_first_heading(spark):
    out = N.first_heading(html_nodes(pages(spark, ["<p>x</p><h3> a <i>b</i> </h3><h1>c</h1>", "<p>none</p>"])))
    assert [r.heading for r in out.orderBy("page_id").collect()] == ["a b", None]


LINKS = (
    '<a href="#x">anchor</a><a href="mailto:m">ma<b>i</b>l</a><a href="https://o.org/">out <i>side</i></a>'
    '<a href="two.html" title="t">in</a><a href="/other">up</a><a>none</a>'
)


def test_resolve_links(spark):
    assert bodies(spark, [LINKS], N.resolve_links) == [
        '<a href="#x">anchor</a><span>mail</span><span>out side</span>'
        '<a href="https://example.com/book/two.html" title="t">in</a><span>up</span><a>none</a>'
    ]
    strict = lambda n: N.resolve_links(n, remove_external=True, remove_anchors=True)
    assert bodies(spark, [LINKS], strict) == [
        '<span>anchor</span><span>mail</span><a href="https://example.com/book/two.html" title="t">in</a><a>none</a>'
    ]
    keep = lambda n: N.resolve_links(n, convert_external=False)
    assert '<a href="https://o.org/">out <i>side</i></a>' in bodies(spark, [LINKS], keep)[0]


def test_image_urls(spark):
    html = (
        '<img src="a.png" srcset="b.png 1x,/c.png  2x, data:x 3x"><picture><source srcset="d.png 10w"></picture>'
        '<img src="data:k"><img alt="n">'
    )
    assert bodies(spark, [html], N.resolve_image_urls) == [
        '<img src="https://example.com/book/a.png" srcset="https://example.com/book/b.png 1x, https://example.com/c.png 2x, data:x 3x">'
        '<picture><source srcset="https://example.com/book/d.png 10w"></picture><img src="data:k"><img alt="n">'
    ]


def test_strip_links_and_images(spark):
    assert bodies(spark, ['<a href="x">t <b>u</b></a><a href="y"></a><a href="z"><img src="i"></a>'], N.strip_links) == [
        '<span>t <b>u</b></span><span><img src="i"></span>'
    ]
    html = '<figure><img src="x"></figure><figure><img src="y">t</figure><picture><img></picture><figure><!-- c --></figure><p><img></p>'
    assert bodies(spark, [html], I.remove_images) == ["<figure>t</figure><p></p>"]


def test_normalize_pages(spark):
    df = pages(spark, ["x"]).withColumn("content", F.lit('<h2 style="s">T</h2><p><a href="two.html">in</a><img src="a.png" srcset="b 1x"><font>f</font></p>'))
    out = N.normalize_pages(df).first()
    assert out.content == (
        '<h1>T</h1><p><a href="https://example.com/book/two.html">in</a><img src="https://example.com/book/a.png"><span>f</span></p>'
    )


def test_image_catalog_and_references(spark):
    html = '<img src="/a.png" srcset="x 1x"><img src="b.png"><img src="/a.png">'
    nodes = html_nodes(pages(spark, [html, html]), carry=("url",))
    refs = nodes.filter("tag = 'img'").select("site", "url", F.col("attrs")["src"].alias("original_url"))
    catalog = I.image_catalog(refs, format="png")
    assert catalog.count() == 2 and {r.mime_type for r in catalog.collect()} == {"image/png"}
    known = catalog.filter("url like '%/a.png'")
    name = known.first().filename
    done = render_html(I.update_image_refs(nodes, known), scope="body").collect()
    assert {r.html for r in done} == {f'<img src="images/{name}"><img src="b.png"><img src="images/{name}">'}
    assert sorted(r.image_url for r in I.extract_image_urls(nodes.filter("page_id = 0")).collect()) == [
        "https://example.com/a.png", "https://example.com/book/b.png",
    ]


def test_match_images(spark):
    catalog = spark.createDataFrame(
        [("s", "https://e.org/p/a.png", "A", "fa.jpg", 0), ("s", "https://e.org/q/a.png", "B", "fb.jpg", 1), ("s", "z.png", "C", "fc.jpg", 2)],
        "site string, url string, image_id string, filename string, order int",
    )
    asked = ["https://e.org/q/a.png", "../x/fb.jpg", "a.png", "q/a.png", "http://h/z.png", "none.gif"]
    refs = spark.createDataFrame([("s", u) for u in asked], "site string, url string")
    got = {r.url: (r.image_id, r.tier) for r in I.match_images(refs, catalog).collect()}
    assert got == {
        asked[0]: ("B", 1), asked[1]: ("B", 2), asked[2]: ("A", 3), asked[3]: ("B", 3), asked[4]: ("C", 3), asked[5]: (None, None),
    }
