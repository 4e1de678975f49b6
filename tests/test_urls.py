"""URL functions against values worked out from the URL standard."""

from pyspark.sql import functions as F

from bindery.functions import urls as U

RESOLVE = [
    ("./x", "http://EX.com:80/a/b.html", "http://ex.com/a/x"),
    ("intro.html", "https://example.com/book/index.html", "https://example.com/book/intro.html"),
    ("/über c?q=ä b", "https://e.org/x", "https://e.org/%C3%BCber%20c?q=%C3%A4%20b"),
    ("//h.org/../a/./b/..", "http://e.org", "http://h.org/a/"),
    ("?z=1", "http://e.org/p/q?x", "http://e.org/p/q?z=1"),
    (" MAILTO:x", "http://e.org", ""),
    ("javascript:void(0)", "http://e.org", ""),
    ("#top", "http://e.org", ""),
    ("", "http://e.org/z", "http://e.org/z"),
    ("../../../up", "http://e.org/a/b/c", "http://e.org/up"),
    ("HTTP:foo", "http://e.org/a/b", "http://e.org/a/foo"),
    ("https://E.org:443/a\\b", "http://e.org", "https://e.org/a/b"),
    ("http://", "http://e.org", ""),
    ("http://a b/", "http://e.org", ""),
    ("http://e.org:99999/", "http://e.org", ""),
    ("x", "nope", ""),
    ("/a/%2e%2E/b", "http://e.org", "http://e.org/b"),
    ("/a%zz", "http://e.org", "http://e.org/a%zz"),
    ("tag:x", "http://e.org", "tag:x"),
    ("\n/a\tb", "http://e.org", "http://e.org/ab"),
]
NORMALIZE = [
    ("http://e.org/p/?b=1&a=2&&b=0&a=%20x+y&c#f", "http://e.org/p?a=2&a=+x+y&b=1&b=0&c="),
    ("http://e.org", "http://e.org/"),
    ("http://e.org/a/", "http://e.org/a"),
    ("http://e.org/a//", "http://e.org/a/"),
    ("http://e.org/a?", "http://e.org/a"),
    ("http://e.org/?q=100%", "http://e.org/?q=100%25"),
    ("nonsense", "nonsense"),
]
KEYS = [
    # url, path id, base url, title
    ("https://www.my-book.com/docs/user_guide-x/index.html", "index", "https://www.my-book.com/docs/user_guide-x/", "User Guide X"),
    ("https://mybook.com/", "index", "https://mybook.com/", "mybook"),
    ("http://e.org/A--B c.HTML", "a-b-20c", "http://e.org/", "e"),
    ("http://e.org/a/b/?q#h", "b", "http://e.org/a/b/", "B"),
    ("http://e.org/-x-/", "x", "http://e.org/-x-/", " X "),
    ("not", "page", "not", "Untitled"),
    ("https://example.com/docs/api_reference/", "api-reference", "https://example.com/docs/api_reference/", "Api Reference"),
]
SITES = [
    ("http://e.org/en/a", "http://e.org/en/b", True, True),
    ("http://e.org/enau", "http://e.org/en/b", True, False),
    ("http://e.org/fr", "http://e.org/en/b", False, False),
    ("http://e.org/fr", "http://e.org/x", True, True),
    ("https://e.org/en/a", "http://e.org/en/b", False, False),
    ("http://e.org.evil/", "http://e.org", False, False),
    ("http://u@e.org/en/a", "http://e.org/en/", True, True),
    ("bad", "http://e.org", False, False),
]
KINDS = [
    ("http://e.org/a.PNG?x", True, False),
    ("http://e.org/a.css", False, False),
    ("http://e.org/img/x", False, False),
    ("http://e.org/a.html", False, True),
    ("http://e.org/a?f=a.png", False, True),
    ("pic.jpg", True, False),
]


def check(spark, cases, columns, expected, **exprs):
    names = [c.split()[0] for c in columns.split(", ")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"case int, {columns}")
    rows = df.select("case", *[e.alias(n) for n, e in exprs.items()]).collect()
    got = [tuple(r[1:]) for r in sorted(rows)]
    assert got == [tuple(c[names.index(n)] for n in expected) for c in cases]


def test_resolve(spark):
    check(spark, RESOLVE, "h string, b string, e string", ["e"], out=U.resolve_url(F.col("h"), F.col("b")))


def test_normalize(spark):
    check(spark, NORMALIZE, "u string, e string", ["e"], out=U.normalize_url(F.col("u")))


def test_normalize_is_idempotent(spark):
    # two slashes at the end lose one each time
    urls = [u for u, _ in NORMALIZE if not u.endswith("//")] + [e for *_, e in RESOLVE]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    once = U.normalize_url(F.col("u"))
    assert df.filter(U.normalize_url(once) != once).count() == 0


def test_keys(spark):
    u = F.col("u")
    check(
        spark, KEYS, "u string, p string, b string, t string", ["p", "b", "t"],
        p=U.path_id(u), b=U.base_url(u), t=U.title_from_url(u),
    )


def test_same_site(spark):
    u, b = F.col("u"), F.col("b")
    check(
        spark, SITES, "u string, b string, s boolean, t boolean", ["s", "t"],
        s=U.is_same_site(u, b), t=U.is_same_site(u, b, strict=True),
    )


def test_kinds(spark):
    u = F.col("u")
    check(spark, KINDS, "u string, i boolean, c boolean", ["i", "c"], i=U.is_image_url(u), c=U.is_content_url(u))


def test_validity(spark):
    rows = [("http://e.org", True, True, "http://e.org/"), ("mailto:a", True, False, None), ("x", False, False, None), ("", False, False, None)]
    u = F.col("u")
    check(
        spark, rows, "u string, v boolean, h boolean, k string", ["v", "h", "k"],
        v=U.is_valid_url(u), h=U.is_http_url(u), k=U.http_url(u),
    )


def test_origin(spark):
    rows = [("http://u:p@E.org:8080/x", "http://e.org:8080"), ("mailto:a", "null"), ("x", None)]
    check(spark, rows, "u string, o string", ["o"], o=U.url_origin(F.col("u")))
