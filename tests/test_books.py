"""Chapters, order, tables of contents, metadata, sinks and the whole corpus."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bindery.functions import strings as S
from bindery.operators import book as B
from bindery.operators import chapters as H
from bindery.operators.scan import lookup, ordered_scan
from bindery.plans.corpus import build_book_corpus
from bindery.sources import profiles as P
from bindery.sources.sinks import read_book_table

PAGE = "site string, page_id long, url string, title string, content string, order int"
TEXT = "<p>" + "Enough text to count as a chapter of the book. " * 2 + "</p>"


def site(spark, titles, orders=None, url="https://example.com/p{}.html"):
    rows = [("s", i, url.format(i), t, TEXT, i if orders is None else orders[i]) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, PAGE)


def values(df, column, by="order"):
    return [r[column] for r in df.orderBy("site", by, "page_id").collect()]


TITLES = [
    ("  Plain  ", "Plain"), ("A <b>bold</b> one", "A bold one"), ("Q&A \"x\" 'y' <z", "QA x y z"), ("a\n\t b  c", "a b c"),
    ("", "Untitled"), (None, "Untitled"), ("<p>", "Untitled"), ("x" * 300, "x" * 200), ("y" * 199 + " zz", "y" * 199),
]


def test_sanitize_title(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TITLES)], "i int, t string")
    assert [r.o for r in df.select("i", S.sanitize_title(F.col("t")).alias("o")).orderBy("i").collect()] == [e for _, e in TITLES]


def numbered(titles, clean):
    """The counter rule as a loop."""
    seen, out = {}, []
    for t in titles:
        c = clean(t)
        n = seen.get(c, 0)
        title = f"{c} ({n + 1})" if n > 0 else c
        seen[t] = n + 1
        out.append(clean(title))
    return out


@pytest.mark.parametrize("limit", [None, 5])
def test_dedupe_titles_against_a_loop(spark, limit):
    rnd = random.Random(3)
    titles = [rnd.choice(["Intro", " Intro", "<i>Intro</i>", "", "End", "Intro (2)", "z" * 200]) for _ in range(80)]

    def clean(t):
        t = re.sub("<[^>]+>", " ", t.strip())
        return re.sub(r"\s+", " ", re.sub("[<>&\"']", "", t))[:200].strip() or "Untitled"

    out = H.dedupe_titles(site(spark, titles).drop("content"), limit)
    assert values(out, "title") == numbered(titles, clean)


def test_create_chapters(spark):
    rows = [
        ("s", 1, "https://example.com/a/Intro.html", "Introduction", "<p>1</p>", 0),
        ("s", 2, "https://example.com/a/", "Introduction", "<p>2</p>", 1),
        ("s", 3, "https://example.com/index.html", 'X & "Y"', "<p>3</p>", 2),
    ]
    out = H.create_chapters(spark.createDataFrame(rows, PAGE)).orderBy("order").collect()
    assert [r.id for r in out][:2] == ["chapter-intro", "chapter-a"]
    assert re.fullmatch("chapter-3-[0-9a-f]{8}", out[2].id)
    assert [r.title for r in out] == ["Introduction", "Introduction (2)", "X Y"]
    assert "<title>Introduction (2)</title>" in out[1].content and "<body>\n  <p>2</p>\n</body>" in out[1].content
    assert H.duplicate_chapter_ids(H.create_chapters(site(spark, ["a", "b"], url="https://e.org/{}/x"))).first().uses == 2


def test_escaping(spark):
    out = spark.range(1).select(H.wrap_chapter(F.lit("c"), F.lit("<a & 'b' \"c\">")).alias("w")).first().w
    assert "<title>&lt;a &amp; &#39;b&#39; &quot;c&quot;&gt;</title>" in out


def test_valid_chapters(spark):
    contents = ["<p>x</p>", TEXT, "", "a" * 39, "a" * 40, "  " + "a" * 38 + " ", "<b " * 30, "x <i", "\n"]
    df = spark.createDataFrame([("s", i, f"https://e.org/{i}", f"T{i:04d}", c, i) for i, c in enumerate(contents)], PAGE)
    kept = {r.page_id for r in H.filter_valid_chapters(H.create_chapters(df)).collect()}
    assert kept == {1, 4, 5}
    # the short cut over keys agrees with the rule over wrapped content
    assert {r.page_id for r in H.build_chapters(df).collect()} == kept
    assert H.build_chapters(df, filter_empty=False).count() == len(contents)


@pytest.mark.parametrize("limit", [None, 2])
def test_orders(spark, limit):
    df = site(spark, ["b", "a", "c", "d"], [1, 1, 0, 5])
    out = H.resolve_duplicate_orders(df, limit=limit)
    assert values(out, "title") == ["c", "a", "b", "d"] and values(out, "order") == [0, 1, 2, 3]
    same = site(spark, ["b", "a"], [7, 3])
    assert values(H.resolve_duplicate_orders(same, limit=limit), "order") == [3, 7]
    assert values(H.normalize_order(same, limit=limit), "title") == ["a", "b"]
    assert values(H.normalize_order(same, limit=limit), "order") == [0, 1]


def test_locale_order_of_titles(spark):
    out = H.resolve_duplicate_orders(site(spark, ["b", "B", "a", "Z", "é"], [0] * 5))
    assert values(out, "title") == ["a", "b", "B", "é", "Z"]


def test_move_chapter(spark):
    df = site(spark, list("abcd"))
    for a, b, expected in ((0, 2, "bcad"), (3, 1, "adbc"), (1, 9, "acdb"), (9, 0, "abcd"), (2, 2, "abcd")):
        assert "".join(values(H.move_chapter(df, a, b, by_position=True), "title")) == expected
    # numbering by the old order undoes a move, except among equal orders
    assert "".join(values(H.move_chapter(df, 0, 2), "title")) == "abcd"
    assert "".join(values(H.move_chapter(site(spark, list("abc"), [0, 0, 0]), 0, 1), "title")) == "bac"


@pytest.mark.parametrize("limit", [None, 2])
def test_anomalies_and_sections(spark, limit):
    df = site(spark, ["Chapter 2", "x", "chapter  1: y", "Chapter 3", "The Chapter 2"])
    out = H.detect_order_anomalies(df, limit).orderBy("order").collect()
    assert [r.message for r in out] == [
        'Chapter "chapter  1: y" (order 2) appears after a higher-numbered chapter',
        'Chapter "The Chapter 2" (order 4) appears after a higher-numbered chapter',
    ]
    parts = H.group_by_section(site(spark, ["Pre", "Part I", "a", "Section 2", "b", "Part I", "Partly"]), limit)
    assert values(parts, "section") == ["Main", "Part I", "Part I", "Section 2", "Section 2", "Part I", "Part I"]
    sizes = H.section_sizes(parts).orderBy("first_order").collect()
    assert [(r.section, r.chapters) for r in sizes] == [("Main", 1), ("Part I", 4), ("Section 2", 2)]


LEVELS = [
    ("1. Introduction", 1), ("1.1 Overview", 1), ("1.2.3 Details", 2), ("Part IV: x", 0), ("CHAPTER IV", 0), ("Section 1.1", 1),
    ("Section 2.3.4", 1), ("Appendix A", 0), ("Plain", 0), ("7 Seven", 0), ("1.2", 1), (" 2.1.\tx", 2), ("3", 0), ("Sections 1", 0),
]


def test_toc_levels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LEVELS)], "i int, t string")
    assert [r.o for r in df.select("i", B.toc_level(F.col("t")).alias("o")).orderBy("i").collect()] == [v for _, v in LEVELS]


def chapters(spark, titles):
    rows = [("s", i, f"c{i}", t, TEXT, i, f"https://www.example.com/my-book/{i}") for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "site string, page_id long, id string, title string, content string, order int, source_url string")


@pytest.mark.parametrize("limit", [None, 6])
def test_toc_tree_against_a_stack(spark, limit):
    rnd = random.Random(5)
    titles = [rnd.choice(["Plain", "1. a", "1.1.1 b", "2.2.2.2 c", "Section 3"]) for _ in range(60)]
    level = {"Plain": 0, "1. a": 1, "1.1.1 b": 2, "2.2.2.2 c": 3, "Section 3": 1}
    stack, expected = [], []
    for i, t in enumerate(titles):
        while stack and stack[-1][0] >= level[t]:
            stack.pop()
        expected.append((f"c{stack[-1][1]}" if stack else None, len(stack)))
        stack.append((level[t], i))
    toc = B.hierarchical_toc(chapters(spark, titles), limit)
    assert [(r.parent_id, r.depth) for r in toc.orderBy("order").collect()] == expected
    flat = B.flatten_toc(toc, limit)
    assert [r.id for r in flat.orderBy("seq").collect()] == [f"c{i}" for i in range(60)]


def nest(rows, depth=0):
    """Nested list text of (id, title, children) by recursion."""
    pad, out = "  " * depth, []
    for i, t, kids in rows:
        link = f'<a href="{i}.xhtml">{t}</a>'
        if kids:
            out.append(f"{pad}<li>\n{pad}  {link}\n{pad}  <ol>\n{nest(kids, depth + 1)}\n{pad}  </ol>\n{pad}</li>")
        else:
            out.append(f"{pad}<li>{link}</li>")
    return "\n".join(out)


def test_toc_html(spark):
    toc = B.hierarchical_toc(chapters(spark, ["Intro", "1.1 One", "1.1.1 Deep", "2. Two", "End & more", "1.1.1 Last"]))
    tree = [("c0", "Intro", [("c1", "1.1 One", [("c2", "1.1.1 Deep", [])]), ("c3", "2. Two", [])]), ("c4", "End &amp; more", [("c5", "1.1.1 Last", [])])]
    parts = B.toc_html(toc, "My <toc>").orderBy("part").collect()
    assert [p.part for p in parts] == list(range(8))
    assert "".join(p.data for p in parts) == B.TOC_HEAD.replace("{title}", "My &lt;toc&gt;") + nest(tree) + B.TOC_TAIL


def test_toc_content_and_entries(spark):
    some = chapters(spark, ["<a>", "b"])
    rows = B.toc_content(some).orderBy("part").collect()
    assert {(r.filename, r.title, r.exclude_from_toc, r.before_toc) for r in rows} == {("toc.xhtml", "Table of Contents", True, True)}
    assert "&lt;a&gt;" in "".join(r.data for r in rows) and B.toc_content(some.filter("false")).count() == 0
    entries = B.chapters_to_content(some).orderBy("seq").collect()
    assert [(e.filename, e.title, e.exclude_from_toc) for e in entries] == [("c0.xhtml", "<a>", False), ("c1.xhtml", "b", False)]
    flat = B.flat_toc(some).orderBy("order").collect()
    assert [(f.id, f.level, f.parent_id) for f in flat] == [("c0", 0, None), ("c1", 0, None)]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_metadata(spark):
    hosts = {"https://user.github.io/r": "user", "https://m.gitbook.io/d": "GitBook", "https://p.readthedocs.io/": "Read the Docs",
             "https://www.example.com/b": "example.com", "nope": None, "https://github.io/x": "github.io"}
    for url, expected in hosts.items():
        assert one(spark, B.infer_publisher(F.lit(url))) == expected, url
    few = B.infer_metadata(chapters(spark, ["a", "b"])).first()
    assert (few.publisher, few.description) == ("example.com", "Chapters: a, b")
    many = B.infer_metadata(chapters(spark, [f"t{i}" for i in range(10)])).first()
    assert many.description == "Chapters: t0, t1, t2, t3, t4, and 5 more"
    fields = {"": None, None: None, "<b>B</b> and <i>i</i>": "B and i", "M   s\nn": "M s n", "T\x00w\x1fc\x7fx": "Twcx", "  t ": "t", "<p>": None}
    for raw, expected in fields.items():
        assert one(spark, S.sanitize_metadata_field(F.lit(raw).cast("string"))) == expected


def test_identifiers_and_names(spark):
    assert one(spark, B.book_identifier(F.lit("My Book: Title!"), F.lit("John Doe"))) == "urn:uuid:my-book-title-john-doe"
    assert one(spark, B.book_identifier(F.lit("A"), F.lit("B"), F.lit("k1"))) == "urn:uuid:a-b-k1"
    assert len(one(spark, B.book_identifier(F.lit("A" * 200), F.lit("B")))) == 109
    for title, name in (("My Book!", "my-book.epub"), ("  ", "book.epub"), ("Ünï", "n.epub"), ("a" * 150, "a" * 100 + ".epub")):
        assert one(spark, B.output_filename(F.lit(title))) == name
    for size, text in ((5, "5 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (5 << 20, "5.0 MB")):
        assert one(spark, B.format_size(F.lit(size))) == text


def test_books(spark):
    some = chapters(spark, ["First", "Second"])
    book = B.create_books(some)
    assert tuple(book.first())[:4] == ("s", "First", "Unknown", "en")
    given = spark.createDataFrame([("s", "Given", "Me", "R", bytearray(b"\x01\x02"), "image/png")],
                                  "site string, title string, author string, rights string, cover_data binary, cover_mime string")
    full = B.enrich_metadata(B.create_books(some, given=given), some)
    options = B.book_options(full, date="2024-05-06").first()
    assert (options.title, options.author, options.rights, options.publisher) == ("Given", "Me", "R", "example.com")
    assert (options.identifier, options.date, options.version) == ("urn:uuid:given-me", "2024-05-06", 3)
    assert (options.cover, options.toc_title, options.append_chapter_titles) == ("data:image/png;base64,AQI=", "Table of Contents", False)
    untitled = B.enrich_metadata(book.withColumn("title", F.lit(None).cast("string")), some).first()
    assert untitled.title == "0"
    empty = B.book_options(book.withColumn("title", F.lit("<p>")).withColumn("author", F.lit(""))).first()
    assert (empty.title, empty.author, empty.date) == ("Untitled Book", "Unknown Author", None)


def test_validation_and_report(spark):
    some = chapters(spark, ["a", "b"]).withColumn("content", F.expr("if(page_id = 1, '', content)"))
    books = B.create_books(some).unionByName(B.create_books(some).withColumn("site", F.lit("none")))
    got = sorted((r.site, r.message) for r in B.validate_books(books, some).collect())
    assert got == [("none", "Book must have at least one chapter"), ("s", 'Chapter "b" has no content')]
    row = B.build_report(some).first()
    assert (row.chapters_count, row.images_count, row.total_size, row.size_text) == (2, 0, len(TEXT), f"{len(TEXT)} B")


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_scan_against_a_loop(spark, limit):
    rnd = random.Random(limit)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i, rnd.randint(0, 9), rnd.choice([None, rnd.randint(0, 99)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id int, o int, v int")
    out = ordered_scan(df, ["g"], [F.col("o"), F.desc("id")], "pos", {"total": F.col("v")}, {"last": F.col("v")}, limit)
    got = {r.id: (r.pos, r.total, r["last"]) for r in out.collect()}
    assert set(out.columns) == {"g", "id", "o", "v", "pos", "total", "last"}
    for g in ("hot", "a", "b", None):
        pos, total, last = 0, 0, None
        for _, i, _, v in sorted([r for r in rows if r[0] == g], key=lambda r: (r[2], -r[1])):
            assert got[i] == (pos, total, last)
            pos, total, last = pos + 1, total + (v or 0), last if v is None else v


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_is_a_join(spark, how):
    left = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 50 as string)) k", "id")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("7", 3), ("other", 4)], "k string, w int")
    plain = sorted(map(str, left.join(right, "k", how).collect()))
    assert sorted(map(str, lookup(left, right, ["k"], how, hot=20).collect())) == plain
    assert sorted(map(str, lookup(left, right, ["k"], how, hot=2000).collect())) == plain


def test_profiles(spark, tmp_path):
    table = P.site_profiles(spark).orderBy("priority").collect()
    assert [r.name for r in table] == ["docsify", "gitbook", "jekyll", "github-pages", "default"]
    (tmp_path / "c.json").write_text('{"selectors": {"content": [".mine"]}, "crawlStrategy": {"type": "sidebar", "selector": ".s a"}, "imageOptions": {"quality": 50}}')
    row = P.merge_profile(P.load_profiles(spark, str(tmp_path / "c.json"))).first()
    assert (row.content, row.title, row.strategy.type, row.image_options.quality, row.image_options.format) == ([".mine"], P.DEFAULT_TITLE, "sidebar", 50, "jpeg")
    (tmp_path / "d.json").write_text("{}")
    mine = P.as_profile(P.merge_profile(P.load_profiles(spark, str(tmp_path / "d.json"))))
    assert (mine.content, mine.strategy, mine.image_options["format"]) == (P.DEFAULT_CONTENT, "auto", "jpeg")
    (tmp_path / "e.json").write_text('{"selectors": {"content": ["a:not(.x)"]}}')
    with pytest.raises(ValueError, match="INVALID_CONFIG.*a:not"):
        P.as_profile(P.merge_profile(P.load_profiles(spark, str(tmp_path / "e.json"))))


def raw_pages(spark):
    def page(site, i, title, body=TEXT, link=""):
        return (site, i, f"https://{site}/b/{title.lower()}", f"<title>{title} page</title><nav><a href='x'>x</a></nav><article><h1>{title}</h1>{body}{link}</article>")

    rows = [page("a.org", 1, "One"), page("a.org", 2, "Two", link='<img src="/i.png">'), page("b.org", 3, "Solo"), page("a.org", 4, "One")]
    rows.append(("b.org", 5, "https://b.org/b/thin", "<p>no"))
    return spark.createDataFrame(rows, "site string, page_id long, url string, html string")


def test_corpus(spark, tmp_path):
    corpus = build_book_corpus(raw_pages(spark), author="Someone")
    got = [(r.site, r.title, r.order) for r in corpus.chapters.orderBy("site", "order").collect()]
    # page 4 has the URL of page 1
    assert got == [("a.org", "One", 0), ("a.org", "Two", 1), ("b.org", "Solo", 0)]
    assert [(r.title, r.author) for r in corpus.books.orderBy("site").collect()] == [("One page", "Someone"), ("Solo page", "Someone")]
    assert sorted(tuple(r) for r in corpus.errors.collect()) == [
        ("a.org", 4, "https://a.org/b/one", "DUPLICATE_PAGE"),
        ("b.org", 5, "https://b.org/b/thin", "NO_CONTENT_FOUND"),
    ]
    assert [r.url for r in corpus.images.collect()] == ["https://a.org/i.png"]
    assert {r.site: r.images_count for r in corpus.report.collect()} == {"a.org": 1, "b.org": 0}
    corpus.write(str(tmp_path / "out"))
    back = read_book_table(spark, str(tmp_path / "out"), "chapters")
    assert back.count() == 3 and "site_bucket" in back.columns
    with pytest.raises(Exception, match="NO_CONTENT_FOUND"):
        build_book_corpus(raw_pages(spark), stop_on_error=True)


def test_every_page_is_a_chapter_or_an_error(spark):
    def page(site, i, body):
        return (site, i, f"https://{site}/{i}", f"<title>First {site}</title><article>{body}</article>")

    rows = [
        ("a", 1, "https://a/1", "<title>First bad</title><p>no"),
        page("a", 2, f"<h1>Good</h1>{TEXT}"),
        ("a", 3, "https://a/2", f"<article><h1>Copy</h1>{TEXT}</article>"),
        page("a", 4, "<h1>T</h1><p class='short'><b>few</b> <i>words</i> <u>only</u></p>"),
        ("b", 5, "https://b/5", "<title>All bad</title><p>no"),
    ]
    corpus = build_book_corpus(spark.createDataFrame(rows, "site string, page_id long, url string, html string"))
    errors = {r.page_id: r.error_code for r in corpus.errors.filter("page_id is not null").collect()}
    assert errors == {1: "NO_CONTENT_FOUND", 3: "DUPLICATE_PAGE", 4: "CHAPTER_TOO_SHORT", 5: "NO_CONTENT_FOUND"}
    assert [r.page_id for r in corpus.chapters.collect()] == [2]
    assert {r.site: r.title for r in corpus.books.collect()} == {"a": "First bad", "b": "All bad"}
    assert [r.site for r in corpus.errors.filter("page_id is null").collect()] == ["b"]
    entries = corpus.package_entries.filter("filename = 'toc.xhtml'").orderBy("part").collect()
    assert [e.part for e in entries] == [0, 1, 2] and {e.site for e in entries} == {"a"}


def test_corpus_with_links(spark):
    rows = [
        ("s", 1, "https://s.org/", f'<title>Home</title><div class="sidebar"><a href="/two">Two</a></div><article><h1>H</h1>{TEXT}</article>'),
        ("s", 2, "https://s.org/two", f"<article><h1>Second</h1>{TEXT}</article>"),
        ("s", 3, "https://s.org/three", f"<article><h1>Third</h1>{TEXT}</article>"),
    ]
    df = spark.createDataFrame(rows, "site string, page_id long, url string, html string")
    corpus = build_book_corpus(df, follow_links=True)
    assert [r.title for r in corpus.chapters.orderBy("order").collect()] == ["H", "Second"]
    assert corpus.books.first().title == "Home"


def test_a_small_limit_does_not_make_a_slice_per_row(spark, monkeypatch):
    from bindery.operators import scan

    written, keep = [], scan.materialize
    monkeypatch.setattr(scan, "SAFE_SLICES", 20, raising=False)
    monkeypatch.setattr(scan, "materialize", lambda df, label: written.append(keep(df, label)) or written[-1])
    df = spark.range(300).select(F.when(F.col("id") < 290, "big").otherwise("small").alias("site"), (-F.col("id")).alias("n"))
    out = scan.ordered_scan(df, ["site"], [F.col("n")], position="at", limit=2)
    assert sorted(out.collect()) == sorted([("big", -i, 289 - i) for i in range(290)] + [("small", -i, 299 - i) for i in range(290, 300)])
    assert 2 <= written[0].select("_slice").distinct().count() <= 20
