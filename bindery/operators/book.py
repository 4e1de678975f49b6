"""Book level: tables of contents, metadata, validation, reports.

Per-site values are aggregates with map-side combining. What depends on the order
inside a site goes through ``ordered_scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.sqltext import bind, let
from bindery.functions.strings import escape_xml, js_trim, or_else, sanitize_metadata_field, slug
from bindery.functions.urls import title_from_url, url_host
from bindery.operators.outline import parents_by_level
from bindery.operators.scan import lookup, ordered_scan
from bindery.session import materialize

TOC_TITLE = "Table of Contents"
# The envelope of a table-of-contents page.
TOC_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html>
<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">
<head>
  <meta charset="UTF-8" />
  <title>{title}</title>
  <style>
    nav ol {
      list-style-type: none;
      padding-left: 1.5em;
    }
    nav > ol {
      padding-left: 0;
    }
    nav li {
      margin: 0.5em 0;
    }
    nav a {
      text-decoration: none;
      color: inherit;
    }
    nav a:hover {
      text-decoration: underline;
    }
  </style>
</head>
<body>
  <nav epub:type="toc" id="toc">
    <h1>{title}</h1>
    <ol>
"""
TOC_TAIL = "\n    </ol>\n  </nav>\n</body>\n</html>"


def chapters_to_content(chapters: DataFrame) -> DataFrame:
    """Package entries, one per chapter; a file is its parts' ``data`` in order, here one."""
    return chapters.select(
        "site",
        F.col("order").alias("seq"),
        F.concat("id", F.lit(".xhtml")).alias("filename"),
        F.lit(0).alias("part"),
        "title",
        F.col("content").alias("data"),
        F.lit(False).alias("exclude_from_toc"),
        F.lit(False).alias("before_toc"),
    )


def flat_toc(chapters: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return chapters.select("site", "page_id", "id", "title", "order", F.lit(0).alias("level"), none.alias("parent_id"), F.lit(0).alias("depth"))


def toc_level(title: Column) -> Column:
    """Number of dots in a leading section number; 1 for "Section 1…"; else 0."""
    t = js_trim(title)
    number = F.regexp_extract(t, r"^([0-9]+\.)*[0-9]+[.\s\xA0\x{FEFF}]", 0)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    section = t.rlike(r"(?i)^section[\s\xA0\x{FEFF}]+[0-9.]+")
    return F.when(number != "", dots).when(section, 1).otherwise(0)


def hierarchical_toc(chapters: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries with their parent: the nearest earlier entry of a lower level."""
    entries = chapters.select("site", "page_id", "id", "title", "order", toc_level(F.col("title")).alias("level"))
    return parents_by_level(entries, limit).select("site", "page_id", "id", "title", "order", "level", "parent_id", "depth")


def flatten_toc(toc: DataFrame, limit: int | None = None) -> DataFrame:
    """Pre-order ``seq`` of table-of-contents rows; children follow their parent by ``order``.

    Paths are built level by level; ids are expected to be unique in a site, and
    ``depth`` to be the number of ancestors.
    """
    toc = materialize(toc, "toc")
    deepest = toc.agg(F.max("depth")).first()[0] or 0
    step = F.struct("order", "page_id")
    level = toc.filter("depth = 0").withColumn("_path", F.array(step))
    done = level
    for d in range(1, deepest + 1):
        parents = level.select("site", F.col("id").alias("parent_id"), F.col("_path").alias("_up")).dropDuplicates(["site", "parent_id"])
        level = lookup(toc.filter(F.col("depth") == d), parents, ["site", "parent_id"], "inner")
        level = materialize(level.withColumn("_path", F.concat("_up", F.array(step))).select(*done.columns), "level")
        done = done.unionByName(level)
    return ordered_scan(done, ["site"], [F.col("_path")], position="seq", limit=limit).drop("_path")


def toc_lines(toc: DataFrame, limit: int | None = None) -> DataFrame:
    """The nested list as text: one row per entry, closing lines included.

    ``toc`` is in reading order by ``order``, with ``depth``.
    """
    thin = toc.select("site", "page_id", "id", "title", "order", "depth")
    backwards = [F.col("order").desc(), F.col("page_id").desc()]
    seen = ordered_scan(thin, ["site"], backwards, lasts={"_next": F.col("depth")}, limit=limit)
    indent = F.repeat(F.lit("  "), F.col("depth"))
    link = F.concat(F.lit('<a href="'), "id", F.lit('.xhtml">'), escape_xml(F.col("title")), F.lit("</a>"))
    parent = F.coalesce(F.col("_next") > F.col("depth"), F.lit(False))
    opening = F.when(parent, F.concat(indent, F.lit("<li>\n"), indent, F.lit("  "), link, F.lit("\n"), indent, F.lit("  <ol>")))
    line = F.coalesce(opening, F.concat(indent, F.lit("<li>"), link, F.lit("</li>")))
    # close every list between this entry and the next, or all of them at the end
    ends = F.expr(
        "case when depth > coalesce(_next, 0) then array_join(transform(sequence(depth - 1, coalesce(_next, 0), -1), "
        "d -> concat('\\n', repeat('  ', d), '  </ol>\\n', repeat('  ', d), '</li>')), '') else '' end"
    )
    return seen.select("site", "page_id", "order", F.concat(line, ends).alias("line"))


def toc_html(toc: DataFrame, title: str = TOC_TITLE, limit: int | None = None) -> DataFrame:
    """Table-of-contents page per site as lines ``part, data``, to be joined in order of ``part``.

    The head is part 0, each entry a part of its own, and the tail comes last, whatever the size of a site.
    """
    lines = toc_lines(toc, limit)
    placed = ordered_scan(lines, ["site"], [F.col("order"), F.col("page_id")], position="_at", limit=limit)
    heading = escape_xml(F.lit(title))
    head = F.replace(F.lit(TOC_HEAD), F.lit("{title}"), heading)
    entries = placed.select("site", (F.col("_at") + 1).alias("part"), F.concat(F.when(F.col("_at") > 0, "\n").otherwise(""), "line").alias("data"))
    sizes = toc.groupBy("site").agg(F.count("*").alias("_n"))
    first = sizes.select("site", F.lit(0).alias("part"), head.alias("data"))
    last = sizes.select("site", (F.col("_n") + 1).cast("int").alias("part"), F.lit(TOC_TAIL).alias("data"))
    return entries.unionByName(first).unionByName(last)


def toc_content(chapters: DataFrame, limit: int | None = None) -> DataFrame:
    """Package entry of a flat table of contents for every site with chapters, as the lines of its file."""
    return toc_html(flat_toc(chapters), limit=limit).select(
        "site",
        F.lit(-1).alias("seq"),
        F.lit("toc.xhtml").alias("filename"),
        "part",
        F.lit(TOC_TITLE).alias("title"),
        "data",
        F.lit(True).alias("exclude_from_toc"),
        F.lit(True).alias("before_toc"),
    )


def infer_publisher(url: Column) -> Column:
    """Publisher guessed from the host name; null for invalid URLs."""
    domain = (
        "case when contains(d, 'github.io') then nullif(split(d, '[.]github[.]io')[0], '') "
        "when contains(d, 'gitbook.io') then 'GitBook' when contains(d, 'readthedocs.') then 'Read the Docs' else d end"
    )
    return bind(url_host(url), "h", let("regexp_replace(h, '^www[.]', '')", "d", domain))


def infer_metadata(chapters: DataFrame) -> DataFrame:
    """``publisher`` and ``description`` per site, from its first URL and first five titles.

    The rank filter lets every task send at most five rows per site.
    """
    order = F.struct("order", "page_id")
    first = Window.partitionBy("site").orderBy("order", "page_id")
    top = chapters.select("site", "order", "page_id", "title").withColumn("_n", F.row_number().over(first)).filter("_n <= 5")
    names = F.expr("listagg(title, ', ') within group (order by _n)")
    listed = top.groupBy("site").agg(F.coalesce(names, F.lit("")).alias("_names"))
    totals = chapters.groupBy("site").agg(F.count("*").alias("_count"), F.min_by("source_url", order).alias("_url"))
    more = F.when(F.col("_count") > 5, F.concat(F.lit(", and "), (F.col("_count") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return totals.join(listed, "site").select(
        "site",
        infer_publisher(F.col("_url")).alias("publisher"),
        F.concat(F.lit("Chapters: "), "_names", more).alias("description"),
    )


BOOK_FIELDS = ("publisher", "description", "date", "rights", "identifier")


def create_books(
    chapters: DataFrame,
    crawled: DataFrame | None = None,
    given: DataFrame | None = None,
    author: str | None = None,
    title: str | None = None,
    language: str = "en",
) -> DataFrame:
    """One book row per site.

    ``title`` is the given one, else the first crawled page's title, else made from
    its URL. ``crawled`` has ``site, url, title, order, page_id``; ``given`` may hold
    per-site ``title, author, language`` and metadata columns.
    """
    order = F.struct("order", "page_id")
    if crawled is None:
        crawled = chapters.select("site", F.col("source_url").alias("url"), "title", "order", "page_id")
    books = crawled.groupBy("site").agg(
        F.min_by(F.coalesce("title", F.lit("")), order).alias("_first"), F.min_by("url", order).alias("_url")
    )
    columns = [] if given is None else given.columns
    if given is not None:
        books = books.join(given, "site", "left")

    def value(name: str, fixed: str | None = None) -> Column:
        own = F.col(name) if name in columns else F.lit(None).cast("string")
        return F.coalesce(own, F.lit(fixed)) if fixed else own

    named = or_else(value("title", title), or_else(F.col("_first"), title_from_url(F.col("_url"), "Book")))
    cover = [F.col(c) for c in ("cover_mime", "cover_data") if c in columns]
    return books.select(
        "site",
        or_else(named, F.lit("Untitled")).alias("title"),
        or_else(value("author", author), F.lit("Unknown")).alias("author"),
        or_else(value("language"), F.lit(language)).alias("language"),
        *[value(f).alias(f) for f in BOOK_FIELDS],
        *cover,
    )


def enrich_metadata(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Fill a missing title from the first chapter's URL and missing metadata by inference."""
    order = F.struct("order", "page_id")
    first = chapters.groupBy("site").agg(F.min_by("source_url", order).alias("_url"))
    inferred = infer_metadata(chapters).select(
        "site", F.col("publisher").alias("_publisher"), F.col("description").alias("_description")
    )
    joined = books.join(first, "site", "left").join(inferred, "site", "left")
    fills = {
        "title": F.when(F.col("_url").isNotNull(), or_else(F.col("title"), title_from_url(F.col("_url")))).otherwise(F.col("title")),
        "publisher": F.coalesce("publisher", "_publisher"),
        "description": F.coalesce("description", "_description"),
    }
    return joined.select(*[fills[c].alias(c) if c in fills else F.col(c) for c in books.columns])


def book_identifier(title: Column, author: Column, suffix: Column | None = None) -> Column:
    """``urn:uuid:`` and a slug of title and author; ``suffix`` stands in for a clock value."""
    out = F.concat(F.lit("urn:uuid:"), slug(F.concat(title, F.lit("-"), author)))
    return out if suffix is None else F.concat(out, F.lit("-"), suffix)


def book_options(books: DataFrame, date: str | None = None, suffix: Column | None = None) -> DataFrame:
    """Packaging options per book; ``date`` is used where a book has none."""
    text = {f: F.when(F.col(f) != "", sanitize_metadata_field(F.col(f))) for f in ("publisher", "description", "rights")}
    uri = F.concat(F.lit("data:"), "cover_mime", F.lit(";base64,"), F.base64("cover_data")) if "cover_data" in books.columns else None
    language = or_else(F.col("language"), F.lit("en"))
    return books.select(
        "site",
        F.coalesce(sanitize_metadata_field(F.col("title")), F.lit("Untitled Book")).alias("title"),
        F.coalesce(sanitize_metadata_field(F.col("author")), F.lit("Unknown Author")).alias("author"),
        language.alias("language"),
        language.alias("lang"),
        F.lit(TOC_TITLE).alias("toc_title"),
        F.lit(False).alias("append_chapter_titles"),
        F.lit(3).alias("version"),
        or_else(F.col("identifier"), book_identifier(F.col("title"), F.col("author"), suffix)).alias("identifier"),
        *[c.alias(n) for n, c in text.items()],
        or_else(F.col("date"), F.lit(date)).alias("date"),
        (F.lit(None).cast("string") if uri is None else uri).alias("cover"),
    )


def output_filename(title: Column) -> Column:
    return F.concat(or_else(slug(title), F.lit("book")), F.lit(".epub"))


def validate_books(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Violations: books without chapters and chapters without content."""
    counted = chapters.groupBy("site").agg(F.count("*").alias("_n"))
    bare = books.join(counted, "site", "left_anti").select("site", F.lit("Book must have at least one chapter").alias("message"))
    empty = chapters.filter(or_else(F.col("content"), F.lit("")) == "").select(
        "site", F.concat(F.lit('Chapter "'), "title", F.lit('" has no content')).alias("message")
    )
    return bare.unionByName(empty).withColumn("error_code", F.lit("EPUB_GENERATION_FAILED"))


def format_size(size: Column) -> Column:
    """Bytes for people: B, KB or MB with one decimal."""
    kb = F.concat(F.format_string("%.1f", size / 1024.0), F.lit(" KB"))
    mb = F.concat(F.format_string("%.1f", size / 1048576.0), F.lit(" MB"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, kb).otherwise(mb)


def build_report(chapters: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Chapters, images and total chapter bytes per site."""
    sizes = chapters.groupBy("site").agg(
        F.count("*").alias("chapters_count"), F.sum(F.octet_length("content")).alias("total_size")
    )
    if catalog is None:
        out = sizes.withColumn("images_count", F.lit(0).cast("bigint"))
    else:
        images = catalog.groupBy("site").agg(F.count("*").alias("images_count"))
        out = sizes.join(images, "site", "left").withColumn("images_count", F.coalesce("images_count", F.lit(0).cast("bigint")))
    return out.select(
        "site", "chapters_count", "images_count", "total_size", format_size(F.col("total_size")).alias("size_text")
    )
