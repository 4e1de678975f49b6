"""Chapters: titles, ids, wrapping, filters, order.

Operators which look along a whole site go through ``ordered_scan`` with key
columns only; content is joined back by page, which is unique.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.strings import JS_SPACE, escape_xml, js_trim, sanitize_title, strip_tags
from bindery.functions.urls import path_id
from bindery.operators.scan import group_sizes, lookup, ordered_scan
from bindery.session import materialize

MIN_TEXT = 50
SECTION = r"(?i)^(Part|Section|Book)[\s\xA0\x{FEFF}]+[IVX0-9]+"
NUMBER = r"(?i)chapter[\s\xA0\x{FEFF}]+([0-9]+)"
# The XHTML envelope of a chapter.
HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n'
    '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">\n'
    '<head>\n  <meta charset="UTF-8" />\n  <title>'
)
MIDDLE = "</title>\n</head>\n<body>\n  "
TAIL = "\n</body>\n</html>"


def _keys(df: DataFrame) -> DataFrame:
    """Everything but page bodies; what scans and sorts move about."""
    return df.drop("content")


def _with_content(df: DataFrame, done: DataFrame) -> DataFrame:
    """Bring the content back to rows computed from ``_keys(df)``."""
    if "content" not in df.columns:
        return done
    return df.select("site", "page_id", "content").join(done, ["site", "page_id"]).select(*done.columns, "content")


def _in_order() -> list[Column]:
    return [F.col("order"), F.col("page_id")]


def dedupe_titles(pages: DataFrame, limit: int | None = None, at_most: int | None = None) -> DataFrame:
    """Replace ``title`` by its sanitised form, numbered where it repeats.

    The number counts earlier pages of the site whose raw title equals this
    sanitised title; the numbered title is sanitised once more, so a 200-character
    title loses its number. ``page_id`` breaks ties of ``order``.
    """
    keys = _keys(pages).withColumn("_raw", F.coalesce("title", F.lit(""))).withColumn("_san", sanitize_title(F.col("title")))
    same = F.when(F.col("_raw") == F.col("_san"), 1).otherwise(0)
    counted = ordered_scan(keys, ["site", "_san"], _in_order(), sums={"_n": same}, limit=limit, at_most=at_most)
    numbered = F.concat("_san", F.lit(" ("), (F.col("_n") + 1).cast("string"), F.lit(")"))
    # an unnumbered title is sanitised already
    title = F.when(F.col("_n") > 0, sanitize_title(numbered)).otherwise(F.col("_san"))
    return _with_content(pages, counted.withColumn("title", title).drop("_raw", "_san", "_n"))


def chapter_id(url: Column, index: Column) -> Column:
    """``chapter-<path id>``, or index and URL hash where the path says nothing."""
    short = path_id(url)
    by_hash = F.concat(F.lit("chapter-"), (index + 1).cast("string"), F.lit("-"), F.substring(F.md5(url), 1, 8))
    return F.when(short.isin("", "index", "page"), by_hash).otherwise(F.concat(F.lit("chapter-"), short))


def duplicate_chapter_ids(chapters: DataFrame) -> DataFrame:
    """Chapter ids used more than once in a site; ids come from the last path segment only."""
    return chapters.groupBy("site", "id").agg(F.count("*").alias("uses")).filter("uses > 1")


def wrap_chapter(content: Column, title: Column) -> Column:
    return F.concat(F.lit(HEAD), escape_xml(title), F.lit(MIDDLE), content, F.lit(TAIL))


def _titled_keys(keys: DataFrame, limit: int | None, at_most: int | None = None) -> DataFrame:
    """Keys with final titles and chapter ids."""
    titled = dedupe_titles(keys, limit, at_most)
    indexed = ordered_scan(titled, ["site"], _in_order(), position="_index", limit=limit, at_most=at_most)
    return indexed.withColumn("id", chapter_id(F.col("url"), F.col("_index"))).drop("_index")


def _chapters(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Wrap the content of ``pages`` for the chapters named by ``keys``."""
    body = F.coalesce("content", F.lit(""))
    joined = pages.select("site", "page_id", "content").join(keys, ["site", "page_id"])
    return joined.select(
        "site", "page_id", "id", "title", wrap_chapter(body, F.col("title")).alias("content"), "order", F.col("url").alias("source_url")
    )


def create_chapters(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Chapters from pages with ``title, content, order, url``; their place in the site gives the index."""
    keys = pages.select("site", "page_id", "url", "title", "order")
    return _chapters(pages, _titled_keys(keys, limit, group_sizes(keys, ["site"])[0]))


def is_valid_chapter(content: Column) -> Column:
    """At least 50 characters remain without tags; the wrapped title counts."""
    return F.length(js_trim(strip_tags(content, ""))) >= MIN_TEXT


def filter_valid_chapters(chapters: DataFrame) -> DataFrame:
    return chapters.filter(is_valid_chapter(F.col("content")))


def sort_by_order(df: DataFrame) -> DataFrame:
    return df.orderBy("site", "order", "page_id")


def normalize_order(chapters: DataFrame, limit: int | None = None, at_most: int | None = None) -> DataFrame:
    """Number each site's chapters 0..n-1 in their order."""
    placed = ordered_scan(_keys(chapters), ["site"], _in_order(), position="_at", limit=limit, at_most=at_most)
    return _with_content(chapters, placed.withColumn("order", F.col("_at")).drop("_at")).select(*chapters.columns)


def resolve_duplicate_orders(
    df: DataFrame, collation: str | None = "UNICODE", limit: int | None = None, at_most: int | None = None
) -> DataFrame:
    """Number a site again by (order, title) if any order repeats in it, else leave it.

    Titles compare by ``collation``; None compares code points.
    """
    keys = _keys(df).withColumn("_title", F.coalesce("title", F.lit("")))
    title = F.collate("_title", collation) if collation else F.col("_title")
    # only sites with a repeated order take part in the numbering
    repeated = keys.groupBy("site", "order").count().filter("count > 1").select("site", F.lit(True).alias("_again")).distinct()
    flagged = lookup(keys, repeated, ["site"])
    order = [F.col("order"), title, F.col("page_id")]
    placed = ordered_scan(flagged.filter("_again").drop("_again"), ["site"], order, position="_at", limit=limit, at_most=at_most)
    placed = placed.withColumn("order", F.col("_at")).drop("_at", "_title")
    done = flagged.filter("_again is null").drop("_again", "_title").unionByName(placed)
    return _with_content(df, done).select(*df.columns)


def move_chapter(chapters: DataFrame, from_index: int, to_index: int, by_position: bool = False) -> DataFrame:
    """Move a chapter and number again.

    The numbering sorts by the chapters' old ``order``, so a move shows only among
    equal orders; ``by_position`` numbers by the new positions instead.
    """
    if from_index == to_index:
        return chapters
    placed = ordered_scan(_keys(chapters), ["site"], _in_order(), position="_p")
    p = F.col("_p")
    # between two places; a site too short for the target gets the chapter at its end
    target = to_index + 0.5 if from_index < to_index else to_index - 0.5
    placed = placed.withColumn("_m", F.when(p == from_index, F.lit(target)).otherwise(p.cast("double")))
    order = [F.col("_m")] if by_position else [F.col("order"), F.col("_m")]
    done = ordered_scan(placed, ["site"], order, position="_at")
    return _with_content(chapters, done.withColumn("order", F.col("_at")).drop("_at", "_m", "_p")).select(*chapters.columns)


def detect_order_anomalies(chapters: DataFrame, limit: int | None = None) -> DataFrame:
    """Numbered chapters which follow a higher number, with a message each."""
    number = F.regexp_extract("title", NUMBER, 1)
    # only numbered chapters matter, so the scan runs over these
    numbered = chapters.filter(number != "").select("site", "page_id", "order", "title", number.cast("double").alias("_no"))
    out = ordered_scan(numbered, ["site"], [F.col("order"), F.col("page_id")], lasts={"_before": F.col("_no")}, limit=limit)
    message = F.concat(
        F.lit('Chapter "'), "title", F.lit('" (order '), F.col("order").cast("string"), F.lit(") appears after a higher-numbered chapter")
    )
    return out.filter("_no < _before").select("site", "page_id", "order", message.alias("message"))


def group_by_section(chapters: DataFrame, limit: int | None = None) -> DataFrame:
    """``section`` of each chapter: the last heading like "Part I" up to it, else ``Main``."""
    header = F.when(F.col("title").rlike(SECTION), F.col("title"))
    seen = ordered_scan(_keys(chapters).withColumn("_header", header), ["site"], _in_order(), lasts={"_last": F.col("_header")}, limit=limit)
    done = seen.withColumn("section", F.coalesce("_header", "_last", F.lit("Main"))).drop("_header", "_last")
    return _with_content(chapters, done)


def section_sizes(grouped: DataFrame) -> DataFrame:
    """Sections of each site in order of first appearance; sections of one name are one."""
    return grouped.groupBy("site", "section").agg(F.count("*").alias("chapters"), F.min("order").alias("first_order"))


def _text_size(content: Column) -> Column:
    """Characters without tags from the wrapped content's body to its end."""
    return F.length(F.rtrim(strip_tags(F.concat(F.coalesce(content, F.lit("")), F.lit(TAIL)), ""), F.lit(JS_SPACE)))


def _is_long_enough(title: Column, size: Column) -> Column:
    """``is_valid_chapter`` from the title and ``_text_size`` alone.

    Around the title the envelope has white space only: trimmed before it, kept
    between it and a body with text.
    """
    between = len(re.sub("<[^>]+>", "", MIDDLE))
    return F.length(escape_xml(title)) + F.when(size > 0, size + between).otherwise(0) >= MIN_TEXT


def chapter_listing(pages: DataFrame, filter_empty: bool = True, limit: int | None = None) -> DataFrame:
    """Chapters of each site without their bodies: ``site, page_id, id, title, order, source_url``.

    Ordering, titles and the length filter work on a table of keys, which is written once;
    of page content only the text size is read.
    """
    keys = pages.select("site", "page_id", "url", "title", "order", _text_size(F.col("content")).alias("_size"))
    keys = materialize(keys, "chapter-keys")
    # no later group is larger than the largest site
    largest, _ = group_sizes(keys, ["site"])
    placed = resolve_duplicate_orders(keys, limit=limit, at_most=largest)
    titled = _titled_keys(placed, limit, largest)
    kept = titled.filter(_is_long_enough(F.col("title"), F.col("_size"))) if filter_empty else titled
    ordered = normalize_order(materialize(kept, "chapter-keys"), limit, largest)
    return materialize(ordered.select("site", "page_id", "id", "title", "order", F.col("url").alias("source_url")), "chapter-listing")


def listed_chapters(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """The chapters of a listing with the content of ``pages``, wrapped."""
    return _chapters(pages, listing.withColumnRenamed("source_url", "url"))


def build_chapters(pages: DataFrame, filter_empty: bool = True, limit: int | None = None) -> DataFrame:
    """Pages of each site to numbered chapters; page content is joined once, at the end."""
    return listed_chapters(pages, chapter_listing(pages, filter_empty, limit))
