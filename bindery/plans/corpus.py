"""From pages of many sites to book tables, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions.strings import page_title
from bindery.operators.book import (
    book_options,
    build_report,
    chapters_to_content,
    create_books,
    enrich_metadata,
    hierarchical_toc,
    toc_content,
    validate_books,
)
from bindery.operators.chapters import HEAD, chapter_listing, listed_chapters
from bindery.operators.clean import clean_pages
from bindery.operators.crawl import canonical_pages, crawl_sites, merged_pages
from bindery.operators.images import image_catalog, image_refs
from bindery.operators.quality import fail_fast, split_errors
from bindery.session import drop_scratch, materialize
from bindery.sources.nodes import page_slices
from bindery.sources.profiles import Profile
from bindery.sources.sinks import write_book_dataset


@dataclass
class Corpus:
    """Tables of a finished corpus."""

    chapters: DataFrame
    toc: DataFrame
    books: DataFrame
    package_entries: DataFrame
    images: DataFrame
    report: DataFrame
    errors: DataFrame

    def write(self, path: str, drop: bool = False) -> None:
        """Write all tables; ``drop`` deletes this application's scratch tables afterwards, on which these tables read."""
        write_book_dataset(vars(self), path)
        if drop:
            drop_scratch(self.chapters.sparkSession)


def build_book_corpus(
    pages: DataFrame,
    seeds: DataFrame | None = None,
    follow_links: bool = False,
    profiles: list[Profile] | None = None,
    given: DataFrame | None = None,
    author: str | None = None,
    stop_on_error: bool = False,
) -> Corpus:
    """Build the books of all sites.

    Every crawled page ends up exactly once, as a chapter or as a row of ``errors``: pages
    without content (NO_CONTENT_FOUND), with too little text for a chapter
    (CHAPTER_TOO_SHORT), and copies of another page's URL (DUPLICATE_PAGE). Sites without
    chapters have a book row and an error without a URL.

    ``follow_links`` crawls from seeds; otherwise the stored pages are the crawl, in
    page order, one per normalised URL. Clean pages are written once to the shared
    scratch area, as several jobs read them; all other intermediate tables hold keys.
    """
    if follow_links:
        crawled, lost = crawl_sites(pages, seeds, profiles)
        lost = lost.withColumn("page_id", F.lit(None).cast("bigint"))
    else:
        crawled = canonical_pages(pages).select(
            "site", "page_id", "url", "html", page_title(F.col("html")).alias("title"), F.col("page_id").alias("order")
        )
        copies = pages.select("site", "page_id", "url").join(merged_pages(pages), ["site", "page_id"], "left_semi")
        lost = copies.select("site", "page_id", "url", F.lit("DUPLICATE_PAGE").alias("error_code"))
    # no more pages are crawled than there are
    parsed = clean_pages(crawled, profiles, carry=("order",), slices=page_slices(pages))
    parsed = materialize(fail_fast(parsed).withColumn("error_code", F.lit(None).cast("string")) if stop_on_error else parsed, "normalized")
    good, bad = split_errors(parsed)
    listing = chapter_listing(good.select("site", "page_id", "url", "title", "content", "order"))
    chapters = listed_chapters(good, listing)
    chosen = [p.image_options["format"] for p in profiles or [] if p.image_options]
    images = image_catalog(image_refs(good), format=chosen[0] if chosen else "jpeg")
    first = parsed.select("site", "page_id", "url", F.col("crawl_title").alias("title"), "order")
    books = enrich_metadata(create_books(listing, first, given, author), listing)
    short = good.select("site", "page_id", "url").join(listing.select("site", "page_id"), ["site", "page_id"], "left_anti")
    none = F.lit(None)
    wrapped = listing.withColumn("content", F.lit(HEAD))  # a wrapped chapter is never empty
    invalid = validate_books(books, wrapped).select("site", none.cast("bigint").alias("page_id"), none.cast("string").alias("url"), "error_code")
    errors = bad.select("site", "page_id", "url", "error_code").unionByName(short.withColumn("error_code", F.lit("CHAPTER_TOO_SHORT")))
    errors = errors.unionByName(invalid).unionByName(lost)
    return Corpus(
        chapters=chapters,
        toc=hierarchical_toc(listing),
        books=book_options(books),
        package_entries=chapters_to_content(chapters).unionByName(toc_content(listing)),
        images=images,
        report=build_report(chapters, images),
        errors=errors,
    )
