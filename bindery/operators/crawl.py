"""Crawl traversal over stored pages: which pages of a site make its book, in which order.

A seed names each site's first page. Links are looked up in the page table instead
of being fetched; links to pages which are not stored come back as unresolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.strings import or_else, page_title
from bindery.functions.urls import normalize_url
from bindery.operators.links import (
    extract_all_links,
    extract_nav_links,
    filter_chapter_links,
    find_next_link,
    has_pagination,
    select_strategy,
)
from bindery.operators.scan import lookup
from bindery.operators.selectors import split_list
from bindery.session import materialize, materialize_counted
from bindery.sources.html import KEY, html_nodes
from bindery.sources.profiles import PROFILES, SIDEBAR_SELECTOR, Profile


def canonical_pages(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """One page per site and normalised URL, the first by ``order``.

    Keys are reduced with map-side combining, so many copies of one URL meet as one
    row per task. Only the keys of pages which give way take part in the join by page;
    the result has ``norm_url`` last.
    """
    return pages.join(merged_pages(pages, order), list(KEY), "left_anti").withColumn("norm_url", normalize_url(F.col("url")))


def merged_pages(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """``site, page_id`` of the pages for which another of the same normalised URL stands."""
    keys = pages.select("site", "page_id", F.col(order).alias("_order"), normalize_url(F.col("url")).alias("norm_url"))
    place = F.struct("_order", "page_id")
    first = keys.groupBy("site", "norm_url").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first <> _last")
    every = keys.withColumn("_place", place).join(first, ["site", "norm_url"])
    return every.filter("_place <> _first").select("site", "page_id")


def page_index(pages: DataFrame) -> DataFrame:
    """Stored page for each normalised URL of a site."""
    return pages.groupBy("site", normalize_url(F.col("url")).alias("norm_url")).agg(F.min("page_id").alias("page_id"))


def default_seeds(pages: DataFrame) -> DataFrame:
    """The first stored page of each site."""
    return pages.groupBy("site").agg(F.min("page_id").alias("page_id"))


def _linked_pages(seeds: DataFrame, links: DataFrame, index: DataFrame, seed_first: bool) -> tuple[DataFrame, DataFrame]:
    """Seed and linked pages as ``site, page_id, link_text, order``; and links which are not stored.

    A site has one seed, so a site's links are those of one page.
    """
    targets = materialize(links.select("site", F.col("href").alias("norm_url"), "text", F.col("order").alias("_at")), "targets")
    known = lookup(targets, index, ["site", "norm_url"])
    missing = known.filter("page_id is null").select("site", F.col("norm_url").alias("href"), "text")
    start = seeds.select("site", "page_id", normalize_url(F.col("url")).alias("norm_url"))
    if not seed_first:
        # the seed keeps its place among the links when it is one of them
        listed = targets.select("site", "norm_url")
        start = start.join(listed, ["site", "norm_url"], "left_anti")
    seen = start.select("site", "page_id", F.lit(None).cast("string").alias("text"), F.lit(-1).alias("_at"))
    found = known.filter("page_id is not null").select("site", "page_id", "text", "_at")
    every = seen.unionByName(found)
    once = every.groupBy("site", "page_id").agg(F.min(F.struct("_at", "text")).alias("_f"))
    order = Window.partitionBy("site").orderBy("_f._at")
    return (
        once.select("site", "page_id", F.col("_f.text").alias("link_text"), (F.row_number().over(order) - 1).alias("order")),
        missing,
    )


def crawl_sidebar(
    seeds: DataFrame, index: DataFrame, selectors: list[str] | dict[str, list[str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pages linked from each seed's navigation; ``seeds`` has ``site, page_id, url, html``."""
    nodes = html_nodes(seeds, carry=("url", *[c for c in ("profile",) if c in seeds.columns]))
    links = filter_chapter_links(extract_nav_links(nodes, selectors or split_list(SIDEBAR_SELECTOR)))
    return _linked_pages(seeds, links, index, seed_first=False)


def crawl_all_links(seeds: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each seed and every page it links to."""
    nodes = html_nodes(seeds, carry=("url",))
    return _linked_pages(seeds, filter_chapter_links(extract_all_links(nodes)), index, seed_first=True)


def next_edges(pages: DataFrame, index: DataFrame, selectors: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``site, page_id, next_id`` by next-page links; and next links which are not stored."""
    nodes = html_nodes(pages, carry=("url",))
    links = find_next_link(nodes, selectors).withColumn("norm_url", normalize_url(F.col("next_url")))
    known = lookup(links, index.withColumnRenamed("page_id", "next_id"), ["site", "norm_url"])
    missing = known.filter("next_id is null").select("site", F.col("norm_url").alias("href"), F.lit("").alias("text"))
    return known.filter("next_id is not null").select(*KEY, "next_id"), missing


def follow_chain(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages reached from each seed by following ``next_id``, numbered from 0.

    Stops at a page without a successor and at a page already visited. Jumps of
    1, 2, 4, … steps are joined with the pages reached so far until a round reaches no
    new one, so a chain of n pages takes about log n rounds; each is a table of its
    own. Many pages may share one successor, which the lookup spreads.
    """
    jump, jumps = materialize_counted(edges.select("site", F.col("page_id").alias("at"), F.col("next_id").alias("to")), "jump")
    start = seeds.select("site", F.col("page_id").alias("at"), F.lit(0).alias("order"))
    reached, size = materialize_counted(start, "reached")
    step = 1
    while True:
        ahead = lookup(reached, jump, ["site", "at"], "inner", right_rows=jumps)
        ahead = ahead.select("site", F.col("to").alias("at"), (F.col("order") + step).alias("order"))
        union = reached.unionByName(ahead).groupBy("site", "at").agg(F.min("order").alias("order"))
        reached, grown = materialize_counted(union, "reached")
        step *= 2
        if grown == size:
            break
        size = grown
        # twice the distance: look up where each jump's target jumps to
        onward = jump.select("site", F.col("at").alias("to"), F.col("to").alias("_to"))
        longer = lookup(jump, onward, ["site", "to"], "inner", right_rows=jumps)
        jump, jumps = materialize_counted(longer.select("site", "at", F.col("_to").alias("to")), "jump")
    return reached.select("site", F.col("at").alias("page_id"), "order")


def crawl_pagination(
    seeds: DataFrame, pages: DataFrame, index: DataFrame, selectors: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pages reached from each seed by next-page links."""
    edges, missing = next_edges(pages, index, selectors)
    chain = follow_chain(seeds, edges)
    return chain.withColumn("link_text", F.lit(None).cast("string")).select("site", "page_id", "link_text", "order"), missing


def crawl_sites(
    pages: DataFrame, seeds: DataFrame | None = None, profiles: list[Profile] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Crawl every site by the strategy its seed page calls for.

    Returns ``site, page_id, url, html, title, order, profile`` and an error table
    with unresolved links (CRAWL_FAILED) and sites without pages
    (NO_CHAPTERS_FOUND). Only seeds, and all pages of sites which use next links,
    are shredded.
    """
    known = PROFILES if profiles is None else profiles
    # one seed per site: of several, the first page
    asked_for = pages.select("site", "page_id") if seeds is None else seeds.select("site", "page_id")
    starts = pages.join(default_seeds(asked_for), ["site", "page_id"])
    starts = materialize(starts, "seeds")
    paginated = has_pagination(html_nodes(starts))
    chosen = materialize(select_strategy(starts, paginated, profiles), "strategies")
    starts = starts.join(chosen.select(*KEY, "profile", "strategy"), list(KEY))
    index = materialize(page_index(pages), "index")

    by_profile = {p.name: split_list(p.selector if p.strategy in ("sidebar", "links") and p.selector else SIDEBAR_SELECTOR) for p in known}
    by_profile["default"] = split_list(SIDEBAR_SELECTOR)
    next_by_profile = {p.name: [p.next_selector] for p in known if p.strategy == "pagination" and p.next_selector}
    # at most one row per kind of strategy
    used = {r.strategy for r in chosen.select("strategy").distinct().collect()}
    parts = []
    if "sidebar" in used:
        parts.append(crawl_sidebar(starts.filter("strategy = 'sidebar'"), index, by_profile))
    if "auto" in used:
        parts.append(crawl_all_links(starts.filter("strategy = 'auto'"), index))
    if "pagination" in used:
        groups = [(None, F.lit(True) if not next_by_profile else ~F.col("profile").isin(*next_by_profile))]
        groups += [(s, F.col("profile") == name) for name, s in next_by_profile.items()]
        for selectors, which in groups:
            walkers = starts.filter("strategy = 'pagination'").filter(which)
            # sites are marked on page keys; bodies are joined by page
            marked = pages.select("site", "page_id").join(walkers.select("site"), "site", "left_semi")
            own = pages.join(marked, ["site", "page_id"], "left_semi")
            parts.append(crawl_pagination(walkers, own, index, selectors))
    none = F.lit(None).cast("string")
    found = chosen.filter("false").select("site", "page_id", none.alias("link_text"), F.lit(0).alias("order"))
    lost = chosen.filter("false").select("site", none.alias("href"), none.alias("text"))
    for some, missing in parts:
        found, lost = found.unionByName(some), lost.unionByName(missing)
    found = materialize(found.join(chosen.select("site", "profile"), "site"), "crawled")

    title = or_else(page_title(F.col("html")), F.coalesce("link_text", F.lit("")))
    crawled = pages.join(found, ["site", "page_id"])
    crawled = crawled.select("site", "page_id", "url", "html", title.alias("title"), "order", "profile")
    failed = lost.select("site", F.col("href").alias("url"), F.lit("CRAWL_FAILED").alias("error_code"))
    asked = seeds.select("site") if seeds is not None else pages.select("site")
    empty = asked.distinct().join(found.select("site").distinct(), "site", "left_anti")
    empty = empty.select("site", F.lit(None).cast("string").alias("url"), F.lit("NO_CHAPTERS_FOUND").alias("error_code"))
    return crawled, failed.unionByName(empty)
