"""Link extraction, link filters and site classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.sqltext import bind, let
from bindery.functions.strings import js_trim, or_else
from bindery.functions.urls import canonical_url, content_sql, normalize_sql, resolve_sql, resolve_url, same_site_sql
from bindery.operators.selectors import match_selectors
from bindery.sources.html import KEY
from bindery.sources.profiles import NEXT_SELECTORS, PROFILES, SIDEBAR_SELECTOR, Profile

# Link texts which do not name chapters, and class or id names of sidebars.
BOILERPLATE = (
    r"(?i)^(home|about|contact|search|login|sign (in|up)|register|share|tweet|facebook|twitter|github|edit|download)\z"
    r"|^(privacy|terms|cookie)"
)
SIDEBAR_NAMES = "sidebar-nav sidebar book-summary toc table-of-contents nav-list chapter-link chapter-item".split()


def _candidates(nodes: DataFrame, selectors: list[str], base: str) -> DataFrame:
    """Matched elements with resolved and normalised targets and the reasons to drop them."""
    found = match_selectors(nodes, selectors, text=True)
    raw = F.col("attrs")["href"]
    target = (
        f"struct(r as resolved, case when r <> '' then {normalize_sql('r')} end as href, "
        f"{same_site_sql('r', 'kb')} as same_site, {content_sql('r')} as is_page)"
    )
    resolved = f"case when pr.href <> '' then {resolve_sql('pr.href', 'kb', base_canonical=True)} end"
    pair = F.struct(raw.alias("href"), canonical_url(F.col(base)).alias("kb"))
    info = bind(pair, "pr", let("pr.kb", "kb", let(resolved, "r", target)))
    # a generator, so that filters on the result are not pushed into a second evaluation
    return found.select(
        *KEY,
        "selector_idx",
        "pos",
        raw.alias("raw"),
        F.col("attrs")["title"].alias("hint"),
        js_trim(F.col("inner_text")).alias("text"),
        *[c for c in ("profile",) if c in nodes.columns],
        F.inline(F.array(info)),
    )


def _first_per_target(links: DataFrame) -> DataFrame:
    """First link per target inside a page, numbered in reading order."""
    again = Window.partitionBy(*KEY, "href").orderBy("selector_idx", "pos")
    reading = Window.partitionBy(*KEY).orderBy("selector_idx", "pos")
    return (
        links.withColumn("_n", F.row_number().over(again))
        .filter("_n = 1")
        .withColumn("order", F.row_number().over(reading) - 1)
        .select(*KEY, "selector_idx", "pos", "href", "text", "order")
    )


def extract_nav_links(
    nodes: DataFrame, selectors: list[str] | dict[str, list[str]], base: str = "url", same_site_only: bool = True
) -> DataFrame:
    """Links found by an ordered selector list, first selector first.

    ``selectors`` may differ per profile; ``nodes`` then carries a ``profile`` column.
    ``base`` names the column with the URL that hrefs are relative to.
    """
    if isinstance(selectors, dict):
        vocabulary = list(dict.fromkeys(s for group in selectors.values() for s in group))
        ranks = F.create_map(
            *[x for name, group in selectors.items() for x in (F.lit(name), F.array(*[F.lit(vocabulary.index(s)) for s in group]))]
        )
        links = _candidates(nodes, vocabulary, base)
        rank = F.array_position(ranks[F.col("profile")], F.col("selector_idx"))
        links = links.withColumn("selector_idx", (rank - 1).cast("int")).filter("selector_idx >= 0")
    else:
        links = _candidates(nodes, selectors, base)
    text = or_else(F.col("text"), F.coalesce("hint", F.lit("")))
    links = links.withColumn("text", text).filter("href is not null and is_page and text <> ''")
    return _first_per_target(links.filter("same_site") if same_site_only else links)


def extract_all_links(nodes: DataFrame, base: str = "url") -> DataFrame:
    """Every same-site link to a page, with or without text."""
    links = _candidates(nodes, ["a[href]"], base).filter("href is not null and is_page and same_site")
    return _first_per_target(links)


def filter_chapter_links(links: DataFrame) -> DataFrame:
    """Drop links whose text is too short or names a site function."""
    return links.filter((F.length("text") >= 2) & ~F.col("text").rlike(BOILERPLATE))


def link_audit(nodes: DataFrame, selectors: list[str] | None = None, base: str = "url") -> DataFrame:
    """Per page: matched elements, kept pages, and drops by the first reason that applies.

    ``anchor_links`` counts kept links written with a fragment.
    """
    found = _candidates(nodes, selectors or [SIDEBAR_SELECTOR], base)
    accepted = F.col("href").isNotNull() & F.col("same_site") & F.col("is_page") & (F.col("text") != "")
    order = F.struct("selector_idx", "pos")
    first = F.min(F.when(accepted, order)).over(Window.partitionBy(*KEY, "href"))
    reason = (
        F.when(or_else(F.col("raw"), F.lit("")) == "", "no_href")
        .when(F.col("href").isNull(), "unresolvable")
        .when(order > first, "duplicate")
        .when(~F.col("same_site"), "off_site")
        .when(~F.col("is_page"), "asset")
        .when(F.col("text") == "", "no_text")
        .otherwise("page_links")
    )
    names = ("no_href", "unresolvable", "duplicate", "off_site", "asset", "no_text", "page_links")
    counts = [F.count_if(F.col("reason") == n).alias(n) for n in names]
    anchors = F.count_if((F.col("reason") == "page_links") & F.col("raw").contains("#")).alias("anchor_links")
    return found.withColumn("reason", reason).groupBy(*KEY).agg(F.count("*").alias("matched"), *counts, anchors)


def detect_site_profile(url: Column, html: Column, profiles: list[Profile] | None = None) -> Column:
    """Name of the first profile whose URL pattern or HTML text occurs, else ``default``."""
    out = None
    for p in PROFILES if profiles is None else profiles:
        tests = [html.contains(t) for t in p.html_patterns]
        if p.url_patterns:
            tests.insert(0, url.rlike("(?i)" + "|".join(p.url_patterns)))
        test = reduce(Column.__or__, tests)
        out = F.when(test, p.name) if out is None else out.when(test, p.name)
    return F.lit("default") if out is None else out.otherwise("default")


def has_sidebar(html: Column) -> Column:
    """Does the page have an element with one of the usual sidebar names?"""
    return F.lower(html).rlike(rf'(class|id)="({"|".join(SIDEBAR_NAMES)})"|class="chapter')


def has_pagination(nodes: DataFrame, selectors: list[str] | None = None) -> DataFrame:
    """Keys of pages with a next-page element."""
    return match_selectors(nodes, selectors or NEXT_SELECTORS).select(*KEY).distinct()


def find_next_link(nodes: DataFrame, selectors: list[str] | None = None, base: str = "url") -> DataFrame:
    """``next_url`` per page: per selector only the first match counts, then the first that resolves."""
    found = match_selectors(nodes, selectors or NEXT_SELECTORS)
    first = Window.partitionBy(*KEY, "selector_idx").orderBy("pos")
    found = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    href = F.col("attrs")["href"]
    target = F.when(or_else(href, F.lit("")) != "", resolve_url(href, canonical_url(F.col(base)), True))
    return (
        found.select(*KEY, "selector_idx", target.alias("next_url"))
        .filter("next_url <> ''")
        .groupBy(*KEY)
        .agg(F.min_by("next_url", "selector_idx").alias("next_url"))
    )


def select_strategy(pages: DataFrame, paginated: DataFrame, profiles: list[Profile] | None = None) -> DataFrame:
    """Crawl strategy per page: what its profile says, else sidebar, pagination, all links.

    ``paginated`` holds the keys of pages with a next-page element.
    """
    known = [*(PROFILES if profiles is None else profiles), Profile("default")]
    profile = detect_site_profile(F.col("url"), F.col("html"), profiles)
    kinds = {"links": "sidebar"}
    fixed = F.create_map(*[F.lit(x) for p in known for x in (p.name, kinds.get(p.strategy, p.strategy))])
    flagged = pages.select(*KEY, "url", profile.alias("profile"), has_sidebar(F.col("html")).alias("sidebar")).join(
        paginated.select(*KEY, F.lit(True).alias("paginated")), list(KEY), "left"
    )
    kind = fixed[F.col("profile")]
    auto = F.when(F.col("sidebar"), "sidebar").when(F.col("paginated"), "pagination").otherwise("auto")
    return flagged.select(*KEY, "url", "profile", F.when(kind == "auto", auto).otherwise(kind).alias("strategy"))
