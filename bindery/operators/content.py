"""Noise removal, title and main-content selection, images, content clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.sqltext import let, q
from bindery.functions.strings import JS_SPACE, js_trim, or_else, page_title
from bindery.operators.links import detect_site_profile
from bindery.operators.render import cut, drop_subtrees, drop_tags, is_element, is_text, next_pos, page_strings, render_html, so_far
from bindery.operators.selectors import Matcher, asks_empty
from bindery.sources.html import KEY, html_nodes
from bindery.sources.nodes import by_page, page_slices
from bindery.sources.profiles import DEFAULT, PROFILES, Profile

# Elements removed from every page.
NOISE = [
    "script", "style", "noscript", 'link[rel="stylesheet"]', "iframe", "embed", "object", "nav", "header", "footer",
    '[role="navigation"]', '[role="banner"]', '[role="contentinfo"]', ".navigation", ".nav", ".navbar", ".sidebar",
    ".toc", ".table-of-contents", ".menu", ".comments", ".comment", ".disqus", "#disqus_thread", ".advertisement",
    ".ad", ".ads", ".adsbygoogle", '[class*="sponsor"]', ".social-share", ".share-buttons", ".social", ".share",
    ".related-posts", ".related", ".recommended", ".suggestions", ".breadcrumb", ".breadcrumbs", ".edit-link",
    ".edit-page", ".edit-on-github", ".github-corner", ".page-nav", ".pagination", ".pager", ".prev-next",
    ".cookie-notice", ".gdpr", '[class*="cookie"]', '[class*="consent"]', ".search", ".search-box", "#search",
    ".progress", ".reading-progress", ".docsify-copy-code-button", ".anchor", ".gitbook-link", ".book-header",
    ".book-summary", ".page-footer", "[hidden]", '[aria-hidden="true"]', ".hidden", ".invisible", ".sr-only",
]
# Elements dropped when nothing is left in them, candidates for the
# largest text block, and event attributes.
MAY_BE_EMPTY = ["p", "div", "span", "section", "article"]
BLOCKS = ["main", "article", '[role="main"]', ".content", "#content", ".post", ".entry", "section"]
EVENT_ATTRIBUTES = (
    "onclick ondblclick onmousedown onmouseup onmouseover onmousemove onmouseout onkeydown onkeypress onkeyup "
    "onfocus onblur onchange onsubmit onreset onload onunload onerror"
).split()
MIN_CONTENT = 50
MIN_BLOCK = 100


def remove_comments(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind <> 'comment'")


def _is_blank() -> Column:
    return js_trim(F.col("text")) == ""


def remove_empty_elements(nodes: DataFrame) -> DataFrame:
    """Drop ``p div span section article`` without text, other elements or images inside.

    An element stays exactly when it holds non-blank text or an element outside
    the five, so one pass does what repeated removal does.
    """
    small = F.col("tag").isin(*MAY_BE_EMPTY)
    solid = (is_element() & ~small) | (is_text() & ~_is_blank())
    marked = nodes.withColumn("_next", next_pos(solid))
    empty = is_element() & small & (F.col("_next").isNull() | (F.col("_next") > F.col("end_pos")))
    return drop_subtrees(marked, empty).drop("_next")


def remove_noise(
    nodes: DataFrame,
    exclude: list[str] | dict[str, list[str]] | None = None,
    merge: bool = True,
    empty: bool = True,
    comments: bool = True,
    slices: int | None = None,
) -> DataFrame:
    """Drop boilerplate subtrees, then comments, then emptied elements.

    ``exclude`` adds selectors (or, with ``merge=False``, replaces the defaults); a
    dict gives them per profile and needs a ``profile`` column. ``slices``: the parts which the
    nodes left over are dealt into by page (``page_slices``).
    """
    own = exclude if isinstance(exclude, dict) else {}
    common = list(exclude or []) if not own else []
    base = [*NOISE, *common] if merge or exclude is None else common
    # what every profile excludes needs no test of the profile
    shared = [s for s in reduce(lambda a, b: [x for x in a if x in b], own.values())] if own else []
    base = list(dict.fromkeys([*base, *shared]))
    extra = {name: [s for s in group if s not in base] for name, group in own.items()}
    every = [*base, *[s for group in extra.values() for s in group]]
    early = asks_empty(every)
    m = Matcher.over(by_page(nodes, slices) if early else nodes, every)
    # the end of an empty element is not known to the rows inside it
    matches = m.any_of if m.tests_empty else m.within
    flag = matches(base)
    for name, group in extra.items():
        if group:
            flag = flag | ((F.col("profile") == name) & matches(group))
    out = drop_subtrees(m.nodes, flag) if m.tests_empty else m.nodes.filter(~F.coalesce(flag, F.lit(False)))
    out = out.drop(*m.helpers)
    out = remove_comments(out) if comments else out
    out = out if early else by_page(out, slices)
    return remove_empty_elements(out) if empty else out


def remove_event_attrs(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.isin(*EVENT_ATTRIBUTES)))


def remove_data_attrs(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.startswith("data-")))


def _empty_links() -> Column:
    """Is the row a link with neither text nor image? Needs ``_next`` from ``_mark_links``."""
    return (F.col("tag") == "a") & (F.col("_next").isNull() | (F.col("_next") > F.col("end_pos")))


def _mark_links(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_next", next_pos((F.col("tag") == "img") | (is_text() & ~_is_blank())))


def collapse_runs(text: Column, blank: str = r"\s\xA0") -> Column:
    """At most two line breaks in a row, one space for blanks and tabs."""
    gap = rf"[{blank}\x{{FEFF}}\x{{2028}}\x{{2029}}]*"
    return F.regexp_replace(F.regexp_replace(text, rf"\n{gap}\n{gap}\n", "\n\n"), r"[ \t]+", " ")


def collapse_space(html: Column) -> Column:
    """The same, trimmed."""
    return js_trim(collapse_runs(html))


def clean_content(pages: DataFrame, html: str = "content") -> DataFrame:
    """``content`` without scripts and empty links and with collapsed white space."""
    nodes = html_nodes(pages, html)
    nodes = by_page(drop_tags(nodes, ["script", "style", "noscript"]), page_slices(pages, html))
    nodes = drop_subtrees(_mark_links(nodes), _empty_links()).drop("_next")
    out = render_html(nodes, "content", scope="body")
    return out.withColumn("content", collapse_space(F.col("content")))


def _vocabulary(profiles: list[Profile], part: str) -> list[str]:
    return list(dict.fromkeys(s for p in profiles for s in getattr(p, part)))


def _ranked(profiles: list[Profile], part: str, vocabulary: list[str], offset: int) -> str:
    """Per profile, its selectors as mark numbers in order."""
    cases = [
        f"when profile = {q(p.name)} then array({', '.join(str(vocabulary.index(s) + offset) for s in getattr(p, part))})"
        for p in profiles
    ]
    return f"case {' '.join(cases)} end"


def _marked(mark: str) -> str:
    return f"filter(elems, e -> array_contains(e.marks, {mark}))"


def _text(e: str) -> str:
    return f"btrim(substring(text, {e}.t0 + 1, {e}.t1 - {e}.t0), {q(JS_SPACE)})"


def _inner(e: str) -> str:
    return f"btrim(substring(html, {e}.h0 + 1, {e}.h1 - {e}.h0), {q(JS_SPACE)})"


def clean_title_suffix(title: Column) -> Column:
    """A page title without its trailing " | Site" or " - Site"."""
    return js_trim(F.regexp_replace(title, r"\s*[|\-–—]\s*[^|\-–—]+\z", ""))


def chosen_content(
    pages: DataFrame,
    profiles: list[Profile] | None = None,
    carry: tuple[str, ...] = (),
    rows: bool = False,
    slices: int | None = None,
) -> tuple[DataFrame, list[Column]]:
    """A row per page with the chosen element ``_c``, whether its content is long enough (``_ok``),
    and the page's strings (or nodes); and the columns which selection settles, in order.

    ``slices`` saves counting where ``page_slices`` of the same or more pages is known.
    """
    slices = page_slices(pages) if slices is None else slices
    known = [*(PROFILES if profiles is None else profiles), DEFAULT]
    if "profile" not in pages.columns:
        pages = pages.withColumn("profile", detect_site_profile(F.col("url"), F.col("html"), profiles))
    if "title" not in pages.columns:
        pages = pages.withColumn("title", page_title(F.col("html")))
    keep = ("url", "profile", "crawl_title", *carry)
    nodes = html_nodes(pages.withColumnRenamed("title", "crawl_title"), carry=keep)
    nodes = remove_noise(nodes, {p.name: p.exclude for p in known}, slices=slices)

    titles, contents = _vocabulary(known, "title"), _vocabulary(known, "content")
    # mark numbers: titles, contents, blocks, then title elements, body, images
    t0, c0 = 0, len(titles)
    b0 = c0 + len(contents)
    extra = b0 + len(BLOCKS)
    m = Matcher.over(nodes, [*titles, *contents, *BLOCKS])
    hits = m.indexes([*titles, *contents, *BLOCKS, "title", "body", "img[src]"])
    marked = _mark_links(m.nodes.withColumn("_hits", F.when(F.size(hits) > 0, hits)))
    reach = F.max(F.when(_empty_links(), F.col("end_pos"))).over(so_far())
    marked = marked.withColumn("_dead_link", F.coalesce(reach >= F.col("pos"), F.lit(False)))
    doc = page_strings(marked, F.col("_hits"), keep, dead=F.col("_dead_link"), rows=rows)

    # first title selector whose first match has text
    texts = f"transform({_ranked(known, 'title', titles, t0)}, i -> {let(f'get({_marked('i')}, 0)', 'm', _text('m'))})"
    heads = f"array_join(transform({_marked(str(extra))}, h -> substring(text, h.t0 + 1, h.t1 - h.t0)), '')"
    # first content selector whose first match is long enough
    firsts = f"transform({_ranked(known, 'content', contents, c0)}, i -> get({_marked('i')}, 0))"
    main = f"get(filter({firsts}, m -> m is not null and length({_inner('m')}) > {MIN_CONTENT}), 0)"
    # else the longest text among the blocks; on a tie the earlier selector, then the earlier element
    group = "filter(elems, e -> array_contains(e.marks, {mark}) and e.h1 > e.h0)"
    ranked = [
        f"transform({group.format(mark=b0 + i)}, b -> named_struct('size', length({_text('b')}), 'rank', {-i}, 'at', -b.pos))"
        for i in range(len(BLOCKS))
    ]
    best = f"array_max(concat({', '.join(ranked)}))"
    body = f"get({_marked(str(extra + 1))}, 0)"
    block = let(best, "t", f"if(t.size >= {MIN_BLOCK}, get(filter(elems, e -> e.pos = -t.at), 0), {body})")
    picked = doc.select(
        "*",
        F.expr(f"get(filter({texts}, t -> t <> ''), 0)").alias("_heading"),
        js_trim(F.expr(heads)).alias("_page"),
        F.expr(f"coalesce({main}, {block})").alias("_c"),
    )
    title = F.coalesce("_heading", F.when(F.col("_page") != "", clean_title_suffix(F.col("_page"))), F.lit("Untitled"))
    raw = js_trim(cut(F.col("html"), F.col("_c.h0"), F.col("_c.h1")))
    image = (
        "named_struct('original_url', e.attrs['src'], 'alt_text', coalesce(e.attrs['alt'], ''), 'original_html', e.outer)"
    )
    inside = (
        f"filter(elems, e -> array_contains(e.marks, {extra + 2}) and e.pos > _c.pos and e.pos < _c.end_pos "
        "and e.attrs['src'] <> '' and not startswith(e.attrs['src'], 'data:'))"
    )
    # first image per source
    once = "filter(im, (i, n) -> array_position(transform(im, o -> o.original_url), i.original_url) = n + 1)"
    settled = [
        F.col("url"),
        F.col("profile"),
        F.col("crawl_title"),
        *[F.col(c) for c in carry],
        or_else(title, or_else(F.col("crawl_title"), F.lit("Untitled"))).alias("title"),
        F.when(F.col("_ok"), F.expr(let(f"transform({inside}, e -> {image})", "im", once))).alias("images"),
        F.when(~F.col("_ok"), F.lit("NO_CONTENT_FOUND")).alias("error_code"),
    ]
    return picked.withColumn("_ok", F.coalesce(F.length(raw) >= MIN_CONTENT, F.lit(False))), settled


def parse_pages(pages: DataFrame, profiles: list[Profile] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Title, main content and images of every page.

    ``pages`` has ``site, page_id, url, html`` and optionally ``profile`` (else it is
    detected) and ``title`` from the crawl. Every page comes back once: with
    ``content``, or with ``error_code`` where there is none. The page is shredded
    once and shuffled once; selection cuts slices out of the rendered page.
    """
    picked, settled = chosen_content(pages, profiles, carry)
    live = collapse_space(cut(F.col("live"), F.col("_c.v0"), F.col("_c.v1")))
    *first, images, error = settled
    return picked.select(*KEY, *first, F.when(F.col("_ok"), live).alias("content"), images, error)
