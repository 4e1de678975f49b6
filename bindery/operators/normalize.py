"""Markup sanitising, heading repair, link and image URL resolution over nodes.

Every operator takes a node table and returns one; ``normalize_pages`` chains them
between one shred and one render. ``url`` is the page URL on each node where links
are resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.sqltext import bind, let, q, q_list
from bindery.functions.strings import JS_S, JS_SPACE, js_trim
from bindery.functions.urls import canonical_url, resolve_sql, same_site_sql
from bindery.operators.render import by_pos, drop_subtrees, inside, is_element, is_text, next_pos, render_html
from bindery.sources.html import KEY, html_nodes
from bindery.sources.nodes import by_page

# Attributes and tags which may stay, and invalid tags which become spans.
SAFE_ATTRIBUTES = "href src alt title id class width height colspan rowspan scope headers lang dir".split()
VALID_TAGS = (
    "html head body section article aside nav header footer main div span h1 h2 h3 h4 h5 h6 "
    "p blockquote pre code em strong i b u s sub sup small mark del ins abbr cite q dfn kbd samp var br hr "
    "ul ol li dl dt dd table thead tbody tfoot tr th td caption colgroup col "
    "img figure figcaption picture source audio video a ruby rt rp details summary time address wbr"
).split()
INLINE_TAGS = "font tt blink marquee center".split()
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def convert_invalid_tags(nodes: DataFrame) -> DataFrame:
    """Tags outside the allow-list become ``span`` or ``div`` and keep safe attributes only."""
    bad = is_element() & ~F.col("tag").isin(*VALID_TAGS, "script", "style")
    safe = F.expr(f"map_filter(attrs, (k, v) -> k in ({q_list(SAFE_ATTRIBUTES)}))")
    tag = F.when(F.col("tag").isin(*INLINE_TAGS), "span").otherwise("div")
    return nodes.withColumns(
        {"attrs": F.when(bad, safe).otherwise(F.col("attrs")), "tag": F.when(bad, tag).otherwise(F.col("tag"))}
    )


def clean_html(nodes: DataFrame) -> DataFrame:
    """Keep allow-listed and ``aria-*`` attributes, convert invalid tags, drop empty classes.

    Styles, ``data-*`` and ``on*`` attributes are outside the allow-list.
    """
    kept = f"map_filter(attrs, (k, v) -> k in ({q_list(SAFE_ATTRIBUTES)}) or startswith(k, 'aria-'))"
    html_tags = is_element() & ~F.col("tag").isin("script", "style")
    nodes = convert_invalid_tags(nodes.withColumn("attrs", F.when(html_tags, F.expr(kept)).otherwise(F.col("attrs"))))
    classy = f"map_filter(attrs, (k, v) -> k <> 'class' or btrim(v, {q(JS_SPACE)}) <> '')"
    return nodes.withColumn("attrs", F.expr(classy))


def _level() -> Column:
    return F.when(F.col("tag").isin(*HEADINGS), F.substring("tag", 2, 1).cast("int"))


def fix_heading_hierarchy(nodes: DataFrame) -> DataFrame:
    """Number the heading levels a page uses 1..k without gaps."""
    # the levels of a page as bits; a level's rank is the number of bits up to it
    used = F.bit_or(F.expr("case when _level is not null then shiftleft(1, _level) end")).over(Window.partitionBy(*KEY))
    rank = F.expr("bit_count(_used & (shiftleft(1, _level + 1) - 1))")
    out = nodes.withColumn("_level", _level()).withColumn("_used", used)
    tag = F.when(F.col("_level").isNotNull(), F.concat(F.lit("h"), rank)).otherwise(F.col("tag"))
    return out.withColumn("tag", tag).drop("_level", "_used")


def normalize_chapter_headings(nodes: DataFrame) -> DataFrame:
    """Shift headings so that the first is an ``h1``, then close gaps."""
    whole = by_pos().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("_level", ignorenulls=True).over(whole)
    out = nodes.withColumn("_level", _level()).withColumn("_first", first)
    shifted = F.greatest(F.lit(1), F.least(F.lit(6), F.col("_level") - F.col("_first") + 1))
    tag = F.when(F.col("_level").isNotNull(), F.concat(F.lit("h"), shifted)).otherwise(F.col("tag"))
    return fix_heading_hierarchy(out.withColumn("tag", tag).drop("_level", "_first"))


def first_heading(nodes: DataFrame) -> DataFrame:
    """Trimmed text of each page's first heading; null where there is none."""
    whole = by_pos().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heading = F.when(F.col("tag").isin(*HEADINGS), F.struct("pos", "end_pos"))
    first = F.first(heading, ignorenulls=True).over(whole)
    out = nodes.withColumn("_h", first)
    within = "pos > _h.pos and pos < _h.end_pos and kind in ('text', 'raw')"
    text = F.expr(f"listagg(case when {within} then text end, '') within group (order by pos)")
    return out.groupBy(*KEY).agg(
        js_trim(F.when(F.first("_h.pos").isNotNull(), F.coalesce(text, F.lit("")))).alias("heading")
    )


def _dispositions(base: str, remove_external: bool, convert_external: bool, remove_anchors: bool) -> Column:
    """What happens to a link: keep, text, drop or resolve; with the resolved URL."""
    outside = "'drop'" if remove_external else "'text'" if convert_external else "'resolve'"
    kind = (
        f"case when pr.href is null or pr.href = '' then 'keep' "
        f"when startswith(pr.href, '#') then {q('text' if remove_anchors else 'keep')} "
        f"when pr.href rlike '(?i)^(javascript|mailto|tel|data):' then 'text' "
        f"when r = '' then 'keep' when not {same_site_sql('r', 'pr.kb')} then {outside} else 'resolve' end"
    )
    pair = F.struct(F.col("attrs")["href"].alias("href"), canonical_url(F.col(base)).alias("kb"))
    resolved = f"coalesce({resolve_sql('pr.href', 'pr.kb', base_canonical=True)}, '')"
    return bind(pair, "pr", let(resolved, "r", f"named_struct('what', {kind}, 'to', r)"))


def link_dispositions(
    nodes: DataFrame,
    base: str = "url",
    remove_external: bool = False,
    convert_external: bool = True,
    remove_anchors: bool = False,
) -> DataFrame:
    """One row per link with what ``resolve_links`` does to it."""
    how = _dispositions(base, remove_external, convert_external, remove_anchors)
    links = nodes.filter((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
    return links.select(*KEY, "pos", F.col("attrs")["href"].alias("href"), F.inline(F.array(how))).select(
        *KEY, "pos", "href", F.col("what").alias("disposition"), F.when(F.col("what") == "resolve", F.col("to")).alias("resolved")
    )


def _flatten_to_text(nodes: DataFrame, flag: Column, seam: str = "") -> DataFrame:
    """Turn flagged elements into bare spans which keep only the text inside them.

    ``seam`` is put between texts which elements have parted.
    """
    out = nodes.withColumn("_flat", F.coalesce(flag, F.lit(False))).withColumn("_held", inside(F.col("_flat")))
    if seam:
        goes_on = (F.lag("kind").over(by_pos()) == "text") & (F.lag("depth").over(by_pos()) == F.col("depth"))
        parted = F.col("_held") & is_text() & ~F.coalesce(goes_on, F.lit(False))
        out = out.withColumn("text", F.when(parted, F.concat(F.lit(seam), "text")).otherwise(F.col("text")))
    out = out.filter(~F.col("_held") | is_text())
    kind = F.when(F.col("_held"), F.lit("text")).otherwise(F.col("kind"))
    none = F.expr("cast(map() as map<string,string>)")
    return out.withColumns(
        {
            "kind": kind,
            "tag": F.when(F.col("_flat"), "span").otherwise(F.col("tag")),
            "attrs": F.when(F.col("_flat"), none).otherwise(F.col("attrs")),
        }
    ).drop("_flat", "_held")


def resolve_links(
    nodes: DataFrame,
    base: str = "url",
    remove_external: bool = False,
    convert_external: bool = True,
    remove_anchors: bool = False,
    seam: str = "",
) -> DataFrame:
    """Make links absolute; links out of the site or not to pages become plain text.

    ``seam`` marks where elements that go have parted texts.
    """
    linked = F.when((F.col("tag") == "a"), _dispositions(base, remove_external, convert_external, remove_anchors))
    out = nodes.withColumn("_link", linked)
    dropped = F.coalesce(F.col("_link.what") == "drop", F.lit(False))
    if remove_external and seam:
        mark = {"kind": F.lit("text"), "text": F.lit(seam), "tag": F.lit(None).cast("string"), "_link": F.lit(None)}
        out = out.withColumn("_gone", dropped).withColumn("_in", inside(F.col("_gone"))).filter("not _in")
        out = out.withColumns({c: F.when(F.col("_gone"), v).otherwise(F.col(c)) for c, v in mark.items()}).drop("_gone", "_in")
    elif remove_external:
        out = drop_subtrees(out, dropped)
    out = _flatten_to_text(out, F.col("_link.what") == "text", seam)
    href = F.expr("transform_values(attrs, (k, v) -> if(k = 'href', _link.to, v))")
    return out.withColumn("attrs", F.when(F.col("_link.what") == "resolve", href).otherwise(F.col("attrs"))).drop("_link")


def resolve_image_urls(nodes: DataFrame, base: str = "url") -> DataFrame:
    """Absolute ``src`` on images and absolute entries in every ``srcset``."""
    # split on JavaScript white space, the first word being the URL
    words = f"split(btrim(en, {q(JS_SPACE)}), {q(f'[{JS_S}]+')})"
    entry = (
        f"case when get(ws, 0) = '' or startswith(get(ws, 0), 'data:') then btrim(en, {q(JS_SPACE)}) "
        f"else {let(resolve_sql('get(ws, 0)', 'pr.kb', base_canonical=True), 'ru', 'case when coalesce(ru, {0}) = {0} then btrim(en, {1}) else concat_ws({2}, ru, nullif(array_join(slice(ws, 2, size(ws)), {2}), {0})) end'.format(q(''), q(JS_SPACE), q(' ')))} end"
    )
    srcset = f"array_join(transform(split(v, ','), en -> {let(words, 'ws', entry)}), ', ')"
    src = let(resolve_sql("v", "pr.kb", base_canonical=True), "ru", "if(coalesce(ru, '') = '', v, ru)")
    value = (
        f"case when k = 'src' and pr.tag = 'img' and v <> '' and not startswith(v, 'data:') then {src} "
        f"when k = 'srcset' and v <> '' then {srcset} else v end"
    )
    row = F.struct("tag", "attrs", canonical_url(F.col(base)).alias("kb"))
    fixed = bind(row, "pr", f"transform_values(pr.attrs, (k, v) -> {value})")
    return nodes.withColumn("attrs", F.when(F.col("tag").isin("img", "source"), fixed).otherwise(F.col("attrs")))


def strip_links(nodes: DataFrame) -> DataFrame:
    """Every link becomes a bare span around its content; links without content go."""
    follower = next_pos(F.lit(True))
    out = nodes.withColumn("_next", follower)
    hollow = (F.col("tag") == "a") & (F.col("_next").isNull() | (F.col("_next") > F.col("end_pos")))
    out = drop_subtrees(out, hollow).drop("_next")
    link = F.col("tag") == "a"
    none = F.expr("cast(map() as map<string,string>)")
    return out.withColumns({"attrs": F.when(link, none).otherwise(F.col("attrs")), "tag": F.when(link, "span").otherwise(F.col("tag"))})


def normalize_pages(
    pages: DataFrame, remove_external: bool = False, carry: tuple[str, ...] = (), slices: int | None = None
) -> DataFrame:
    """Sanitise ``content`` and make its links and images absolute, the page URL being the base.

    Other columns stay. Only key, URL and content pass through the shredder. ``slices``: the parts which
    nodes are dealt into by page; count them (``page_slices``) where ``pages`` is cheap to read twice.
    """
    nodes = by_page(html_nodes(pages.filter("content is not null"), "content", carry=("url",)), slices)
    nodes = resolve_links(fix_heading_hierarchy(clean_html(nodes)), remove_external=remove_external)
    done = render_html(resolve_image_urls(nodes), "content", scope="body")
    rest = pages.drop("content")
    return rest.join(done, list(KEY), "left")
