"""From pages to sanitised content with one shred, one shuffle and one render.

The nodes of a page are selected and sanitised as they are: rendering is needed to tell how long
candidates are, but what goes on from there are the nodes inside the chosen element, not a string
to be shredded again. The page's nodes stay together through one shuffle, as an array of the page's
row in between; a page's other results travel once, ahead of its nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions.sqltext import q, q_list
from bindery.functions.strings import JS_SPACE
from bindery.operators.content import chosen_content, collapse_runs, collapse_space
from bindery.operators.normalize import clean_html, fix_heading_hierarchy, resolve_image_urls, resolve_links
from bindery.operators.render import events
from bindery.sources.html import HEAD, KEY
from bindery.sources.profiles import Profile

# parts texts while white space is collapsed; no character of documents
SEAM = "\x1d"
# white space which is trimmed off rendered text: there no-break spaces are references
BLANK = JS_SPACE.replace("\xa0", "")


def clean_pages(
    pages: DataFrame,
    profiles: list[Profile] | None = None,
    remove_external: bool = False,
    carry: tuple[str, ...] = (),
    slices: int | None = None,
) -> DataFrame:
    """``normalize_pages(parse_pages(pages))``, every page shredded and rendered once.

    Content which is shredded again loses head elements that it begins with; so do the nodes here.
    White space is collapsed in the attributes, which links are resolved from, and in the rendered
    text, where ``SEAM`` keeps texts apart that a flattened link has brought together.
    """
    picked, settled = chosen_content(pages, profiles, carry, rows=True, slices=slices)
    within = "filter(nodes, n -> n.pos > _c.pos and n.pos < _c.end_pos)"
    # the first thing of the content which belongs into a body
    begins = (
        "array_min(transform(filter(inside, n -> n.depth = _top and "
        f"((n.kind = 'element' and n.tag not in ({q_list(sorted(HEAD))})) "
        f"or (n.kind in ('text', 'raw') and btrim(n.text, {q(BLANK)}) <> ''))), n -> n.pos))"
    )
    held = picked.select(*KEY, "_ok", F.struct(*settled).alias("page"), F.when(F.col("_ok"), F.expr(within)).alias("inside"))
    held = held.withColumn("_top", F.expr("array_min(transform(inside, n -> n.depth))")).withColumn("_from", F.expr(begins))
    # the page's other results come as a row of their own ahead of its nodes, which nothing removes
    first = "array(named_struct('pos', -1, 'end_pos', -1, 'depth', 0, 'kind', 'page', 'tag', null, 'attrs', null, 'text', null))"
    left = F.expr(f"concat({first}, coalesce(filter(inside, n -> n.pos >= _from), filter(inside, n -> false), array()))")
    rows = held.select(*KEY, "_ok", "page", F.posexplode(left).alias("_i", "n"))
    url = F.col("page.url").alias("url")
    nodes = rows.select(*KEY, "n.*", url, F.when(F.col("_i") == 0, F.struct("_ok", "page")).alias("_page"))
    nodes = nodes.withColumn("attrs", F.transform_values("attrs", lambda k, v: collapse_runs(v, r"\s")))
    nodes = resolve_links(fix_heading_hierarchy(clean_html(nodes)), remove_external=remove_external, seam=SEAM)
    text = F.coalesce(F.expr("listagg(piece, '') within group (order by ev)"), F.lit(""))
    done = events(resolve_image_urls(nodes)).groupBy(*KEY).agg(F.first("_page", ignorenulls=True).alias("p"), text.alias("_html"))
    content = F.replace(collapse_space(F.col("_html")), F.lit(SEAM), F.lit(""))
    columns = [F.col(f"p.page.{c}").alias(c) for c in done.schema["p"].dataType["page"].dataType.names]
    *first, images, error = columns
    return done.select(*KEY, *first, F.when(F.col("p._ok"), content).alias("content"), images, error)
