"""Nodes back to HTML text, with offsets of marked elements.

Everything here groups by page only; a page's nodes come from one stored string,
so a group is never larger than one row of the page table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.sqltext import q
from bindery.sources.html import KEY, LEVEL, PART, VOID

# the innermost link around a row, and the body as second element, in ``ancestors``
_LINK = f"(?s).*{LEVEL}([0-9]+){PART}a{PART}"
_BODY = f"^{LEVEL}[^{LEVEL}]*{LEVEL}[0-9]+{PART}body{PART}"


def by_pos(descending: bool = False):
    return Window.partitionBy(*KEY).orderBy(F.desc("pos") if descending else F.asc("pos"))


def before():
    """The rows of the page ahead of this one."""
    return by_pos().rowsBetween(Window.unboundedPreceding, -1)


def so_far():
    return by_pos().rowsBetween(Window.unboundedPreceding, 0)


def is_element() -> Column:
    return F.col("kind") == "element"


def is_text() -> Column:
    return F.col("kind").isin("text", "raw")


def _escape(c: Column, *refs: tuple[str, str]) -> Column:
    for raw, ref in (("&", "&amp;"), (" ", "&nbsp;"), *refs):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def open_tag(tag: Column, attrs: Column) -> Column:
    pairs = F.transform(
        F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e.key, F.lit('="'), _escape(e.value, ('"', "&quot;")), F.lit('"'))
    )
    listed = F.when(F.size(attrs) > 0, F.array_join(pairs, "")).otherwise("")
    return F.concat(F.lit("<"), tag, listed, F.lit(">"))


def inside(flag: Column) -> Column:
    """Is the row strictly inside an element where ``flag`` holds?"""
    return F.coalesce(F.max(F.when(flag, F.col("end_pos"))).over(before()) > F.col("pos"), F.lit(False))


def drop_subtrees(nodes: DataFrame, flag: Column) -> DataFrame:
    """Remove the elements where ``flag`` holds, with all they contain."""
    reach = F.max(F.when(flag, F.col("end_pos"))).over(so_far())
    return nodes.withColumn("_reach", reach).filter("_reach is null or _reach < pos").drop("_reach")


def drop_tags(nodes: DataFrame, tags: list[str]) -> DataFrame:
    """Remove the elements with one of the tags, with all they contain: a test of each row."""
    around = F.col("ancestors").rlike(f"{LEVEL}[0-9]+{PART}(?:{'|'.join(tags)}){PART}")
    return nodes.filter(~around & ~F.coalesce(F.col("tag").isin(*tags), F.lit(False)))


def next_pos(flag: Column) -> Column:
    """Position of the next row where ``flag`` holds, else null."""
    return F.last(F.when(flag, F.col("pos")), ignorenulls=True).over(by_pos(descending=True).rowsBetween(Window.unboundedPreceding, -1))


def events(nodes: DataFrame) -> DataFrame:
    """One row per open, close, text, comment or doctype event with its HTML ``piece``."""
    void = F.col("tag").isin(*sorted(VOID))
    opening = (
        F.when(is_element(), open_tag(F.col("tag"), F.col("attrs")))
        .when(F.col("kind") == "text", _escape(F.col("text"), ("<", "&lt;"), (">", "&gt;")))
        .when(F.col("kind") == "raw", F.col("text"))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))
        .when(F.col("kind") == "doctype", F.concat(F.lit("<!DOCTYPE "), F.col("text"), F.lit(">")))
    )
    closing = F.concat(F.lit("</"), F.col("tag"), F.lit(">"))
    first = F.struct(F.col("pos").alias("ev"), opening.alias("piece"), F.lit(False).alias("closing"))
    second = F.struct(F.col("end_pos").alias("ev"), closing.alias("piece"), F.lit(True).alias("closing"))
    pairs = F.when(is_element() & ~void, F.array(first, second)).otherwise(F.array(first))
    return nodes.select("*", F.inline(pairs))


def render_html(nodes: DataFrame, name: str = "html", scope: str = "document", carry: tuple[str, ...] = ()) -> DataFrame:
    """One HTML string per page: the whole document or the inside of ``body``."""
    if scope == "body":
        # rows outside the body stay as rows without text, so that no page is lost
        within = f"ancestors rlike {q(_BODY)}"
        text = F.expr(f"listagg(case when {within} then piece end, '') within group (order by ev)")
    else:
        text = F.expr("listagg(piece, '') within group (order by ev)")
    kept = [F.first(c).alias(c) for c in carry]
    return events(nodes).groupBy(*KEY).agg(*kept, F.coalesce(text, F.lit("")).alias(name))


def page_strings(
    nodes: DataFrame, marks: Column, carry: tuple[str, ...] = (), dead: Column | None = None, rows: bool = False
) -> DataFrame:
    """Render each page once and note where marked elements lie in the result.

    With ``rows`` the page's nodes come too, as the array ``nodes`` without ``dead`` ones, in
    place of ``live``.

    ``marks`` is an array column (null for unmarked rows). The result has ``html``
    and ``text`` of the page, ``live`` (the HTML without ``dead`` rows) and
    ``elems``: per marked element ``pos, end_pos, tag, attrs, marks`` and half-open
    offset pairs into the three strings, in document order.
    """
    dead = F.lit(False) if dead is None else dead
    run = Window.partitionBy(*KEY).orderBy("ev").rowsBetween(Window.unboundedPreceding, 0)
    ev = events(nodes.withColumn("_marks", marks).withColumn("_dead", dead))
    texty = is_text() & ~F.col("closing")
    h, t, v = F.length("piece"), F.when(texty, F.length("text")).otherwise(0), F.when(F.col("_dead"), 0).otherwise(F.length("piece"))
    ev = ev.select(
        "*",
        F.sum(h).over(run).alias("_h"),
        F.sum(t).over(run).alias("_t"),
        F.sum(v).over(run).alias("_v"),
        h.alias("_hl"),
        v.alias("_vl"),
    )
    marked = F.col("_marks").isNotNull()
    opened = F.struct("pos", "end_pos", "tag", "attrs", F.col("_marks").alias("marks"), F.col("piece").alias("outer"),
                      F.col("_h").alias("h0"), F.col("_t").alias("t0"), F.col("_v").alias("v0"))
    closed = F.struct("pos", (F.col("_h") - F.col("_hl")).alias("h1"), F.col("_t").alias("t1"),
                      (F.col("_v") - F.col("_vl")).alias("v1"))
    void = F.col("tag").isin(*sorted(VOID))
    in_order = lambda a, b: a["pos"] - b["pos"]
    if rows:
        node = F.struct("pos", "end_pos", "depth", "kind", "tag", "attrs", F.col("text").alias("text"))
        left = F.collect_list(F.when(~F.col("closing") & ~F.col("_dead"), node)).alias("nodes")
    else:
        left = F.coalesce(F.expr("listagg(case when not _dead then piece end, '') within group (order by ev)"), F.lit("")).alias("live")
    grouped = ev.groupBy(*KEY).agg(
        *[F.first(c).alias(c) for c in carry],
        F.expr("listagg(piece, '') within group (order by ev)").alias("html"),
        F.coalesce(F.expr("listagg(case when kind in ('text', 'raw') and not closing then text end, '') within group (order by ev)"), F.lit("")).alias("text"),
        left,
        F.collect_list(F.when(marked & ~F.col("closing"), opened)).alias("_open"),
        F.collect_list(F.when(marked & (F.col("closing") | void), closed)).alias("_close"),
    )
    return grouped.withColumn(
        "elems",
        F.zip_with(
            F.array_sort("_open", in_order),
            F.array_sort("_close", in_order),
            lambda o, c: F.struct(
                *[o[n].alias(n) for n in ("pos", "end_pos", "tag", "attrs", "marks", "outer", "h0", "t0", "v0")],
                *[c[n].alias(n) for n in ("h1", "t1", "v1")],
            ),
        ),
    ).drop("_open", "_close")


def cut(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, end - begin)


def with_link_text(nodes: DataFrame, wanted: Column) -> DataFrame:
    """The wanted element rows with ``inner_text``, the text inside each ``a``.

    Links do not nest, so each text belongs to at most one link, which its ancestors
    name; only these texts and the wanted rows are shuffled. Other elements get empty text.
    """
    owner = F.regexp_extract("ancestors", _LINK, 1)
    row = F.struct(*[c for c in nodes.columns if c not in KEY])
    piece = F.when(is_text() & (owner != ""), F.struct(owner.cast("int").alias("at"), F.col("pos").alias("ev"), F.col("text").alias("piece"), F.lit(None).cast(_row_type(nodes)).alias("row")))
    own = F.when(wanted, F.struct(F.col("pos").alias("at"), F.col("pos").alias("ev"), F.lit(None).cast("string").alias("piece"), row.alias("row")))
    parts = nodes.withColumn("_parts", F.array_compact(F.array(piece, own))).select(*KEY, F.inline("_parts"))
    text = F.expr("listagg(piece, '') within group (order by ev)")
    merged = parts.groupBy(*KEY, "at").agg(F.first("row", ignorenulls=True).alias("row"), F.coalesce(text, F.lit("")).alias("inner_text"))
    return merged.filter("row is not null").select(*KEY, "row.*", "inner_text")


def _row_type(nodes: DataFrame):
    from pyspark.sql.types import StructType

    return StructType([f for f in nodes.schema.fields if f.name not in KEY])
