"""String functions with ECMAScript whitespace and trimming rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript treats as white space.
JS_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as the inside of a Java regex character class.
JS_S = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def js_trim(c: Column) -> Column:
    """``String.prototype.trim``; no regular expression, so linear on long texts."""
    return F.btrim(c, F.lit(JS_SPACE))


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(c, f"[{JS_S}]+", " ")


def strip_tags(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, "<[^>]+>", by)


def or_else(c: Column, default: Column) -> Column:
    """``c || default``: null and empty fall through."""
    return F.when(c.isNull() | (c == ""), default).otherwise(c)


def escape_xml(c: Column) -> Column:
    """Escape ``& < > " '`` for XHTML text."""
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def slug(c: Column, size: int = 100) -> Column:
    """Lower-case, other characters to dashes, one dash off each end, cut."""
    c = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(c, r"^-|-\z", ""), 1, size)


def sanitize_title(c: Column) -> Column:
    """A chapter title free of tags and markup characters, at most 200 long."""
    t = strip_tags(js_trim(F.coalesce(c, F.lit(""))))
    t = squeeze(F.translate(t, "<>&\"'", ""))
    return or_else(js_trim(F.substring(t, 1, 200)), F.lit("Untitled"))


def sanitize_metadata_field(c: Column) -> Column:
    """Metadata text without tags or control characters; empty input is null."""
    t = squeeze(strip_tags(js_trim(c)))
    t = js_trim(F.regexp_replace(t, r"[\x00-\x1F\x7F]", ""))
    return F.when((c != "") & (t != ""), t)


def minify_html(c: Column) -> Column:
    """Drop white space between tags, squeeze the rest, trim."""
    return js_trim(squeeze(F.regexp_replace(c, f">[{JS_S}]+<", "><")))


def page_title(html: Column) -> Column:
    """Text of the first ``<title>`` element, trimmed, else empty."""
    return js_trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))
