"""One query per operator over the given tables, for checks and benchmarks.

The given pages hold no images, deep headings, next links or numbered titles;
where an operator needs them, the input is derived from whole tables by
expressions which the comparison SQL repeats.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions import strings as S
from bindery.functions import urls as U
from bindery.operators import book as B
from bindery.operators import chapters as H
from bindery.operators import content as C
from bindery.operators import crawl as W
from bindery.operators import images as I
from bindery.operators import links as L
from bindery.operators import normalize as N
from bindery.operators.quality import split_errors
from bindery.operators.render import render_html
from bindery.operators.scan import ordered_scan
from bindery.plans.corpus import build_book_corpus
from bindery.plans.incremental import update_book_corpus
from bindery.session import materialize, scratch_dir
from bindery.sources import profiles as P
from bindery.sources.html import html_nodes
from bindery.sources.nodes import bucketed_nodes, page_slices
from bindery.sources.pages import read_pages, spread
from bindery.sources.sinks import read_book_table

Query = Callable[[SparkSession, str], DataFrame]


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def _raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_raw(spark, sf, "documents"), "doc_id")


def _squashed(html: Column) -> Column:
    """Digest of the text of an HTML string, white space left out."""
    text = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", "")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return F.md5(text)


def _tags(html: Column) -> Column:
    """Digest of an HTML string's opening tags in order, with their links; ``b`` apart, which is re-opened."""
    opened = F.regexp_extract_all(html, F.lit('<([a-zA-Z][a-zA-Z0-9]*(?: href="[^"]*")?)'), F.lit(1))
    return F.md5(F.array_join(F.filter(opened, lambda t: t != "b"), ","))


# --- sources ---------------------------------------------------------------


def read_pages_query(spark, sf):
    return _pages(spark, sf).select("site", "page_id", "url", F.md5("html").alias("html_md5"))


def html_nodes_query(spark, sf):
    nodes = html_nodes(_pages(spark, sf)).filter("kind = 'element'")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def html_text(spark, sf):
    nodes = html_nodes(_pages(spark, sf)).filter("kind in ('text', 'raw')")
    text = F.expr("listagg(text, '') within group (order by pos)")
    return nodes.groupBy("page_id").agg(F.md5(F.regexp_replace(text, r"\s+", "")).alias("text_md5"))


def render_html_query(spark, sf):
    out = render_html(html_nodes(_pages(spark, sf)))
    return out.select("page_id", _squashed(F.col("html")).alias("text_md5"), _tags(F.col("html")).alias("tags_md5"))


# --- URLs ------------------------------------------------------------------


def _hrefs(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return _pages(spark, sf).select("site", "page_id", "url", F.posexplode(links).alias("pos", "href"))


def resolve_url(spark, sf):
    return _hrefs(spark, sf).select("page_id", "pos", U.resolve_url(F.col("href"), F.col("url")).alias("resolved"))


def url_checks(spark, sf):
    """Validity of page URLs, of bare hrefs, and of URLs with their scheme or port spoilt."""
    variants = F.array(
        F.col("url"),
        F.regexp_replace("url", "^https?:", "ftp:"),
        F.regexp_replace("url", "^https?://", ""),
        F.regexp_replace("url", "(example[.][a-z]+)/", "$1:99999/"),
    )
    rows = _pages(spark, sf).select("page_id", F.posexplode(variants).alias("variant", "u"))
    return rows.select(
        "page_id",
        "variant",
        U.is_valid_url(F.col("u")).alias("valid"),
        U.is_http_url(F.col("u")).alias("http"),
        U.url_error(F.col("u")).alias("error_code"),
    )


def same_site(spark, sf):
    """Each link against its page and against the site root."""
    rows = _hrefs(spark, sf).select("site", "page_id", "pos", "url", U.resolve_url(F.col("href"), F.col("url")).alias("r"))
    return rows.select(
        "page_id",
        "pos",
        U.is_same_origin(F.col("r"), F.col("url")).alias("same_origin"),
        U.is_same_site(F.col("r"), F.col("url")).alias("same_site"),
        U.is_same_site(F.col("r"), F.col("url"), strict=True).alias("strict_site"),
        U.is_same_site(F.col("r"), F.concat("site", F.lit("/"))).alias("in_root"),
    )


def normalize_url(spark, sf):
    """Page URLs as they are and with unsorted parameters added."""
    sep = F.when(F.col("url").contains("?"), "&").otherwise("?")
    more = F.concat(F.regexp_replace("url", "#.*", ""), sep, F.lit("z=1&a="), F.col("page_id").cast("string"), F.lit("&ref=0#x"))
    pages = _pages(spark, sf)
    return pages.select(
        "page_id", U.normalize_url(F.col("url")).alias("norm_url"), U.normalize_url(more).alias("norm_more")
    )


def url_keys(spark, sf):
    u = F.col("url")
    return _pages(spark, sf).select(
        "page_id", U.path_id(u).alias("path_id"), U.base_url(u).alias("base_url"), U.title_from_url(u).alias("title")
    )


def url_kinds(spark, sf):
    """Page URLs with file extensions and directories put in by page number."""
    stem = F.regexp_replace("url", "([?#].*|[.]html|/)$", "")
    put = F.expr("element_at(array('.png', '.CSS', '/img/x', '.html', '', '/api/', '.webp'), cast(page_id % 7 as int) + 1)")
    rows = _pages(spark, sf).select("page_id", F.concat(stem, put).alias("u"))
    return rows.select("page_id", U.is_image_url(F.col("u")).alias("image"), U.is_content_url(F.col("u")).alias("content"))


# --- links and sites ---------------------------------------------------------


def _rooted(spark, sf):
    """Nodes with the site root as the base of links."""
    pages = _pages(spark, sf).withColumn("url", F.concat("site", F.lit("/")))
    return html_nodes(pages, carry=("url",))


def nav_links(spark, sf):
    return L.extract_nav_links(_rooted(spark, sf), ["nav a", ".menu a"]).select("page_id", "href", "text", "order")


def all_links(spark, sf):
    nodes = html_nodes(_pages(spark, sf), carry=("url",))
    return L.extract_all_links(nodes).select("page_id", "href", "text", "order")


def chapter_links(spark, sf):
    links = L.extract_nav_links(_rooted(spark, sf), ["nav a"])
    # some link texts become the names of site functions
    text = F.when(F.col("order") == 0, F.lit("Home")).when(F.col("order") == 1, F.concat(F.lit("Terms "), "text")).otherwise(F.col("text"))
    return L.filter_chapter_links(links.withColumn("text", text)).select("page_id", "href", "text", "order")


def match_selectors(spark, sf):
    from bindery.operators.selectors import match_selectors

    wanted = ["nav li a", "article p", 'div[class="ad"]', "h1", '[class*="nothing"]', "nav > ul > li > a", "article > h1", "nav > a"]
    found = match_selectors(html_nodes(_pages(spark, sf)), wanted)
    return found.groupBy("page_id", "selector_idx").agg(F.count("*").alias("n"))


def site_profile(spark, sf):
    """Profiles of page URLs, some on hosts which have one."""
    host = F.expr(
        "element_at(array('example', 'github', 'gitbook', 'jekyll'), cast(page_id % 4 as int) + 1)"
    )
    u = F.regexp_replace("url", F.lit("example[.]"), F.concat(host, F.lit(".")))
    u = F.regexp_replace(u, "github[.](com|org|net)", "github.io")
    return _pages(spark, sf).select("page_id", L.detect_site_profile(u, F.col("html")).alias("profile"))


def select_strategy(spark, sf):
    """Every fourth page gets a sidebar, every third a next link."""
    side = F.when(F.col("page_id") % 4 == 0, F.lit('<div class="sidebar">x</div>')).otherwise("")
    after = F.when(F.col("page_id") % 3 == 0, F.lit('<p><a href="/n">Next »</a></p>')).otherwise("")
    pages = _pages(spark, sf).withColumn("html", F.replace("html", F.lit("</article>"), F.concat(side, after, F.lit("</article>"))))
    paginated = L.has_pagination(html_nodes(pages))
    return L.select_strategy(pages, paginated).select("page_id", "profile", "strategy")


def find_next_link(spark, sf):
    """Next links by text and by ``rel``, put in by page number."""
    text = F.expr("case when page_id % 3 = 0 then '<p><a href=\"?p=2\">Next</a></p>' else '' end")
    rel = F.expr("case when page_id % 5 = 0 then '<p><a rel=\"next\" href=\"two.html\">more</a></p>' else '' end")
    pages = _pages(spark, sf).withColumn("html", F.replace("html", F.lit("</article>"), F.concat(text, rel, F.lit("</article>"))))
    return L.find_next_link(html_nodes(pages, carry=("url",))).select("page_id", "next_url")


def page_title(spark, sf):
    return _pages(spark, sf).select("page_id", S.page_title(F.col("html")).alias("title"))


def link_audit(spark, sf):
    nodes = html_nodes(_pages(spark, sf), carry=("url",))
    return L.link_audit(nodes).drop("site")


def canonical_pages(spark, sf):
    return W.canonical_pages(_pages(spark, sf)).select("site", "page_id", "norm_url")


def next_chain(spark, sf):
    """Pages of a site linked by digest order, in a ring broken after every eleventh page."""
    pages = _pages(spark, sf).select("site", "page_id", F.md5("url").alias("d"))
    # going backwards, the page seen last is the one that follows
    linked = ordered_scan(pages, ["site"], [F.desc("d"), F.desc("page_id")], lasts={"next_id": F.col("page_id")})
    seeds = pages.groupBy("site").agg(F.min_by("page_id", F.struct("d", "page_id")).alias("page_id"))
    ring = linked.join(seeds.withColumnRenamed("page_id", "first_id"), "site")
    edges = ring.filter("page_id % 11 <> 0").select("site", "page_id", F.coalesce("next_id", "first_id").alias("next_id"))
    return W.follow_chain(seeds, edges).select("site", "page_id", "order")


def long_chain(spark, sf):
    """All documents as one site, each naming the next by digest of its text and id: a chain as long as the table."""
    docs = _raw(spark, sf, "documents").select(F.lit("s").alias("site"), F.col("doc_id").alias("page_id"), F.md5(F.col("doc_id").cast("string")).alias("d"))
    edges = ordered_scan(docs, ["site"], [F.desc("d")], lasts={"next_id": F.col("page_id")}).filter("next_id is not null")
    seeds = docs.groupBy("site").agg(F.min_by("page_id", "d").alias("page_id"))
    return W.follow_chain(seeds, edges.select("site", "page_id", "next_id"))


def crawl_sidebar(spark, sf):
    """Each four pages of a site in turn make a site of their own; its first page's sidebar lists the others."""
    placed = ordered_scan(_pages(spark, sf).select("site", "page_id", "url"), ["site"], [F.col("page_id")], position="at")
    origin = F.regexp_extract("url", "^(https?://[^/]*)", 1)
    site = F.concat_ws("#", "site", F.expr("cast(at div 4 as string)"))
    placed = materialize(placed.select(site.alias("site"), "page_id", "url", origin.alias("origin"), (F.col("at") % 4).alias("at")), "quads")
    link = F.concat(
        F.lit('<li><a href="'), F.regexp_replace("url", "^https?://[^/]*", ""), F.lit('">page '), F.col("page_id").cast("string"), F.lit("</a></li>")
    )
    # three rows are brought together
    listed = placed.filter("at between 1 and 3").withColumn("link", link).groupBy("site")
    listed = listed.agg(F.expr("listagg(link, '') within group (order by at)").alias("links"))
    seeds = placed.filter("at = 0").join(listed, "site", "left")
    menu = F.concat(F.lit('<title>t</title><div class="sidebar"><ul>'), F.coalesce("links", F.lit("")), F.lit("</ul></div>"))
    seeds = seeds.select("site", "page_id", F.concat("origin", F.lit("/")).alias("url"), menu.alias("html"))
    found, _ = W.crawl_sidebar(seeds, W.page_index(placed))
    return found.select("site", "page_id", "order")


def crawl_sites(spark, sf):
    """Crawl every site from its stored first page; most links lead to pages which are not stored."""
    crawled, errors = W.crawl_sites(_pages(spark, sf))
    ok = crawled.select("site", "url", F.lit("OK").alias("status"))
    return ok.unionByName(errors.select("site", "url", F.col("error_code").alias("status")))


# --- content -------------------------------------------------------------------


def remove_noise(spark, sf):
    pages = _pages(spark, sf)
    out = render_html(C.remove_noise(html_nodes(pages), slices=page_slices(pages)))
    left = F.regexp_count("html", F.lit("<(nav|footer|script|style|div)[ >]")).alias("noise_tags")
    digests = (_squashed(F.col("html")).alias("text_md5"), _tags(F.col("html")).alias("tags_md5"))
    return out.select("page_id", *digests, left, F.regexp_count("html", F.lit("<!--")).alias("comments"))


def remove_empty_elements(spark, sf):
    """Empty elements of several kinds put in front of each article."""
    junk = F.lit("<div><p> </p><span></span></div><section><!-- c --></section><div><br></div><p><img src=x></p>")
    pages = _pages(spark, sf).withColumn("html", F.replace("html", F.lit("<article>"), F.concat(junk, F.lit("<article>"))))
    nodes = C.remove_empty_elements(html_nodes(pages)).filter("kind = 'element'")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def strip_attributes(spark, sf):
    """Event, data and style attributes put on every article and paragraph."""
    pages = _pages(spark, sf).withColumn(
        "html", F.regexp_replace("html", "<(article|p)>", '<$1 onclick="f()" data-n="1" style="x" id="k" aria-label="a" foo="b">')
    )
    nodes = html_nodes(pages).filter("kind = 'element'")
    def names(df, label):
        per = df.select("page_id", F.explode(F.map_keys("attrs")).alias("name"))
        return per.groupBy("page_id", "name").agg(F.count("*").alias("n")).withColumn("step", F.lit(label))

    out = names(C.remove_event_attrs(nodes), "events").unionByName(names(C.remove_data_attrs(nodes), "data"))
    return out.unionByName(names(N.clean_html(nodes), "clean"))


def parse_pages(spark, sf):
    out = C.parse_pages(_pages(spark, sf))
    digests = (_squashed(F.col("content")).alias("text_md5"), _tags(F.col("content")).alias("tags_md5"))
    return out.select("page_id", "title", *digests, F.size("images").alias("n_images"), "error_code")


# a user's configuration file
USER_CONFIG = '{"selectors": {"content": ["body > article"], "title": ["article > h1"], "exclude": ["nav", ".ad"]}, "imageOptions": {"format": "png"}}'


def configured_pages(spark, sf):
    """Pages parsed by a configuration which is read from a file and filled from the defaults."""
    folder = f"{scratch_dir(spark)}/config-{uuid.uuid4().hex}"
    spark.createDataFrame([(USER_CONFIG,)], "value string").write.text(folder)
    mine = P.as_profile(P.merge_profile(P.load_profiles(spark, folder)))
    out = C.parse_pages(_pages(spark, sf), [mine])
    return out.select("page_id", "title", _squashed(F.col("content")).alias("text_md5"), F.lit(mine.image_options["format"]).alias("format"))


def converted_tags(spark, sf):
    """Elements outside the allow-list put in front of each article."""
    junk = "".join(f'<{t} id="n{i}" class="c" foo="b">x</{t}>' for i, t in enumerate("font blink center tt dialog button mark".split()))
    pages = _pages(spark, sf).withColumn("html", F.replace("html", F.lit("<article>"), F.lit(f"{junk}<article>")))
    nodes = N.convert_invalid_tags(html_nodes(pages)).filter(F.col("elem_id").rlike("^n[0-9]$"))
    return nodes.select("page_id", "elem_id", "tag", F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("attributes"))


def _with_images(spark, sf):
    """Pages with images by relative, root and data URLs, one of them twice."""
    tag = F.concat(
        F.lit('<p><img src="/img/'), (F.col("page_id") % 7).cast("string"), F.lit('.png" alt="seven"><img src="pic'),
        (F.col("page_id") % 3).cast("string"), F.lit('.jpg" srcset="a.jpg 1x, /b.jpg 2x"><img src="data:image/png;base64,AA"><img src="/img/'),
        (F.col("page_id") % 7).cast("string"), F.lit('.png"></p></article>'),
    )
    return _pages(spark, sf).withColumn("html", F.replace("html", F.lit("</article>"), tag))


def extract_images(spark, sf):
    return I.image_refs(C.parse_pages(_with_images(spark, sf))).select("page_id", "pos", "original_url", "alt_text")


def clean_content(spark, sf):
    """Whole pages as content, with an empty link and runs of blanks put in."""
    put = F.lit('<a href="/e"> </a>\n \n\n<a href="/i"><img src="i.png"></a> \t x<article>')
    pages = _pages(spark, sf).withColumn("content", F.replace("html", F.lit("<article>"), put))
    out = C.clean_content(pages)
    return out.select(
        "page_id", _squashed(F.col("content")).alias("text_md5"),
        F.regexp_count("content", F.lit("<a ")).alias("links"), F.col("content").contains("\n\n\n").alias("loose"),
    )


def largest_text_block(spark, sf):
    """Pages whose article became a plain block, so that no content selector matches."""
    pages = _pages(spark, sf).withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", "<section>"), "</article>", "</section>"))
    out = C.parse_pages(pages)
    return out.select("page_id", "title", _squashed(F.col("content")).alias("text_md5"))


# --- normalisation ---------------------------------------------------------------


def fix_headings(spark, sf):
    """Headings of levels derived from each page, in page order before and after repair."""
    def tag(k, level):
        return F.concat(F.lit("<h"), level.cast("string"), F.lit(f">{k}</h"), level.cast("string"), F.lit(">"))

    levels = [F.col("page_id") % 6 + 1, F.length("html") % 6 + 1, F.length("url") % 6 + 1, F.col("page_id") % 2 + 3]
    pages = _pages(spark, sf).withColumn("html", F.concat(*[tag(k, v) for k, v in enumerate(levels)]))
    nodes = html_nodes(pages)
    def listed(df):
        heads = df.filter("tag rlike '^h[1-6]$'").groupBy("page_id")
        return heads.agg(F.expr("listagg(tag, ',') within group (order by pos)").alias("tags"))

    fixed = listed(N.fix_heading_hierarchy(nodes)).withColumnRenamed("tags", "fixed")
    return fixed.join(listed(N.normalize_chapter_headings(nodes)).withColumnRenamed("tags", "shifted"), "page_id")


def node_table(spark, sf):
    """Heading and links of each page from one stored node table."""
    nodes = bucketed_nodes(_pages(spark, sf), carry=("url",))
    links = L.link_audit(nodes, ["a"]).select("site", "page_id", F.col("matched").alias("links"))
    out = N.first_heading(nodes).join(links, ["site", "page_id"], "left")
    return out.select("page_id", "heading", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def first_heading(spark, sf):
    return N.first_heading(html_nodes(_pages(spark, sf))).select("page_id", "heading")


def link_dispositions(spark, sf):
    """Page links, with an anchor, a mail and an external link put in."""
    put = F.lit('<a href="#x">a</a><a href="mailto:m">b</a><a href="https://other.example/">c</a><article>')
    pages = _pages(spark, sf).withColumn("html", F.replace("html", F.lit("<article>"), put))
    nodes = html_nodes(pages, carry=("url",))
    return N.link_dispositions(nodes).select("page_id", "href", "disposition", "resolved")


def normalize_pages(spark, sf):
    pages = _pages(spark, sf).withColumn("content", F.col("html"))
    out = N.normalize_pages(pages.drop("html"), slices=page_slices(pages))
    return out.select("page_id", F.regexp_count("content", F.lit("<a ")).alias("links"), F.regexp_count("content", F.lit("<span>")).alias("spans"),
                      F.regexp_count("content", F.lit("(class|style|data-[a-z]+)=")).alias("attributes"))


def strip_links(spark, sf):
    out = render_html(N.strip_links(html_nodes(_pages(spark, sf))))
    return out.select("page_id", F.regexp_count("html", F.lit("<a[ >]")).alias("links"), F.regexp_count("html", F.lit("<span>")).alias("spans"))


def remove_images(spark, sf):
    put = F.lit('<figure><img src="x"></figure><figure><img src="y"><b>t</b></figure><picture><source><img src="z"></picture><article>')
    pages = _with_images(spark, sf).withColumn("html", F.replace("html", F.lit("<article>"), put))
    nodes = I.remove_images(html_nodes(pages)).filter("kind = 'element' and tag in ('img', 'picture', 'source', 'figure', 'p')")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def image_urls(spark, sf):
    nodes = html_nodes(_with_images(spark, sf), carry=("url",))
    return I.extract_image_urls(nodes).select("page_id", "image_url")


def _refs(spark, sf):
    nodes = html_nodes(_with_images(spark, sf), carry=("url",)).filter("tag = 'img'")
    src = F.col("attrs")["src"]
    return nodes.filter(~src.startswith("data:")).select("site", "page_id", "url", src.alias("original_url"))


def image_catalog(spark, sf):
    return I.image_catalog(_refs(spark, sf))


def resolve_image_urls(spark, sf):
    nodes = html_nodes(_with_images(spark, sf), carry=("url",))
    images = N.resolve_image_urls(nodes).filter("tag = 'img'")
    rank = F.row_number().over(Window.partitionBy("site", "page_id").orderBy("pos"))
    return images.select("page_id", rank.alias("n"), F.col("attrs")["src"].alias("src"), F.col("attrs")["srcset"].alias("srcset"))


def update_image_refs(spark, sf):
    """References to root images go to the package; the others are not in the catalog."""
    catalog = I.image_catalog(_refs(spark, sf).filter("original_url like '/img/%'"))
    nodes = html_nodes(_with_images(spark, sf), carry=("url",))
    images = I.update_image_refs(nodes, catalog).filter("tag = 'img'")
    return images.groupBy("page_id", F.col("attrs")["src"].alias("src")).agg(F.count("*").alias("n"))


def match_images(spark, sf):
    """References as written and as file names, against the catalog."""
    refs = _refs(spark, sf)
    catalog = I.image_catalog(refs)
    named = catalog.select("site", F.concat(F.lit("x/"), "filename").alias("url"))
    whole = refs.select("site", U.resolve_url(F.col("original_url"), F.col("url")).alias("url"))
    asked = refs.select("site", F.col("original_url").alias("url")).unionByName(named).unionByName(whole)
    return I.match_images(asked, catalog).select("site", "url", "image_id", "tier")


def minify_html(spark, sf):
    return _pages(spark, sf).select("page_id", F.md5(S.minify_html(F.col("html"))).alias("html_md5"))


# --- chapters ----------------------------------------------------------------------


def _titled(spark, sf, by_language=False):
    site = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1) if by_language else None
    pages = read_pages(spark, f"{sf}/pages.parquet", site)
    return pages.select("site", "page_id", "url", S.page_title(F.col("html")).alias("title"), F.col("html").alias("content"), F.col("page_id").cast("int").alias("order"))


def sanitize_title(spark, sf):
    """Titles of pages, and whole documents as titles."""
    pages = _pages(spark, sf).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), S.sanitize_title(S.page_title(F.col("html"))).alias("title"))
    docs = _documents(spark, sf).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), S.sanitize_title(F.col("text")).alias("title"))
    return pages.unionByName(docs)


def dedupe_titles(spark, sf):
    return H.dedupe_titles(_titled(spark, sf).drop("content", "url")).select("site", "page_id", "title")


def dedupe_titles_language(spark, sf):
    """The language as the site, which makes few, large groups; scanned in slices."""
    pages = _titled(spark, sf, by_language=True).drop("content", "url")
    return H.dedupe_titles(pages, limit=100).select("site", "page_id", "title")


def create_chapters(spark, sf):
    out = H.create_chapters(_titled(spark, sf))
    return out.select("site", "page_id", "id", "title", F.md5("content").alias("content_md5"), "order", "source_url")


def duplicate_chapter_ids(spark, sf):
    return H.duplicate_chapter_ids(H.create_chapters(_titled(spark, sf, by_language=True)))


def filter_valid_chapters(spark, sf):
    """Each turn of a conversation as a chapter of its text."""
    turns = _raw(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("site"), F.col("turn").alias("page_id"), "role", "text")
    wrapped = turns.withColumn("content", H.wrap_chapter(F.col("text"), F.col("role")))
    return H.filter_valid_chapters(wrapped).select("site", "page_id", F.length("content").alias("size"))


def sort_by_order(spark, sf):
    """The sorted rows with their places in the whole result."""
    placed = H.sort_by_order(_titled(spark, sf)).select("site", "page_id", "order").withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("all", F.lit(0)), "sorted")
    return ordered_scan(placed, ["all"], [F.col("at")], position="place").select("site", "page_id", "order", (F.col("place") + 1).alias("place"))


def _orders(spark, sf):
    """Orders as chapters of their customer; for even customers several share one position."""
    place = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 3).otherwise(F.col("o_orderkey"))
    return _raw(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("site"),
        F.col("o_orderkey").alias("page_id"),
        F.lpad(F.pmod(F.col("o_orderkey") * 7919, F.lit(1009)).cast("string"), 9, "0").alias("title"),
        place.cast("int").alias("order"),
    )


def normalize_order(spark, sf):
    return H.normalize_order(_orders(spark, sf)).select("site", "page_id", "order")


def resolve_duplicate_orders(spark, sf):
    return H.resolve_duplicate_orders(_orders(spark, sf)).select("site", "page_id", "order")


def resolve_duplicate_orders_sliced(spark, sf):
    """All orders of one status as one site, scanned in slices."""
    orders = _raw(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("site"),
        F.col("o_orderkey").alias("page_id"),
        F.lpad(F.pmod(F.col("o_orderkey") * 7919, F.lit(1009)).cast("string"), 9, "0").alias("title"),
        (F.col("o_orderkey") % 100).cast("int").alias("order"),
    )
    return H.resolve_duplicate_orders(orders, limit=1000).select("site", "page_id", "order")


def _turns(spark, sf, title):
    turns = _raw(spark, sf, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("site"),
        F.col("turn").cast("bigint").alias("page_id"),
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"),
        F.expr(title).alias("title"),
        F.col("text").alias("content"),
        F.col("turn").cast("int").alias("order"),
        F.concat(F.lit("https://c"), F.col("conv_id").cast("string"), F.lit(".github.io/t/"), F.col("turn").cast("string")).alias("source_url"),
    )


NUMBERED = "concat(if(turn % 2 = 0, 'Chapter ', 'The chapter  '), cast(length(text) % 9 as string), ' ', role)"
PARTED = "concat(if(length(text) % 3 = 0, 'Part II ', 'On '), cast(length(text) % 2 as string))"
LEVELLED = (
    "element_at(array('Intro', '1. One', '1.1 Two', '1.2.3 Three', '4.1.2.9. Four', 'Section 2.1', ' 7 Seven'), "
    "cast(length(text) % 7 as int) + 1)"
)


def move_chapter(spark, sf):
    turns = _turns(spark, sf, "role").drop("content", "source_url")
    as_is = H.move_chapter(turns, 0, 2).select("site", "page_id", "order")
    moved = H.move_chapter(turns, 3, 1, by_position=True).select("site", "page_id", F.col("order").alias("moved"))
    return as_is.join(moved, ["site", "page_id"])


def order_anomalies(spark, sf):
    return H.detect_order_anomalies(_turns(spark, sf, NUMBERED)).select("site", "order", "message")


def group_by_section(spark, sf):
    return H.group_by_section(_turns(spark, sf, PARTED)).select("site", "order", "section")


def section_sizes(spark, sf):
    return H.section_sizes(H.group_by_section(_turns(spark, sf, PARTED)))


def build_chapters(spark, sf):
    out = H.build_chapters(_titled(spark, sf))
    return out.select("site", "page_id", "id", "title", "order")


# --- books -------------------------------------------------------------------------


def _chapters(spark, sf):
    return H.create_chapters(_titled(spark, sf))


def chapters_to_content(spark, sf):
    out = B.chapters_to_content(_chapters(spark, sf))
    return out.select("site", "seq", "filename", "title", F.md5("data").alias("data_md5"), "exclude_from_toc", "before_toc")


def flat_toc(spark, sf):
    return B.flat_toc(_chapters(spark, sf)).select("site", "id", "title", "order", "level")


def toc_level(spark, sf):
    return _turns(spark, sf, LEVELLED).select("site", "order", B.toc_level(F.col("title")).alias("level"))


def hierarchical_toc(spark, sf):
    return B.hierarchical_toc(_turns(spark, sf, LEVELLED)).select("site", "id", "order", "level", "parent_id", "depth")


def flatten_toc(spark, sf):
    return B.flatten_toc(B.hierarchical_toc(_turns(spark, sf, LEVELLED))).select("site", "id", "seq")


def toc_html(spark, sf):
    """Nested tables of contents, line by line."""
    out = B.toc_html(B.hierarchical_toc(_turns(spark, sf, LEVELLED)))
    return out.select("site", "part", F.md5("data").alias("data_md5"))


def toc_content(spark, sf):
    out = B.toc_content(_turns(spark, sf, "role"))
    return out.select("site", "filename", "part", "title", F.md5("data").alias("data_md5"), "exclude_from_toc", "before_toc")


def infer_metadata(spark, sf):
    return B.infer_metadata(_chapters(spark, sf))


def infer_publisher(spark, sf):
    u = F.regexp_replace("url", F.lit("example[.](com|org|net)"), F.lit("github.io"))
    v = F.expr("element_at(array(url, u, regexp_replace(url, '//', '//www.'), regexp_replace(url, 'example', 'readthedocs')), cast(page_id % 4 as int) + 1)")
    return _pages(spark, sf).withColumn("u", u).select("page_id", B.infer_publisher(v).alias("publisher"))


def create_books(spark, sf):
    return B.create_books(_chapters(spark, sf)).select("site", "title", "author", "language")


def enrich_metadata(spark, sf):
    chapters = _chapters(spark, sf)
    books = B.create_books(chapters).withColumn("title", F.lit(""))
    return B.enrich_metadata(books, chapters).select("site", "title", "publisher", "description")


def sanitize_metadata(spark, sf):
    docs = _documents(spark, sf)
    return docs.select("doc_id", F.md5(S.sanitize_metadata_field(F.col("text"))).alias("text_md5"))


def book_options(spark, sf):
    out = B.book_options(B.create_books(_chapters(spark, sf), author="A. Writer"), date="2024-01-01")
    return out.select("site", "title", "author", "lang", "toc_title", "identifier", "date")


def output_filename(spark, sf):
    docs = _documents(spark, sf)
    return docs.select("doc_id", B.output_filename(F.col("text")).alias("filename"))


def validate_books(spark, sf):
    """Chapters of every fifth site are taken away and some contents emptied."""
    chapters = _chapters(spark, sf)
    books = B.create_books(chapters)
    kept = chapters.filter(F.length("site") % 5 != 0)
    hollow = kept.withColumn("content", F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("content")))
    return B.validate_books(books, hollow)


def build_report(spark, sf):
    return B.build_report(_chapters(spark, sf))


def split_errors_query(spark, sf):
    """Every tenth page has next to nothing to say."""
    thin = F.when(F.col("page_id") % 10 == 0, F.lit("<body><p>hi</p></body>")).otherwise(F.col("html"))
    parsed = materialize(C.parse_pages(_pages(spark, sf).withColumn("html", thin)), "parsed")
    good, bad = split_errors(parsed)
    return good.select("page_id", F.lit("OK").alias("status")).unionByName(bad.select("page_id", F.col("error_code").alias("status")))


def book_corpus(spark, sf):
    """All sites from stored pages to books: the chapters each book got."""
    corpus = build_book_corpus(_pages(spark, sf))
    counts = corpus.report.select("site", "chapters_count", "images_count")
    return corpus.books.join(counts, "site").select("site", "title", "publisher", "chapters_count", "images_count")


def incremental_corpus(spark, sf):
    """Books of a dataset which was built when a third of the sites had other pages, and then brought up to date."""
    pages = _pages(spark, sf)
    other = F.pmod(F.xxhash64("site"), F.lit(3)) == 0
    earlier = pages.filter(~other | (F.col("page_id") % 4 != 1))
    earlier = earlier.withColumn("html", F.when(other, F.replace("html", F.lit("<h1>"), F.lit("<h1>Old "))).otherwise(F.col("html")))
    path = f"{scratch_dir(spark)}/books-{uuid.uuid4().hex}"
    update_book_corpus(earlier, path, buckets=16)
    update_book_corpus(pages, path, buckets=16)
    counts = read_book_table(spark, path, "report").select("site", "chapters_count", "images_count")
    books = read_book_table(spark, path, "books")
    return books.join(counts, "site").select("site", "title", "publisher", "chapters_count", "images_count")


def book_chapters(spark, sf):
    """All sites from stored pages to chapters."""
    chapters = build_book_corpus(_pages(spark, sf)).chapters
    return chapters.select("site", "page_id", "id", "title", "order")


def corpus_ledger(spark, sf):
    """Every stored page once: its chapter, or why it has none.

    Of ten pages one has next to no HTML and one an article without enough text for a chapter.
    """
    part = F.col("page_id") % 10
    thin = F.when(part == 3, F.lit("<body><p>hi</p></body>")).when(
        part == 4, F.lit("<body><article><h1>T</h1><p class='short'><b>few</b> <i>words</i> <u>only</u></p></article></body>")
    )
    pages = _pages(spark, sf).withColumn("html", F.coalesce(thin, F.col("html")))
    corpus = build_book_corpus(pages)
    told = corpus.errors.filter("page_id is not null").select("page_id", F.col("error_code").alias("status"))
    return corpus.chapters.select("page_id", F.lit("CHAPTER").alias("status")).unionByName(told)


QUERIES: dict[str, Query] = {
    "read_pages": read_pages_query,
    "html_nodes": html_nodes_query,
    "html_text": html_text,
    "render_html": render_html_query,
    "resolve_url": resolve_url,
    "url_checks": url_checks,
    "same_site": same_site,
    "normalize_url": normalize_url,
    "url_keys": url_keys,
    "url_kinds": url_kinds,
    "match_selectors": match_selectors,
    "nav_links": nav_links,
    "all_links": all_links,
    "chapter_links": chapter_links,
    "site_profile": site_profile,
    "select_strategy": select_strategy,
    "find_next_link": find_next_link,
    "page_title": page_title,
    "link_audit": link_audit,
    "canonical_pages": canonical_pages,
    "next_chain": next_chain,
    "long_chain": long_chain,
    "crawl_sidebar": crawl_sidebar,
    "crawl_sites": crawl_sites,
    "remove_noise": remove_noise,
    "remove_empty_elements": remove_empty_elements,
    "strip_attributes": strip_attributes,
    "parse_pages": parse_pages,
    "configured_pages": configured_pages,
    "converted_tags": converted_tags,
    "extract_images": extract_images,
    "clean_content": clean_content,
    "largest_text_block": largest_text_block,
    "fix_headings": fix_headings,
    "node_table": node_table,
    "first_heading": first_heading,
    "link_dispositions": link_dispositions,
    "normalize_pages": normalize_pages,
    "strip_links": strip_links,
    "remove_images": remove_images,
    "image_urls": image_urls,
    "image_catalog": image_catalog,
    "resolve_image_urls": resolve_image_urls,
    "update_image_refs": update_image_refs,
    "match_images": match_images,
    "minify_html": minify_html,
    "sanitize_title": sanitize_title,
    "dedupe_titles": dedupe_titles,
    "dedupe_titles_language": dedupe_titles_language,
    "create_chapters": create_chapters,
    "duplicate_chapter_ids": duplicate_chapter_ids,
    "filter_valid_chapters": filter_valid_chapters,
    "sort_by_order": sort_by_order,
    "normalize_order": normalize_order,
    "resolve_duplicate_orders": resolve_duplicate_orders,
    "resolve_duplicate_orders_sliced": resolve_duplicate_orders_sliced,
    "move_chapter": move_chapter,
    "order_anomalies": order_anomalies,
    "group_by_section": group_by_section,
    "section_sizes": section_sizes,
    "build_chapters": build_chapters,
    "chapters_to_content": chapters_to_content,
    "flat_toc": flat_toc,
    "toc_level": toc_level,
    "hierarchical_toc": hierarchical_toc,
    "flatten_toc": flatten_toc,
    "toc_html": toc_html,
    "toc_content": toc_content,
    "infer_metadata": infer_metadata,
    "infer_publisher": infer_publisher,
    "create_books": create_books,
    "enrich_metadata": enrich_metadata,
    "sanitize_metadata": sanitize_metadata,
    "book_options": book_options,
    "output_filename": output_filename,
    "validate_books": validate_books,
    "build_report": build_report,
    "split_errors": split_errors_query,
    "book_corpus": book_corpus,
    "corpus_ledger": corpus_ledger,
    "incremental_corpus": incremental_corpus,
    "book_chapters": book_chapters,
}
