"""Comparison SQL for DuckDB over the same tables, one statement per query.

Written for the regular shape of the given pages: regular expressions stand in for
the tree. Queries whose result has no such form have no entry.
"""

from __future__ import annotations

# fixed values, written out again so that a wrong one in the library shows
TOC_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html>
<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">
<head>
  <meta charset="UTF-8" />
  <title>{title}</title>
  <style>
    nav ol {
      list-style-type: none;
      padding-left: 1.5em;
    }
    nav > ol {
      padding-left: 0;
    }
    nav li {
      margin: 0.5em 0;
    }
    nav a {
      text-decoration: none;
      color: inherit;
    }
    nav a:hover {
      text-decoration: underline;
    }
  </style>
</head>
<body>
  <nav epub:type="toc" id="toc">
    <h1>{title}</h1>
    <ol>
"""
TOC_TAIL = """
    </ol>
  </nav>
</body>
</html>"""
HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html>
<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">
<head>
  <meta charset="UTF-8" />
  <title>"""
MIDDLE = """</title>
</head>
<body>
  """
TAIL = """
</body>
</html>"""
BOILERPLATE = '(?i)^(home|about|contact|search|login|sign (in|up)|register|share|tweet|facebook|twitter|github|edit|download)\\z|^(privacy|terms|cookie)'
ASSET_EXTENSIONS = (
    "css", "js", "json", "xml", "rss", "atom", "txt", "pdf", "zip", "tar", "gz", "mp3", "mp4", "wav", "avi", "jpg",
    "jpeg", "png", "gif", "webp", "svg", "bmp", "ico", "woff", "woff2", "ttf", "eot",
)
ASSET_PATHS = (
    "/api/", "/admin/", "/wp-admin/", "/wp-includes/", "/assets/", "/static/", "/fonts/", "/images/", "/img/",
    "/css/", "/js/",
)
IMAGE_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico",
)

WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_CODES = [9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]
WS_CHARS = " || ".join(f"chr({c})" for c in _CODES)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def got(x: str, pattern: str) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, 1)"



def tags(x: str) -> str:
    """Digest of opening tags in order, with their links, ``b`` apart."""
    return f"""md5(list_aggregate(list_filter(regexp_extract_all({x}, '<([a-zA-Z][a-zA-Z0-9]*(?: href="[^"]*")?)', 1), lambda t: t <> 'b'), 'string_agg', ','))"""


def n_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def decode(x: str) -> str:
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        x = f"replace({x}, {lit(ref)}, {lit(char)})"
    return sub(x, "&amp;?", "&")


def squash(x: str) -> str:
    """Digest of the text of HTML source, white space left out."""
    return f"md5({sub(sub(decode(x), '<[^>]+>'), r'[\s\x0B]+')})"


def enc(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: case when regexp_matches(c, '[^!-~]') then url_encode(c) else c end), '')"


def site(u: str = "url") -> str:
    return got(u, "^(https?://[^/?#]+)")


def path(u: str = "url") -> str:
    return got(u, "^https?://[^/?#]*([^?#]*)")


def directory(u: str = "url") -> str:
    return sub(path(u), "/?[^/]*$")


def norm(u: str) -> str:
    stem = sub(got(u, "^([^?#]*)"), "^(https?://[^/]*/.+)/$", r"\1")
    query = got(u, r"^[^?#]*\?([^#]*)")
    pairs = f"list_transform(list_filter(string_split({query}, '&'), lambda s: s <> ''), lambda s, i: {{'n': split_part(s, '=', 1), 'i': i, 't': s}})"
    joined = f"array_to_string(list_transform(list_sort({pairs}), lambda z: z.t), '&')"
    return f"({stem} || case when {query} = '' then '' else '?' || {joined} end)"


def sanitized(t: str) -> str:
    x = sub(trim(f"coalesce({t}, '')"), "<[^>]+>", " ")
    x = sub(f"translate({x}, '<>&\"''', '')", f"{WS}+", " ")
    return f"coalesce(nullif({trim(f'substring({x}, 1, 200)')}, ''), 'Untitled')"


def metadata(t: str) -> str:
    x = sub(sub(trim(t), "<[^>]+>", " "), f"{WS}+", " ")
    return f"nullif({trim(sub(x, r'[\x00-\x1F\x7F]'))}, '')"


def slug(x: str) -> str:
    return f"substring({sub(sub(f'lower({x})', '[^a-z0-9]+', '-'), '^-|-$')}, 1, 100)"


def escaped(x: str) -> str:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {lit(raw)}, {lit(ref)})"
    return x


def wrapped(content: str, title: str) -> str:
    return f"({lit(HEAD)} || {escaped(title)} || {lit(MIDDLE)} || {content} || {lit(TAIL)})"


def path_id(u: str = "url") -> str:
    last = f"coalesce(nullif({got(path(u), '([^/]+)/*$')}, ''), 'index')"
    name = f"lower({sub(last, r'(?i)[.](html?|md|php|asp)$')})"
    return sub(sub(sub(name, "[^a-z0-9-]", "-"), "-+", "-"), "^-|-$")


def chapter_id(u: str, index: str) -> str:
    return (
        f"case when {path_id(u)} in ('', 'index', 'page') then 'chapter-' || ({index} + 1) || '-' || substring(md5({u}), 1, 8) "
        f"else 'chapter-' || {path_id(u)} end"
    )


def url_title(u: str = "url", fallback: str = "Untitled") -> str:
    parts = f"list_filter(string_split({path(u)}, '/'), lambda p: p <> '' and not contains(p, '.'))"
    words = sub(f"{parts}[-1]", "[-_]", " ")
    titled = f"array_to_string(list_transform(string_split({words}, ' '), lambda s: upper(s[1]) || s[2:]), ' ')"
    label = got(u, r"^https?://(?:www\.)?([^./?#]*)")
    return f"case when len({parts}) > 0 then {titled} else coalesce(nullif({label}, ''), {lit(fallback)}) end"


TITLE = trim(got("html", "(?i)<title[^>]*>([^<]+)</title>"))
ARTICLE = got("html", "(?s)<article>(.*)</article>")
H1 = got("html", "(?s)<h1>(.*?)</h1>")
ASSETS = rf"\.({'|'.join(ASSET_EXTENSIONS)})$|{'|'.join(ASSET_PATHS)}"
P = f"p as (select {site()} as site, page_id, url, html from pages)"
LANG = f"p as (select {got('url', '^https?://[^/]+/([a-z]+)/')} as site, page_id, url, html from pages)"
# links of each page: position, href, text, absolute URL
A = f"""a as (select page_id, site, url, (pos - 1)::int as pos, href, {trim('txt')} as txt, site || {enc('href')} as r from (
  select page_id, {site()} as site, url, unnest(h) as href, unnest(t) as txt, generate_subscripts(h, 1) as pos from (
    select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) as h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) as t from pages)))"""
IN_SITE = f"({directory()} = '' or starts_with({path('r')}, {directory()}))"
IS_PAGE = f"not regexp_matches(lower({path('r')}), {lit(ASSETS)})"


def first_links(where: str) -> str:
    """Accepted links, first per target, numbered."""
    return (
        f"l as (select page_id, site, href2 as href, txt as text, (row_number() over (partition by page_id order by pos) - 1)::int as \"order\" from ("
        f"select *, row_number() over (partition by page_id, href2 order by pos) as k from (select *, {norm('r')} as href2 from a where {where})) where k = 1)"
    )


def titled(base: str = P) -> str:
    """Pages with deduplicated titles, as the chapter operators read them."""
    return f"""{base}, t as (select *, raw, {sanitized('raw')} as san from (select *, {TITLE} as raw from p)),
d as (select *, coalesce(sum(case when raw = san then 1 else 0 end) over (partition by site, san order by page_id rows between unbounded preceding and 1 preceding), 0) as k,
  row_number() over (partition by site order by page_id) - 1 as idx from t),
c as (select site, page_id, url, html, idx, {sanitized("case when k > 0 then san || ' (' || (k + 1) || ')' else san end")} as title from d),
ch as (select site, page_id, {chapter_id('url', 'idx')} as id, title, {wrapped('html', 'title')} as content, page_id::int as "order", url as source_url from c)"""


CHAPTERS = titled()


def turns(title: str) -> str:
    return f"""t as (select conv_id::varchar as site, turn::bigint as page_id, 't' || turn as id, {title} as title, text as content, turn::int as "order" from conversations)"""


NUMBERED = "(case when turn % 2 = 0 then 'Chapter ' else 'The chapter  ' end) || (length(text) % 9) || ' ' || role"
PARTED = "(case when length(text) % 3 = 0 then 'Part II ' else 'On ' end) || (length(text) % 2)"
LEVELLED = "['Intro', '1. One', '1.1 Two', '1.2.3 Three', '4.1.2.9. Four', 'Section 2.1', ' 7 Seven'][length(text) % 7 + 1]"
_NUMBER = got(trim("title"), rf"^(([0-9]+\.)*[0-9]+(?:\.|{WS}))")
LEVEL = f"""(case when {_NUMBER} <> '' then length({_NUMBER}) - length(replace({_NUMBER}, '.', ''))
  when regexp_matches({trim('title')}, '(?i)^section{WS}+[0-9.]+') then 1 else 0 end)::int"""
TOC = f"""{turns(LEVELLED)}, e as (select *, {LEVEL} as level from t),
pr as (select x.site, x.id, x."order", x.level, (select max_by(y.id, y."order") from e y where y.site = x.site and y."order" < x."order" and y.level < x.level) as parent_id from e x),
tree as (select site, id, 0 as depth from pr where parent_id is null union all select pr.site, pr.id, tree.depth + 1 from pr join tree on pr.site = tree.site and pr.parent_id = tree.id)"""

IMG_A = "'/img/' || (page_id % 7) || '.png'"
IMG_B = "'pic' || (page_id % 3) || '.jpg'"
BASE = f"{site()} || {sub(path(), '[^/]*$')}"
REFS = f"""refs as (select page_id, {site()} as site, url, unnest([{IMG_A}, {IMG_B}, {IMG_A}]) as original_url from pages),
abs as (select *, case when original_url[1] = '/' then site || original_url else {BASE} || original_url end as u from refs)"""
CAT = f"""{REFS}, cat as (select distinct site, 'img-' || substring(md5(u), 1, 12) as image_id, u as url, 'image/jpeg' as mime_type, 'img-' || substring(md5(u), 1, 12) || '.jpg' as filename from abs)"""
KIND_URL = (
    sub("url", "([?#].*|[.]html|/)$")
    + " || ['.png', '.CSS', '/img/x', '.html', '', '/api/', '.webp'][page_id % 7 + 1]"
)
PROFILE_URL = f"regexp_replace(replace(url, 'example.', ['example', 'github', 'gitbook', 'jekyll'][page_id % 4 + 1] || '.'), 'github[.](com|org|net)', 'github.io')"
SORTED_SITE = f"canon as (select * from (select *, {norm('url')} as norm_url, row_number() over (partition by site, {norm('url')} order by page_id) as k from p) where k = 1)"
DESCRIPTION = """(select site, 'Chapters: ' || string_agg(title, ', ' order by page_id) filter (where n <= 5) || case when count(*) > 5 then ', and ' || (count(*) - 5) || ' more' else '' end as description
  from (select site, page_id, title, row_number() over (partition by site order by page_id) as n from ch) group by site)"""


def attr_counts() -> str:
    n_marked = f"({n_of('html', '<p>')} + 1)"
    steps = {
        "events": ["data-n", "style", "id", "aria-label", "foo", "lang", "charset", "class", "href"],
        "data": ["onclick", "style", "id", "aria-label", "foo", "lang", "charset", "class", "href"],
        "clean": ["id", "aria-label", "lang", "class", "href"],
    }
    single = {"lang": "1", "charset": "1", "class": "1", "href": n_of("html", "<a ")}
    rows = [
        f"select page_id, {lit(a)} as name, ({single.get(a, n_marked)})::bigint as n, {lit(step)} as step from pages"
        for step, names in steps.items()
        for a in names
    ]
    return f"select * from ({' union all '.join(rows)}) where n > 0"


TAGS = "select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages"
# a <b> that is never closed is opened again in every later paragraph and in the footer, of several the last three
BOLD = """select page_id, 'b' as tag, total + least(3, total) + sum(least(3, before)) as n from (
  select page_id, len(regexp_extract_all(html, '<b>')) as total, len(regexp_extract_all(array_to_string(seg[1:i - 1], ' '), '<b>')) as before
  from (select page_id, html, string_split(html, '<p>') as seg, unnest(generate_series(2, len(string_split(html, '<p>')))) as i from pages)) group by page_id, total having total > 0"""
WITH_EXTRA = " union all ".join([TAGS, *[f"select page_id, {lit(t)} from pages" for t in ("div", "br", "p", "img")]])

# rendered text of an article: entities written the way the renderer does
_BODY = trim(sub(sub(ARTICLE, "<[^>]+>"), r"[ \t]+", " "))
_RENDERED = f"replace(replace(replace({decode(_BODY)}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
BOOK = f"""{P}, {SORTED_SITE}, t as (select *, {sanitized('raw')} as san from (select site, page_id, url, html, {trim(decode(H1))} as raw from canon)),
  d as (select *, coalesce(sum(case when raw = san then 1 else 0 end) over (partition by site, san order by page_id rows between unbounded preceding and 1 preceding), 0) as k, row_number() over (partition by site order by page_id) - 1 as idx from t),
  named as (select *, {chapter_id('url', 'idx')} as id, {sanitized("case when k > 0 then san || ' (' || (k + 1) || ')' else san end")} as title from d),
  kept as (select * from named where length({escaped('title')}) + 5 + length({_RENDERED}) >= 50)"""

# the same over pages of which some are thin
THIN = """case page_id % 10 when 3 then '<body><p>hi</p></body>'
  when 4 then '<body><article><h1>T</h1><p class=''short''><b>few</b> <i>words</i> <u>only</u></p></article></body>' else html end"""
LEDGER = BOOK.replace(P, P.replace("url, html from", f"url, {THIN} as html from"))
# inner HTML of an article as rendered: the source, the ends of its last paragraph, and what later paragraphs open again
RENDERED_SIZE = f"(length({trim(ARTICLE)}) + 8 + 7 * greatest({n_of(ARTICLE, '<p>')} - 1, 0))"
# an article of 50 characters or less is too short for a selector, and the body is taken
CHOSEN = f"case when {RENDERED_SIZE} > 50 then {ARTICLE} else '<article>' || {ARTICLE} end"

ORACLES: dict[str, str] = {
    "read_pages": f"select {site()} as site, page_id, url, md5(html) as html_md5 from pages",
    "html_nodes": f"select page_id, tag, count(*) as n from ({TAGS}) where tag <> 'b' group by all union all {BOLD}",
    "html_text": "select page_id, md5(replace("
    + sub(sub(decode("replace(html, '\"</p>\"', '\"' || chr(1) || '\"')"), "<[^>]+>"), r"[\s\x0B]+")
    + ", chr(1), '</p>')) as text_md5 from pages",
    "render_html": f"select page_id, {squash('html')} as text_md5, {tags('html')} as tags_md5 from pages",
    "resolve_url": f"with {A} select page_id, pos, r as resolved from a",
    "url_checks": """with v as (select page_id, unnest([0, 1, 2, 3])::int as variant, unnest([url, regexp_replace(url, '^https?:', 'ftp:'),
      regexp_replace(url, '^https?://', ''), regexp_replace(url, '(example[.][a-z]+)/', '\\1:99999/')]) as u from pages)
      select page_id, variant, ok as valid, ok and regexp_matches(u, '^https?:') as http, case when not ok then 'INVALID_URL' end as error_code
      from (select *, regexp_matches(u, '^[a-z]+://[^/?#:]+([/?#]|$)') as ok from v)""",
    "same_site": f"""with {A} select page_id, pos, true as same_origin, {IN_SITE} as same_site,
      ({directory()} = '' or {path('r')} = {directory()} or starts_with({path('r')}, {directory()} || '/')) as strict_site, true as in_root from a""",
    "normalize_url": f"""select page_id, {norm('url')} as norm_url, {norm('more')} as norm_more from (select *,
      regexp_replace(url, '#.*', '') || case when contains(url, '?') then '&' else '?' end || 'z=1&a=' || page_id || '&ref=0#x' as more from pages)""",
    "url_keys": f"select page_id, {path_id()} as path_id, {BASE} as base_url, {url_title()} as title from pages",
    "url_kinds": f"""select page_id, regexp_matches({path('u')}, '(?i)[.]({'|'.join(IMAGE_EXTENSIONS)})$') as image,
      not regexp_matches(lower({path('u')}), {lit(ASSETS)}) as content from (select page_id, {KIND_URL} as u from pages)""",
    "match_selectors": f"""select page_id, idx::int as selector_idx, n::bigint as n from (select page_id, unnest([0, 1, 2, 3, 5, 6]) as idx,
      unnest([{n_of('html', '<a ')}, {n_of('html', '<p>')}, 1, 1, {n_of('html', '<a ')}, 1]) as n from pages) where n > 0""",
    "nav_links": f"""with {A}, {first_links(f"{IS_PAGE} and txt <> ''")} select page_id, href, text, "order" from l""",
    "all_links": f"""with {A}, {first_links(f"{IS_PAGE} and {IN_SITE}")} select page_id, href, text, "order" from l""",
    "chapter_links": f"""with {A}, {first_links(f"{IS_PAGE} and txt <> ''")}, m as (select * replace (case when "order" = 0 then 'Home' when "order" = 1 then 'Terms ' || text else text end as text) from l)
      select page_id, href, text, "order" from m where length(text) >= 2 and not regexp_matches(text, {lit(BOILERPLATE.replace(chr(92) + 'z', '$'))})""",
    "site_profile": f"""select page_id, case when regexp_matches(u, '(?i)github[.]io|docsify') or contains(html, 'window.$docsify') or contains(html, 'docsify.min.js') or contains(html, 'docsify.js') or contains(html, 'data-docsify') then 'docsify'
      when regexp_matches(u, '(?i)gitbook') or contains(html, 'gitbook.js') or contains(html, 'gitbook.min.js') or contains(html, 'book-summary') or contains(html, 'GitBook') then 'gitbook'
      when regexp_matches(u, '(?i)jekyll|[.]github[.]io') or contains(html, 'jekyll') or contains(html, 'site.baseurl') or contains(html, '_site') then 'jekyll'
      when regexp_matches(u, '(?i)github[.]io|githubusercontent') then 'github-pages' else 'default' end as profile from (select page_id, html, {PROFILE_URL} as u from pages)""",
    "select_strategy": """select page_id, 'default' as profile, case when page_id % 4 = 0 then 'sidebar' when page_id % 3 = 0 then 'pagination' else 'auto' end as strategy from pages""",
    "find_next_link": f"""select page_id, case when page_id % 5 = 0 then {BASE} || 'two.html' else {site()} || {path()} || '?p=2' end as next_url
      from pages where page_id % 5 = 0 or page_id % 3 = 0""",
    "page_title": f"select page_id, {TITLE} as title from pages",
    "link_audit": f"""with {A}, f as (select *, {norm('r')} as h, {IN_SITE} as inside, {IS_PAGE} as page, {IN_SITE} and {IS_PAGE} and txt <> '' as ok from a),
      g as (select *, case when pos > min(case when ok then pos end) over (partition by page_id, h) then 'duplicate' when not inside then 'off_site' when not page then 'asset' when txt = '' then 'no_text' else 'page_links' end as why from f)
      select page_id, count(*) as matched, 0::bigint as no_href, 0::bigint as unresolvable, count(*) filter (where why = 'duplicate') as duplicate, count(*) filter (where why = 'off_site') as off_site,
      count(*) filter (where why = 'asset') as asset, count(*) filter (where why = 'no_text') as no_text, count(*) filter (where why = 'page_links') as page_links, count(*) filter (where why = 'page_links' and contains(href, '#')) as anchor_links from g group by page_id""",
    "canonical_pages": f"with {P}, {SORTED_SITE} select site, page_id, norm_url from canon",
    "next_chain": f"""with {P}, r as (select site, page_id, row_number() over w - 1 as k, coalesce(sum(case when page_id % 11 = 0 then 1 else 0 end) over
      (partition by site order by md5(url), page_id rows between unbounded preceding and 1 preceding), 0) as broken from p window w as (partition by site order by md5(url), page_id))
      select site, page_id, k::int as "order" from r where broken = 0""",
    "long_chain": """select 's' as site, doc_id as page_id, (row_number() over (order by md5(doc_id::varchar)) - 1)::int as "order" from documents""",
    "crawl_sidebar": f"""with {P}, o as (select *, row_number() over (partition by site order by page_id) - 1 as n from p),
      g as (select site || '#' || (n // 4) as site, page_id, url, n % 4 as k from o), r as (select *, min(page_id) over (partition by site, {norm('url')}) as target from g),
      f as (select site, target, min(k) as k from r where k <= 3 group by all)
      select site, target as page_id, (row_number() over (partition by site order by k) - 1)::int as "order" from f""",
    "crawl_sites": f"""with {A.replace('from pages)', 'from pages where page_id in (select min(page_id) from pages group by ' + site() + '))')}, {first_links(f"{IS_PAGE} and {IN_SITE}")},
      {P} select site, url, 'OK' as status from p where page_id in (select min(page_id) from p group by site)
      union all select site, href, 'CRAWL_FAILED' from l where length(text) >= 2 and not regexp_matches(text, {lit(BOILERPLATE.replace(chr(92) + 'z', '$'))})""",
    "remove_noise": f"select page_id, {squash(f'{TITLE} || {ARTICLE}')} as text_md5, {tags(f"'<html><head><meta><title><body><article>' || {ARTICLE}")} as tags_md5, 0 as noise_tags, 0 as comments from pages",
    "remove_empty_elements": f"select page_id, tag, count(*) as n from ({WITH_EXTRA}) where tag <> 'b' group by all union all {BOLD}",
    "strip_attributes": attr_counts(),
    "parse_pages": f"select page_id, {trim(decode(H1))} as title, {squash(ARTICLE)} as text_md5, {tags(CHOSEN)} as tags_md5, 0 as n_images, null::varchar as error_code from pages",
    "configured_pages": f"select page_id, {trim(decode(H1))} as title, {squash(ARTICLE)} as text_md5, 'png' as format from pages",
    "converted_tags": """select page_id, unnest(['n0', 'n1', 'n2', 'n3', 'n4', 'n5', 'n6']) as elem_id, unnest(['span', 'span', 'span', 'span', 'div', 'div', 'mark']) as tag,
      unnest(['class,id', 'class,id', 'class,id', 'class,id', 'class,id', 'class,id', 'class,foo,id']) as attributes from pages""",
    "extract_images": f"select page_id, unnest([0, 1])::int as pos, unnest([{IMG_A}, {IMG_B}]) as original_url, unnest(['seven', '']) as alt_text from pages",
    "clean_content": f"""select page_id, {squash("regexp_replace(" + got('html', '(?s)<body>(.*)') + ", '<article>', ' x<article>')")} as text_md5, ({n_of('html', '<a ')} + 1)::int as links, false as loose from pages""",
    "largest_text_block": f"select page_id, {trim(decode(H1))} as title, {squash(ARTICLE)} as text_md5 from pages",
    "fix_headings": """with h as (select page_id, unnest([0, 1, 2, 3]) as k, unnest([page_id % 6 + 1, length(html) % 6 + 1, length(url) % 6 + 1, page_id % 2 + 3]) as level, page_id % 6 as shift from pages),
      s as (select *, greatest(1, least(6, level - shift)) as moved from h),
      r as (select *, dense_rank() over (partition by page_id order by level) as a, dense_rank() over (partition by page_id order by moved) as b from s)
      select page_id, string_agg('h' || a, ',' order by k) as fixed, string_agg('h' || b, ',' order by k) as shifted from r group by page_id""",
    "first_heading": f"select page_id, {trim(decode(H1))} as heading from pages",
    "node_table": f"select page_id, {trim(decode(H1))} as heading, {n_of('html', '<a ')}::bigint as links from pages",
    "link_dispositions": f"""with {A} select page_id, href, case when {IN_SITE} then 'resolve' else 'text' end as disposition, case when {IN_SITE} then r end as resolved from a
      union all select page_id, unnest(['#x', 'mailto:m', 'https://other.example/']), unnest(['keep', 'text', 'text']), null from pages""",
    "normalize_pages": f"""with {A} select page_id, (count(r) filter (where {IN_SITE}))::int as links, (count(r) filter (where not {IN_SITE}))::int as spans, 1 as attributes
      from (select page_id from pages) left join a using (page_id) group by page_id""",
    "strip_links": f"select page_id, 0 as links, ({n_of('html', '<a ')})::int as spans from pages",
    "remove_images": f"select page_id, unnest(['figure', 'p']) as tag, unnest([1, {n_of('html', '<p>')} + 1])::bigint as n from pages",
    "image_urls": f"with {REFS} select distinct page_id, u as image_url from abs",
    "image_catalog": f"with {CAT} select * from cat",
    "resolve_image_urls": f"""select page_id, unnest([1, 2, 3, 4])::int as n, unnest([{site()} || {IMG_A}, {BASE} || {IMG_B}, 'data:image/png;base64,AA', {site()} || {IMG_A}]) as src,
      unnest([null, {BASE} || 'a.jpg 1x, ' || {site()} || '/b.jpg 2x', null, null]) as srcset from pages""",
    "update_image_refs": f"""select page_id, unnest(['images/img-' || substring(md5({site()} || {IMG_A}), 1, 12) || '.jpg', {IMG_B}, 'data:image/png;base64,AA']) as src, unnest([2, 1, 1])::bigint as n from pages""",
    "match_images": f"""with {CAT}, q as (select distinct site, original_url as url from refs union select site, 'x/' || filename from cat union select site, u from abs),
      m as (select q.site, q.url, cat.image_id, cat.url as image_url, case when cat.url = q.url then 1 when cat.filename = regexp_extract(q.url, '([^/]*)$', 1) then 2 when ends_with(cat.url, q.url) or ends_with(q.url, cat.url) then 3 end as tier
        from q left join cat on cat.site = q.site),
      b as (select *, row_number() over (partition by site, url order by tier nulls last, image_url) as k from m)
      select site, url, case when tier is not null then image_id end as image_id, tier::int as tier from b where k = 1""",
    "minify_html": f"select page_id, md5({trim(sub(sub('html', f'>{WS}+<', '><'), f'{WS}+', ' '))}) as html_md5 from pages",
    "sanitize_title": f"select 'page' as kind, page_id as id, {sanitized(TITLE)} as title from pages union all select 'doc', doc_id, {sanitized('text')} from documents",
    "dedupe_titles": f"with {CHAPTERS} select site, page_id, title from c",
    "dedupe_titles_language": f"with {titled(LANG)} select site, page_id, title from c",
    "create_chapters": f"""with {CHAPTERS} select site, page_id, id, title, md5(content) as content_md5, "order", source_url from ch""",
    "duplicate_chapter_ids": f"with {titled(LANG)} select site, id, count(*) as uses from ch group by all having count(*) > 1",
    "filter_valid_chapters": f"""select conv_id::varchar as site, turn as page_id, length({wrapped('text', 'role')})::int as size from conversations
      where length({trim(sub(wrapped('text', 'role'), '<[^>]+>'))}) >= 50""",
    "sort_by_order": f"""with {P} select site, page_id, page_id::int as "order", (row_number() over (order by site, page_id))::int as place from p""",
    "normalize_order": """select o_custkey::varchar as site, o_orderkey as page_id, (row_number() over (partition by o_custkey order by
      case when o_custkey % 2 = 0 then o_orderkey % 3 else o_orderkey end, o_orderkey) - 1)::int as "order" from orders""",
    "resolve_duplicate_orders": """with l as (select o_custkey::varchar as site, o_orderkey as page_id, lpad((o_orderkey * 7919 % 1009)::varchar, 9, '0') as title,
        (case when o_custkey % 2 = 0 then o_orderkey % 3 else o_orderkey end)::int as o from orders),
      d as (select *, count(*) over (partition by site, o) as same from l), e as (select *, max(same) over (partition by site) as most from d)
      select site, page_id, (case when most > 1 then row_number() over (partition by site order by o, title, page_id) - 1 else o end)::int as "order" from e""",
    "resolve_duplicate_orders_sliced": """select o_orderstatus as site, o_orderkey as page_id, (row_number() over (partition by o_orderstatus
      order by o_orderkey % 100, lpad((o_orderkey * 7919 % 1009)::varchar, 9, '0'), o_orderkey) - 1)::int as "order" from orders""",
    "move_chapter": f"""with {turns('role')}, p as (select site, page_id, row_number() over (partition by site order by "order") - 1 as k, count(*) over (partition by site) as n from t)
      select site, page_id, k::int as "order", (row_number() over (partition by site order by case when k = 3 then 0.5 else k end) - 1)::int as moved from p""",
    "order_anomalies": f"""with {turns(NUMBERED)}, n as (select *, cast(nullif({got('title', f'(?i)chapter{WS}+([0-9]+)')}, '') as double) as no from t),
      b as (select *, lag(no) over (partition by site order by "order") as before from n where no is not null)
      select site, "order", 'Chapter "' || title || '" (order ' || "order" || ') appears after a higher-numbered chapter' as message from b where no < before""",
    "group_by_section": f"""with {turns(PARTED)}, h as (select *, case when regexp_matches(title, '(?i)^(part|section|book){WS}+[ivx0-9]+') then title end as head from t)
      select site, "order", coalesce(last_value(head ignore nulls) over (partition by site order by "order" rows between unbounded preceding and current row), 'Main') as section from h""",
    "section_sizes": f"""with {turns(PARTED)}, h as (select *, case when regexp_matches(title, '(?i)^(part|section|book){WS}+[ivx0-9]+') then title end as head from t),
      s as (select site, "order", coalesce(last_value(head ignore nulls) over (partition by site order by "order" rows between unbounded preceding and current row), 'Main') as section from h)
      select site, section, count(*) as chapters, min("order") as first_order from s group by all""",
    "build_chapters": f"""with {CHAPTERS} select site, page_id, id, title, (row_number() over (partition by site order by page_id) - 1)::int as "order" from ch
      where length({trim(sub('content', '<[^>]+>'))}) >= 50""",
    "chapters_to_content": f"""with {CHAPTERS} select site, "order" as seq, id || '.xhtml' as filename, title, md5(content) as data_md5, false as exclude_from_toc, false as before_toc from ch""",
    "flat_toc": f"""with {CHAPTERS} select site, id, title, "order", 0 as level from ch""",
    "toc_level": f"""with {turns(LEVELLED)} select site, "order", {LEVEL} as level from t""",
    "hierarchical_toc": f"""with recursive {TOC} select pr.*, tree.depth from pr join tree using (site, id)""",
    "flatten_toc": f"""with {turns(LEVELLED)} select site, id, (row_number() over (partition by site order by "order") - 1)::int as seq from t""",
    "toc_html": f"""with recursive {TOC}, d as (select pr.site, pr.id, pr."order", tree.depth, t.title from pr join tree using (site, id) join t using (site, id)),
      n as (select *, lead(depth) over (partition by site order by "order") as nx, row_number() over (partition by site order by "order") as k, count(*) over (partition by site) as cnt from d),
      ln as (select site, k, case when k > 1 then chr(10) else '' end || case when nx > depth
          then repeat('  ', depth) || '<li>' || chr(10) || repeat('  ', depth) || '  <a href="' || id || '.xhtml">' || {escaped('title')} || '</a>' || chr(10) || repeat('  ', depth) || '  <ol>'
          else repeat('  ', depth) || '<li><a href="' || id || '.xhtml">' || {escaped('title')} || '</a></li>' end
        || coalesce(list_aggregate(list_transform(range(depth - 1, coalesce(nx, 0) - 1, -1), lambda d: chr(10) || repeat('  ', d) || '  </ol>' || chr(10) || repeat('  ', d) || '</li>'), 'string_agg', ''), '') as data from n)
      select site, k::int as part, md5(data) as data_md5 from ln
      union all select distinct site, 0, md5({lit(TOC_HEAD.replace('{title}', 'Table of Contents'))}) from n
      union all select distinct site, (cnt + 1)::int, md5({lit(TOC_TAIL)}) from n""",
    "toc_content": f"""with {turns('role')}, n as (select *, row_number() over (partition by site order by "order") as k, count(*) over (partition by site) as cnt from t),
      e as (select site, k::int as part, case when k > 1 then chr(10) else '' end || '<li><a href="' || id || '.xhtml">' || {escaped('title')} || '</a></li>' as data from n
        union all select distinct site, 0, {lit(TOC_HEAD.replace('{title}', 'Table of Contents'))} from n
        union all select distinct site, (cnt + 1)::int, {lit(TOC_TAIL)} from n)
      select site, 'toc.xhtml' as filename, part, 'Table of Contents' as title, md5(data) as data_md5, true as exclude_from_toc, true as before_toc from e""",
    "infer_metadata": f"""with {CHAPTERS} select site, {got('site', '^https?://(?:www[.])?(.*)')} as publisher, description from {DESCRIPTION}""",
    "infer_publisher": f"""select page_id, case page_id % 4 when 1 then {got('url', '^https?://(?:www[.])?([^/]*)[.]example')} when 2 then {got('url', '^https?://([^/]*)')} when 3 then 'Read the Docs' else {got('url', '^https?://(?:www[.])?([^/]*)')} end as publisher from pages""",
    "create_books": f"""with {CHAPTERS} select site, min_by(title, page_id) as title, 'Unknown' as author, 'en' as language from ch group by site""",
    "enrich_metadata": f"""with {CHAPTERS}, f as (select site, min_by(source_url, page_id) as url from ch group by site)
      select f.site, {url_title()} as title, {got('f.site', '^https?://(?:www[.])?(.*)')} as publisher, description from f join {DESCRIPTION} as x on x.site = f.site""",
    "sanitize_metadata": f"select doc_id, md5({metadata('text')}) as text_md5 from documents",
    "book_options": f"""with {CHAPTERS}, b as (select site, min_by(title, page_id) as t from ch group by site) select site, coalesce({metadata('t')}, 'Untitled Book') as title, 'A. Writer' as author, 'en' as lang,
      'Table of Contents' as toc_title, 'urn:uuid:' || {slug("t || '-A. Writer'")} as identifier, '2024-01-01' as date from b""",
    "output_filename": f"select doc_id, coalesce(nullif({slug('text')}, ''), 'book') || '.epub' as filename from documents",
    "validate_books": f"""with {CHAPTERS} select distinct site, 'Book must have at least one chapter' as message, 'EPUB_GENERATION_FAILED' as error_code from ch where length(site) % 5 = 0
      union all select site, 'Chapter "' || title || '" has no content', 'EPUB_GENERATION_FAILED' from ch where length(site) % 5 <> 0 and page_id % 7 = 0""",
    "build_report": f"""with {CHAPTERS}, r as (select site, count(*) as chapters_count, sum(octet_length(encode(content)))::bigint as total_size from ch group by site)
      select site, chapters_count, 0::bigint as images_count, total_size, case when total_size < 1024 then total_size || ' B' when total_size < 1048576 then printf('%.1f KB', floor(total_size / 1024.0 * 10 + 0.5) / 10)
      else printf('%.1f MB', floor(total_size / 1048576.0 * 10 + 0.5) / 10) end as size_text from r""",
    "split_errors": "select page_id, case when page_id % 10 = 0 then 'NO_CONTENT_FOUND' else 'OK' end as status from pages",
    "book_corpus": f"""with {BOOK} select canon.site, {metadata(f'min_by({TITLE}, canon.page_id)')} as title, {got('canon.site', '^https?://(?:www[.])?(.*)')} as publisher,
      any_value(n) as chapters_count, 0::bigint as images_count from canon join (select site, count(*) as n from kept group by site) as k on k.site = canon.site group by canon.site""",
    "corpus_ledger": f"""with {LEDGER} select p.page_id, case when c.page_id is null then 'DUPLICATE_PAGE' when p.page_id % 10 = 3 then 'NO_CONTENT_FOUND'
      when k.page_id is null then 'CHAPTER_TOO_SHORT' else 'CHAPTER' end as status
      from p left join (select page_id from canon) c using (page_id) left join (select page_id from kept) k using (page_id)""",
    "book_chapters": f"""with {BOOK} select site, page_id, id, title, (row_number() over (partition by site order by page_id) - 1)::int as "order" from kept""",
}
ORACLES["incremental_corpus"] = ORACLES["book_corpus"]
