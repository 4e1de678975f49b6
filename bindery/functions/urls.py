"""URL functions as column expressions (WHATWG rules for the special schemes).

``canonical_url`` does the parsing work once; every other function takes either
a raw string, which it canonicalises first, or with ``canonical=True`` a string
which already went through it, as hrefs in link tables have.

Limits: host names are lower-cased but not converted to punycode, and numeric
IPv4 spellings are not folded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.sqltext import bind, let, q, q_list
from bindery.functions.strings import JS_SPACE

SPECIAL = ("http", "https", "ws", "wss", "ftp", "file")
DEFAULT_PORT = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

# Extensions and path parts of resources which are not pages.
ASSET_EXTENSIONS = (
    "css js json xml rss atom txt pdf zip tar gz mp3 mp4 wav avi jpg jpeg png gif webp svg bmp ico "
    "woff woff2 ttf eot"
).split()
ASSET_PATHS = (
    "/api/ /admin/ /wp-admin/ /wp-includes/ /assets/ /static/ /fonts/ /images/ /img/ /css/ /js/"
).split()
IMAGE_EXTENSIONS = "jpg jpeg png gif webp svg bmp ico".split()

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# scheme, user info, host, port, path, query, fragment of a URL with a special scheme
_SPECIAL = (
    rf"(?is)^({'|'.join(SPECIAL)}):[/\\]*(?:([^/\\?#]*)@)?(\[[^\]/\\?#]*\]|[^:/\\?#@]*)(?::([0-9]*))?"
    r"([/\\][^?#]*)?(\?[^#]*)?(#.*)?\z"
)
# scheme with colon, authority with slashes, path, query of a canonical URL
_CANONICAL = r"(?s)^([a-z][a-z0-9+.\-]*:)(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?\z"
_STEM = r"[a-z][a-z0-9+.\-]*:(?://[^/?#]*+)?+"
_UNSAFE = r"[^!-~]|[\\\"<>`{}]|(?i:/(\.|%2e){1,2}(/|\z))"
# origin and base directory: "origin/" at the root, else without the last slash
_SITE_PREFIX = (
    r"^((?:https?|wss?|ftp)://[^/?#]*/(?=[^/?#]*(?:[?#]|\z))"
    r"|(?:https?|wss?|ftp)://[^/?#]*/[^?#]*(?=/[^/?#]*(?:[?#]|\z)))"
)
_SEP = "\x01"
_BACKSLASH = "\\"
_Z = r"\z"  # end of input, also after a line break
_END_COLON = r":\z"


def _groups(x: str, pattern: str, n: int) -> str:
    """All groups of a whole-string match from one pass; any other string stays one element."""
    joined = _SEP.join(f"${i}" for i in range(1, n + 1))
    return f"split(regexp_replace({x}, {q(pattern)}, {q(joined)}), {q(_SEP)})"


def _encode(x: str, extra: str) -> str:
    """Percent-encode everything outside printable ASCII, and ``extra``."""
    bad = q(f"[^!-~]|[{extra}]")
    char = f"case when ch = ' ' then '%20' when ch rlike {bad} then url_encode(ch) else ch end"
    return f"case when {x} rlike {bad} then array_join(transform(split({x}, ''), ch -> {char}), '') else {x} end"


def _remove_dots(path: str) -> str:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    dot, dots, either = (q(rf"(?i)^(\.|%2e){{{n}}}\z") for n in ("1", "2", "1,2"))
    step = (
        f"case when s rlike {dots} then slice(acc, 1, greatest(size(acc) - 1, 0)) "
        f"when s rlike {dot} then acc else concat(acc, array(s)) end"
    )
    kept = f"aggregate(segs, cast(array() as array<string>), (acc, s) -> {step})"
    # a dot segment at the end leaves its directory, with a slash
    tail = f"if(element_at(segs, -1) rlike {either}, array(''), cast(array() as array<string>))"
    return let(f"split(substring({path}, 2), '/')", "segs", f"concat('/', array_join(concat({kept}, {tail}), '/'))")


def _clean_path(path: str) -> str:
    bare = let(f"replace({path}, {q(_BACKSLASH)}, '/')", "pa", let(_remove_dots("pa"), "pb", _encode("pb", '"<>`{}')))
    return f"case when {path} = '' then '/' when {path} rlike {q(_UNSAFE)} then {bare} else {path} end"


def _special(p: str) -> str:
    scheme, user, host, port, path, query, fragment = (f"get({p}, {i})" for i in range(7))
    number = f"regexp_replace({port}, '^0+(?=[0-9])', '')"
    default = f"concat(lower({scheme}), ':', {number}) in ({q_list(f'{k}:{v}' for k, v in DEFAULT_PORT.items())})"
    bad_host = q(r"[\x00-\x20<>^`{|}%\x7F]|^[^\[].*[\[\]]")
    valid = (
        f"size({p}) = 7 and not {host} rlike {bad_host} and ({host} <> '' or lower({scheme}) = 'file') "
        f"and coalesce(try_cast({port} as bigint), 0) <= 65535"
    )
    return (
        f"case when {valid} then concat(lower({scheme}), '://', "
        f"if({user} in ('', ':'), '', concat(regexp_replace({user}, {q(_END_COLON)}, ''), '@')), "
        f"lower({host}), if({port} = '' or {default}, '', concat(':', {number})), {_clean_path(path)}, "
        f"{let(query, 'qy', _encode('qy', _QUERY_SET))}, {let(fragment, 'fr', _encode('fr', _FRAGMENT_SET))}) end"
    )


_QUERY_SET = "\"<>'"
_FRAGMENT_SET = '"<>`'
_ENDS = "".join(map(chr, range(0x21)))


def _canonical(x: str) -> str:
    """Canonical form of an absolute URL given as an SQL expression."""
    scheme = q(_SCHEME)
    rest = let(f"regexp_replace(u, {scheme}, '')", "re", _encode("re", "\x7f"))
    special = let(_groups("u", _SPECIAL, 7), "p", _special("p"))
    return let(
        f"translate(btrim({x}, {q(_ENDS)}), {q(chr(9) + chr(10) + chr(13))}, '')",
        "u",
        f"case when u rlike {q('^(?i:' + '|'.join(SPECIAL) + '):')} then {special} "
        f"when u rlike {scheme} then concat(lower(regexp_extract(u, {scheme}, 1)), ':', {rest}) end",
    )


def canonical_url(c: Column) -> Column:
    """The ``href`` an absolute URL string parses to, or null when it is invalid."""
    return bind(c, "x", _canonical("x"))


def _on_canonical(c: Column, canonical: bool, body: str) -> Column:
    """``body`` over ``k``, the canonical form of ``c``."""
    return bind(c, "k", body) if canonical else bind(c, "x", let(_canonical("x"), "k", body))


def _path(k: str) -> str:
    return f"regexp_extract({k}, {q(_CANONICAL)}, 3)"


def _host(k: str) -> str:
    """Host name without user info and port."""
    return f"regexp_replace(regexp_extract({k}, {q(_CANONICAL)}, 2), {q(r'^//(?:.*@)?|:[0-9]+' + _Z)}, '')"


def url_host(c: Column, canonical: bool = False) -> Column:
    return _on_canonical(c, canonical, _host("k"))


def _origin(k: str) -> str:
    whole = f"regexp_extract({k}, '^(?:https?|wss?|ftp)://[^/?#]*', 0)"
    return let(whole, "o", f"case when o <> '' then regexp_replace(o, '//.*@', '//') when {k} is not null then 'null' end")


def url_origin(c: Column, canonical: bool = False) -> Column:
    """Scheme, host and port; the text ``null`` for schemes without an origin."""
    return _on_canonical(c, canonical, _origin("k"))


def _resolve(base: str) -> str:
    """Body over ``h`` (trimmed href) and ``bs`` (base as given) with ``base`` canonical."""
    scheme, host, path, query = (f"get(b, {i})" for i in range(4))
    raw = (
        f"case when r rlike {q(_SCHEME)} then r "
        f"when r = '' then concat({scheme}, {host}, {path}, {query}) "
        rf"when r rlike {q(r'^[/\\]{2}')} then concat({scheme}, r) "
        rf"when r rlike {q(r'^[/\\]')} then concat({scheme}, {host}, r) "
        f"when startswith(r, '?') then concat({scheme}, {host}, {path}, r) "
        f"when startswith(r, '#') then concat({scheme}, {host}, {path}, {query}, r) "
        f"else concat({scheme}, {host}, regexp_replace({path}, {q(r'[^/]*' + _Z)}, ''), r) end"
    )
    # "http:x" below an http base is a relative reference
    relative = (
        f"h rlike {q(r'(?i)^(https?|wss?|ftp):(?![/' + _BACKSLASH * 2 + ']{2})')} and startswith(lower(h), {scheme})"
    )
    reference = f"case when {relative} then regexp_replace(h, {q(_SCHEME)}, '') else h end"
    full = let(_groups(base, _CANONICAL, 4), "b", let(reference, "r", let(raw, "w", _canonical("w"))))
    return (
        f"case when h = '' then bs when h rlike '(?i)^((javascript|mailto|tel|data|#):|#)' then '' "
        f"else coalesce({full}, '') end"
    )


def resolve_sql(href: str, base: str, base_canonical: bool = False) -> str:
    known = "bs" if base_canonical else _canonical("bs")
    inner = let(known, "bk", _resolve("bk"))
    return let(base, "bs", let(f"btrim(coalesce({href}, ''), {q(JS_SPACE)})", "h", inner))


def resolve_url(href: Column, base: Column, base_canonical: bool = False) -> Column:
    """``href`` made absolute against ``base``; empty where there is nothing to follow."""
    pair = F.struct(href.alias("href"), base.alias("base"))
    return bind(pair, "pr", resolve_sql("pr.href", "pr.base", base_canonical))


def is_valid_url(c: Column) -> Column:
    return canonical_url(F.coalesce(c, F.lit(""))).isNotNull()


def url_error(c: Column) -> Column:
    """``INVALID_URL`` for strings which do not parse, else null."""
    return F.when(~is_valid_url(c), F.lit("INVALID_URL"))


def http_url(c: Column) -> Column:
    """Canonical href of an http(s) URL, else null."""
    return _on_canonical(c, False, "case when k rlike '^https?:' then k end")


def is_http_url(c: Column) -> Column:
    return http_url(F.coalesce(c, F.lit(""))).isNotNull()


def is_same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(url_origin(a) == url_origin(b), F.lit(False))


def _directory(k: str) -> str:
    """Directory part of a canonical URL's path, without the last slash."""
    return f"regexp_replace({_path(k)}, {q(r'/?[^/]*' + _Z)}, '')"


def _bare(k: str) -> str:
    """A canonical URL without user info."""
    return f"case when contains({k}, '@') then regexp_replace({k}, '^([a-z]+://)[^/?#]*@', '$1') else {k} end"


def same_site_sql(u: str, base: str, strict: bool = False) -> str:
    """Both canonical; see ``is_same_site``."""
    inside = "sp <> '' and startswith(ub, sp)"
    if strict:
        rest = f"regexp_replace(ub, {q('[?#].*' + _Z)}, '')"
        inside += f" and (endswith(sp, '/') or substring({rest}, length(sp) + 1, 1) in ('', '/'))"
    prefix = f"regexp_extract({_bare(base)}, {q(_SITE_PREFIX)}, 1)"
    return f"coalesce({let(_bare(u), 'ub', let(prefix, 'sp', inside))}, false)"


def is_same_site(url: Column, base: Column, strict: bool = False) -> Column:
    """Same origin and below the base directory.

    The prefix test has no slash boundary (``/enau`` is inside ``/en``); ``strict``
    asks for one.
    """
    pair = F.struct(url.alias("u"), base.alias("b"))
    return bind(pair, "pr", let(_canonical("pr.u"), "ku", let(_canonical("pr.b"), "kb", same_site_sql("ku", "kb", strict))))


def _form_decode(x: str) -> str:
    """Percent-decode with stray percent signs kept, as form parsing does."""
    return f"url_decode(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"


def _sorted_query(query: str) -> str:
    """``?…`` with parameters in stable name order and form-encoded again."""
    name = _form_decode("regexp_extract(e, '(?s)^([^=]*)', 1)")
    value = _form_decode(f"regexp_extract(e, {q(r'(?s)^[^=]*=?(.*)' + _Z)}, 1)")
    entry = f"{let(name, 'nm', f'struct(nm as n, i as i, concat(url_encode(nm), {q(chr(61))}, url_encode({value})) as t)')}"
    pairs = f"transform(filter(split(substring({query}, 2), '&'), f -> f <> ''), (e, i) -> {entry})"
    return let(
        f"transform(array_sort({pairs}), s -> s.t)", "j", "case when size(j) = 0 then '' else concat('?', array_join(j, '&')) end"
    )


def normalize_sql(k: str) -> str:
    """Body of ``normalize_url`` over a canonical URL."""
    stem = f"regexp_replace(regexp_extract({k}, '(?s)^([^?#]*)', 1), {q(f'(?s)^({_STEM}.+)/' + _Z)}, '$1')"
    query = f"regexp_extract({k}, {q('(?s)^[^?#]*(' + _BACKSLASH + '?[^#]*)')}, 1)"
    with_query = f"concat(st, {let(query, 'qs', _sorted_query('qs'))})"
    return let(stem, "st", f"case when contains({k}, '?') then {with_query} else st end")


def normalize_url(c: Column) -> Column:
    """Key under which two spellings of a page count as one; invalid text stays."""
    return F.coalesce(_on_canonical(c, False, normalize_sql("k")), c)


def path_id(c: Column) -> Column:
    """Dash-separated id from the last path segment."""
    last = f"coalesce(nullif(regexp_extract({_path('k')}, {q('([^/]+)/*' + _Z)}, 1), ''), 'index')"
    name = f"lower(regexp_replace({last}, {q(r'(?i)[.](html?|md|php|asp)' + _Z)}, ''))"
    name = f"regexp_replace(regexp_replace({name}, '[^a-z0-9-]', '-'), '-+', '-')"
    body = f"case when k is not null then regexp_replace({name}, {q('^-|-' + _Z)}, '') end"
    return F.coalesce(_on_canonical(F.coalesce(c, F.lit("")), False, body), F.lit("page"))


def base_url(c: Column) -> Column:
    """Origin and directory of a URL, ending in a slash; invalid text stays."""
    body = f"concat(regexp_extract(k, {q(f'^({_STEM})')}, 1), {_directory('k')}, '/')"
    return F.coalesce(_on_canonical(c, False, body), c)


def is_image_url(c: Column) -> Column:
    pattern = q(rf"(?i)\.({'|'.join(IMAGE_EXTENSIONS)})\z")
    return bind(c, "x", let(_canonical("x"), "k", f"coalesce({_path('k')}, x) rlike {pattern}"))


def content_sql(k: str) -> str:
    """Body of ``is_content_url`` over a canonical URL."""
    pattern = q(rf"\.({'|'.join(ASSET_EXTENSIONS)})\z|{'|'.join(ASSET_PATHS)}")
    return f"coalesce(not lower({_path(k)}) rlike {pattern}, false)"


def is_content_url(c: Column) -> Column:
    """False for static assets and for paths which never hold pages."""
    return _on_canonical(c, False, content_sql("k"))


def title_from_url(c: Column, fallback: str = "Untitled") -> Column:
    """Title guessed from the last path part without a dot, else the host's first label."""
    words = "regexp_replace(element_at(ps, -1), '[-_]', ' ')"
    # upper-case each ASCII word character after a non-word character
    marked = f"split(regexp_replace({words}, '(^|[^A-Za-z0-9_])([A-Za-z0-9_])', {q('$1' + _SEP + '$2')}), {q(_SEP)})"
    titled = f"array_join(transform({marked}, (s, i) -> if(i > 0, concat(upper(substring(s, 1, 1)), substring(s, 2)), s)), '')"
    label = f"regexp_extract({_host('k')}, {q(r'^(?:www[.])?([^.]*)')}, 1)"
    parts = f"filter(split({_path('k')}, '/'), p -> p <> '' and not contains(p, '.'))"
    body = let(parts, "ps", f"case when size(ps) > 0 then {titled} else coalesce(nullif({label}, ''), {q(fallback)}) end")
    return F.coalesce(_on_canonical(c, False, f"case when k is not null then {body} end"), F.lit(fallback))
