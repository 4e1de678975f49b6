"""Shred page HTML into the node table.

One row per element, text, comment or doctype. ``pos`` and ``end_pos`` number the
open and close events of a page from one counter, so "inside element e" is
``pos > e.pos AND pos < e.end_pos`` and intervals are either nested or disjoint.
``ancestors`` lists the open elements around a row, outermost first, as text which
regular expressions can search: for each ``LEVEL``, its ``pos``, ``PART``, its tag and
``PART``, then ``#id``, ``.class`` and ``[name=value`` with a ``PART`` after each. So
selectors are tests of one row. It tells the page as it was shredded, whatever later
steps do to tags and attributes, and up to ``MAX_LEVELS`` elements.
Tree building follows the HTML rules for implied tags, void and raw-text
elements, table rows and unclosed formatting elements. Not covered: moving
misplaced content out of tables and re-parenting around mis-nested blocks.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# tasks get the shredder with the job, so workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ("site", "page_id")

NODE_SCHEMA = (
    "pos int, end_pos int, depth int, kind string, tag string, attrs map<string,string>, "
    "elem_id string, classes array<string>, text string, ancestors string"
)
_ARROW = {
    "pos": pa.int32(),
    "end_pos": pa.int32(),
    "depth": pa.int32(),
    "kind": pa.string(),
    "tag": pa.string(),
    "attrs": pa.map_(pa.string(), pa.string()),
    "elem_id": pa.string(),
    "classes": pa.list_(pa.string()),
    "text": pa.string(),
    "ancestors": pa.string(),
}
LEVEL, PART = "\x1e", "\x1f"
MAX_LEVELS = 512

# Element groups of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript".split())
RCDATA = {"title", "textarea"}
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p pre search section summary "
    "table ul xmp".split()
)
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPE = set("applet caption html table td th marquee object template".split())
MARKERS = set("applet caption marquee object td th template".split())
# start tag -> open elements it ends, and the elements that search stops at
ENDS = {
    "li": ({"li"}, {"ul", "ol"} | SCOPE),
    "dd": ({"dd", "dt"}, {"dl"} | SCOPE),
    "dt": ({"dd", "dt"}, {"dl"} | SCOPE),
    "option": ({"option"}, {"select", "datalist"} | SCOPE),
    "optgroup": ({"optgroup", "option"}, {"select"} | SCOPE),
    "tr": ({"tr"}, {"table", "template", "html"}),
    "td": ({"td", "th"}, {"table", "tr", "template", "html"}),
    "th": ({"td", "th"}, {"table", "tr", "template", "html"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table", "template", "html"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table", "template", "html"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table", "template", "html"}),
    "button": ({"button"}, SCOPE),
    "a": ({"a"}, SCOPE),
}
IMPLIED_PARENT = {"tr": ({"table"}, "tbody"), "td": ({"table", "tbody", "thead", "tfoot"}, "tr"), "col": ({"table"}, "colgroup")}
IMPLIED_PARENT["th"] = IMPLIED_PARENT["td"]

_TAG = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<!(?P<decl>[^>]*)>|<(?P<pi>[?/](?![a-zA-Z])[^>]*)>"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]*+[^\s/>][^\s/>=]*+"
    r"(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+)*+)[\s/]*+>",
    re.S,
)
_ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_REF = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)=?")


def _attr_ref(m: re.Match) -> str:
    ref = m.group()
    if ref.endswith("="):
        return ref if not ref.startswith("&#") else entities.unescape(ref)
    known = ref.startswith("&#") or ref[1:] in entities.entities.html5
    return entities.unescape(ref) if known else ref


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(source):
        value = values[0] or values[1] or values[2]
        out.setdefault(name.lower(), _REF.sub(_attr_ref, value) if "&" in value else value)
    return out


class _Page:
    """Rows of one page while its tags are read."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.open: list[int] = []  # row numbers of open elements
        self.tags: list[str] = []  # their tags
        self.active: list = []  # formatting elements to re-open: (tag, attrs, row) or None as a marker
        self.clock = 0
        self.head = False  # has head content begun?
        self.body = False

    def _row(self, kind, tag, attrs, text) -> int:
        ident = attrs.get("id") if attrs else None
        classes = attrs.get("class", "").split() if attrs else []
        self.rows.append([self.clock, self.clock, len(self.open), kind, tag, attrs, ident, classes, text])
        self.clock += 1
        return len(self.rows) - 1

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        row = self._row("element", tag, attrs, None)
        if tag in VOID:
            return
        self.open.append(row)
        self.tags.append(tag)
        if tag in FORMATTING:
            since = self.active[::-1].index(None) if None in self.active else len(self.active)
            same = [e for e in self.active[len(self.active) - since :] if e[0] == tag and e[1] == attrs]
            if len(same) == 3:
                self.active.remove(same[0])
            self.active.append((tag, attrs, row))
        elif tag in MARKERS:
            self.active.append(None)

    def pop(self) -> None:
        row, tag = self.open.pop(), self.tags.pop()
        self.rows[row][1] = self.clock
        self.clock += 1
        if tag in MARKERS:
            while self.active and self.active.pop() is not None:
                pass

    def pop_to(self, index: int) -> None:
        while len(self.open) > index:
            self.pop()

    def find(self, tags: set[str], stop: set[str]) -> int:
        """Index of the innermost open element among ``tags``, -1 beyond ``stop``."""
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i] in tags:
                return i
            if self.tags[i] in stop:
                return -1
        return -1

    def end_here(self, tags: set[str], stop: set[str]) -> None:
        i = self.find(tags, stop)
        if i >= 0:
            self.pop_to(i)

    def forget(self, tag: str) -> None:
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None:
                return
            if self.active[i][0] == tag:
                del self.active[i]
                return

    def reopen(self) -> None:
        """Open again the formatting elements which an implied end tag cut off."""
        i = len(self.active)
        while i and self.active[i - 1] is not None and self.active[i - 1][2] not in self.open:
            i -= 1
        lost, self.active[i:] = self.active[i:], []
        for tag, attrs, _ in lost:
            self.push(tag, attrs)

    def start_body(self) -> None:
        if not self.body:
            self.body = True
            self.pop_to(1)
            self.push("body", {})

    def text(self, data: str, kind: str = "text") -> None:
        if not self.body and self.tags[-1] not in RAW | RCDATA:
            rest = data.lstrip("\t\n\f\r ")
            if not rest:
                if self.head:
                    self._append(data, kind)
                return
            data = rest
            self.start_body()
        if data.strip("\t\n\f\r "):
            self.reopen()
        self._append(data, kind)

    def _append(self, data: str, kind: str) -> None:
        last = self.rows[-1]
        if last[3] == kind and last[0] == self.clock - 1 and last[2] == len(self.open):
            last[8] += data
        else:
            self._row(kind, None, None, data)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self.start_body()
            row = self.rows[self.open[0 if tag == "html" else 1]]
            for name, value in attrs.items():
                row[5].setdefault(name, value)
            row[6], row[7] = row[5].get("id"), row[5].get("class", "").split()
            return
        if tag == "head":
            self.head = True
            return
        if not self.body:
            if tag in HEAD:
                self.head = True
                self.push(tag, attrs)
                return
            self.start_body()
        if tag in CLOSES_P:
            self.end_here({"p"}, SCOPE | {"button"})
        if tag in HEADINGS and self.tags[-1] in HEADINGS:
            self.pop()
        if tag in ENDS:
            self.end_here(*ENDS[tag])
        if tag == "a":
            self.forget("a")
        if tag in ("td", "th") or tag == "tr":
            self.end_here({"caption", "colgroup"}, {"table", "template", "html"})
            if tag != "tr" and self.tags[-1] in IMPLIED_PARENT["tr"][0]:
                self.push("tbody", {})
        if tag in IMPLIED_PARENT and self.tags[-1] in IMPLIED_PARENT[tag][0]:
            self.push(IMPLIED_PARENT[tag][1], {})
        if tag not in CLOSES_P and tag not in ENDS or tag in ("a", "button"):
            if self.tags[-1] not in ("table", "tbody", "thead", "tfoot", "tr", "colgroup", "select"):
                self.reopen()
        self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag == "br":
            self.start("br", {})
        elif tag == "p" and self.find({"p"}, SCOPE | {"button"}) < 0:
            self.start_body()
            self.start("p", {})
            self.pop()
        elif tag in FORMATTING:
            self.end_here({tag}, SCOPE)
            self.forget(tag)
        elif tag in HEADINGS:
            self.end_here(HEADINGS, SCOPE)
        elif tag in ("table", "tr", "tbody", "thead", "tfoot", "caption", "td", "th"):
            self.end_here({tag}, {"html", "template"} if tag == "table" else {"table", "html", "template"})
        else:
            floor = 2 if self.body else 1
            i = self.find({tag}, SCOPE)
            if i >= floor:
                self.pop_to(i)


def shred_html(source: str) -> list[list]:
    """Node rows of one page, in document order."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    page, at, size = _Page(), 0, len(source)
    doctype = re.match(r"\s*<!doctype\s+([^>]*)>", source, re.I)
    if doctype:
        page._row("doctype", None, None, doctype.group(1).strip())
        at = doctype.end()
    page.push("html", {})
    page.push("head", {})
    while at < size:
        m = _TAG.search(source, at)
        begin = m.start() if m else size
        if begin > at:
            data = source[at:begin]
            page.text(entities.unescape(data) if "&" in data else data)
        if not m:
            break
        at = m.end()
        if m["comment"] is not None:
            page._row("comment", None, None, m["comment"])
        elif m["end"]:
            page.end(m["end"].lower())
        elif m["start"]:
            tag = m["start"].lower()
            page.start(tag, _attributes(m["attrs"]) if m["attrs"] else {})
            if tag in RAW or tag in RCDATA:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                stop = close.start() if close else size
                data = source[at:stop]
                if data:
                    raw = tag in RAW
                    page.text(data if raw else entities.unescape(data), "raw" if raw else "text")
                page.pop()
                at = close.end() if close else size
    page.start_body()
    page.pop_to(0)
    return page.rows


def _level(pos: int, tag: str, attrs: dict[str, str]) -> str:
    """An element as one level of ``ancestors``."""
    found = [f"#{attrs['id']}"] if "id" in attrs else []
    found += [f".{c}" for c in attrs.get("class", "").split()]
    found += [f"[{k}={v}" for k, v in attrs.items()]
    parts = [str(pos), tag, *[x.replace(LEVEL, " ").replace(PART, " ") for x in found]]
    return LEVEL + PART.join(parts) + PART


def _add_ancestors(rows: list[list]) -> None:
    around = [""]  # by depth
    for row in rows:
        depth = row[2]
        row.append(around[depth])
        if row[3] == "element":
            level = _level(row[0], row[4], row[5]) if depth < MAX_LEVELS else ""
            around[depth + 1 :] = [around[depth] + level]


def _page_rows(source: str | None) -> list[list]:
    rows = shred_html(source or "")
    _add_ancestors(rows)
    return rows


def _of_size(rows: list[tuple], limit: int = 16 << 20) -> Iterator[list[tuple]]:
    """Rows in pieces whose ``ancestors`` hold about ``limit`` characters."""
    begin = held = 0
    for at, (_, row) in enumerate(rows):
        held += len(row[-1])
        if held > limit:
            yield rows[begin : at + 1]
            begin, held = at + 1, 0
    if begin < len(rows):
        yield rows[begin:]


def html_nodes(df: DataFrame, html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """Node table of every page; ``carry`` columns are repeated on each node.

    Only the key, carried and HTML columns reach Python. The table is big text, so
    each input batch is turned into output batches of bounded size.
    """
    keep = [*KEY, *carry]
    source = df.select(*keep, F.col(html).alias("_html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    names = list(_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            found = ((i, row) for i in range(batch.num_rows) for row in _page_rows(texts[i].as_py()))
            while some := list(islice(found, 20_000)):
                for part in _of_size(some):
                    owners, rows = zip(*part, strict=True)
                    left = [batch.column(k).take(pa.array(owners, pa.int32())) for k in range(len(keep))]
                    columns = list(zip(*rows, strict=True))
                    right = [
                        pa.array([list(v.items()) if v else [] for v in c] if n == "attrs" else c, _ARROW[n])
                        for n, c in zip(names, columns)
                    ]
                    yield pa.RecordBatch.from_arrays(left + right, names=keep + names)

    return source.mapInArrow(run, f"{fields}, {NODE_SCHEMA}")
