"""CSS selectors compiled to predicates over node rows.

A selector is a chain of compounds joined by descendant and child combinators. Only
the list of selector strings is handled on the driver. A row's own columns tell
whether the last compound matches; the others are looked for in ``ancestors`` by one
regular expression. So matching, and telling what lies inside matching elements, are
tests of single rows: no shuffle, no window.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.sqltext import q, q_list
from bindery.operators.render import is_element, is_text, next_pos, with_link_text
from bindery.sources.html import LEVEL, PART

_SIMPLE = re.compile(
    r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
    |:contains\(\s*(?:"(?P<cdq>[^"]*)"|'(?P<csq>[^']*)'|(?P<cbare>[^)]*))\s*\)|(?P<empty>:empty)""",
    re.X,
)


@dataclass(frozen=True)
class Compound:
    tag: str | None = None
    ids: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str | None, str | None], ...] = ()
    contains: tuple[str, ...] = ()
    empty: bool = False
    #: joined to the compound before it by ">"
    child: bool = False

    @property
    def plain_class(self) -> bool:
        return len(self.classes) == 1 and not (self.tag or self.ids or self.attrs or self.contains or self.empty)

    @property
    def plain_tag(self) -> bool:
        return bool(self.tag) and not (self.classes or self.ids or self.attrs or self.contains or self.empty)

    def parts(self) -> list[str]:
        """What the parts of an element in ``ancestors`` have to match, each from its beginning."""
        rest, word = f"[^{PART}]*", rf"(?:[^{PART}]*\s)?"
        found = [f"#{re.escape(i)}{PART}" for i in self.ids] + [rf"\.{re.escape(c)}{PART}" for c in self.classes]
        for name, op, value in self.attrs:
            v, key = re.escape(value or ""), rf"\[{re.escape(name)}="
            forms = {
                None: key,
                "=": f"{key}{v}{PART}",
                "*=": f"{key}{rest}{v}",
                "^=": f"{key}{v}",
                "$=": f"{key}{rest}{v}{PART}",
                "~=": rf"{key}{word}{v}(?:\s{rest})?{PART}",
                "|=": f"{key}{v}(?:-{rest})?{PART}",
            }
            found.append("(?!)" if op in ("*=", "^=", "$=") and not value else forms[op])
        return found

    def level(self) -> str:
        """Regular expression of the whole element in ``ancestors``."""
        tests = [f"(?={PART}{re.escape(self.tag)}{PART})"] if self.tag else []
        tests += [f"(?=[^{LEVEL}]*{PART}{part})" for part in self.parts()]
        if self.empty:  # nothing is inside an empty element
            tests.append("(?!)")
        return f"{LEVEL}[0-9]+{''.join(tests)}[^{LEVEL}]*"

    def sql(self, contains: bool) -> str:
        tests = ["kind = 'element'"]
        if self.tag:
            tests.append(f"tag = {q(self.tag)}")
        tests += [f"elem_id = {q(i)}" for i in self.ids]
        tests += [f"array_contains(classes, {q(c)})" for c in self.classes]
        for name, op, value in self.attrs:
            got, v = f"attrs[{q(name)}]", q(value or "")
            partial = {"*=": f"contains({got}, {v})", "^=": f"startswith({got}, {v})", "$=": f"endswith({got}, {v})"}
            if op is None:
                tests.append(f"{got} is not null")
            elif op in partial:
                tests.append(partial[op] if value else "false")
            elif op == "~=":
                tests.append(f"array_contains(split({got}, {q(chr(92) + 's+')}), {v})")
            elif op == "|=":
                tests.append(f"({got} = {v} or startswith({got}, {q((value or '') + '-')}))")
            else:
                tests.append(f"{got} = {v}")
        if contains:
            tests += [f"contains(inner_text, {q(t)})" for t in self.contains]
        if self.empty:
            tests.append("_empty")
        return "(" + " and ".join(tests) + ")"


def parse_selector(selector: str) -> list[list[Compound]] | None:
    """Alternatives of a comma list, each a chain of compounds; None when not understood."""
    alternatives = []
    for part in re.split(r",(?![^\[(]*[\])])", selector):
        chain, at, part = [], 0, part.strip()
        fields: dict = {}
        while at < len(part):
            if part[at].isspace() or part[at] == ">":
                if fields.keys() - {"child"}:
                    chain.append(fields)
                    fields = {}
                if part[at] == ">":
                    if not chain or fields:
                        return None
                    fields = {"child": True}
                at += 1
                continue
            m = _SIMPLE.match(part, at)
            if not m or (m["tag"] and fields.keys() - {"child"}):
                return None
            if m["tag"]:
                fields["tag"] = None if m["tag"] == "*" else m["tag"].lower()
            elif m["id"]:
                fields.setdefault("ids", []).append(m["id"])
            elif m["cls"]:
                fields.setdefault("classes", []).append(m["cls"])
            elif m["attr"]:
                value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)
                fields.setdefault("attrs", []).append((m["attr"].lower(), m["op"], value))
            elif m["empty"]:
                fields["empty"] = True
            else:
                fields.setdefault("contains", []).append(next(m[g] for g in ("cdq", "csq", "cbare") if m[g] is not None))
            at = m.end()
        if fields == {"child": True}:
            return None
        if fields:
            chain.append(fields)
        if not chain:
            return None
        alternatives.append([Compound(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items()}) for f in chain])
    return alternatives


def split_list(selectors: str) -> list[str]:
    """A comma list as single selectors, in order."""
    return [s.strip() for s in selectors.split(",")]


def asks_empty(selectors: list[str]) -> bool:
    """Does a selector ask for ``:empty``, which takes a look at the rows that follow?"""
    return any(c.empty for s in selectors for chain in parse_selector(s) or [] for c in chain)


def chain_pattern(chain: list[Compound] | tuple[Compound, ...]) -> str:
    """Regular expression of elements in ``ancestors`` which match the compounds one after the other."""
    out = ""
    for i, compound in enumerate(chain):
        out += ("" if compound.child or not i else f"(?:{LEVEL}[^{LEVEL}]*)*") + compound.level()
    return out


def inside_pattern(chains: list[tuple[Compound, ...]]) -> str:
    """Regular expression which finds an element matching one of the chains in ``ancestors``."""
    single = [c[0] for c in chains if len(c) == 1]
    tags = sorted({re.escape(c.tag) for c in single if c.plain_tag})
    # of one condition: what a part has to match, with names of classes put together
    one = [c for c in single if not c.tag and not c.empty and len(c.ids) + len(c.classes) + len(c.attrs) == 1]
    classes = sorted({re.escape(c.classes[0]) for c in one if c.classes})
    found = [rf"{PART}\.(?:{'|'.join(classes)}){PART}"] if classes else []
    found += [f"{PART}(?:{'|'.join(parts)})"] if (parts := sorted({c.parts()[0] for c in one if not c.classes})) else []
    found += [f"{LEVEL}[0-9]+{PART}(?:{'|'.join(tags)}){PART}"] if tags else []
    return "|".join(found + [chain_pattern(c) for c in chains if len(c) > 1 or not (c[0].plain_tag or c[0] in one)])


@dataclass
class Matcher:
    """Adds the helper column a set of selectors needs and gives their predicates.

    ``:contains`` needs element text and so only works through ``match_selectors``;
    elsewhere such a selector counts as not understood.
    """

    nodes: DataFrame
    tests_empty: bool = False

    @staticmethod
    def over(nodes: DataFrame, selectors: list[str]) -> Matcher:
        empty = asks_empty(selectors)
        if empty:
            follower = next_pos(is_element() | (is_text() & (F.col("text") != "")))
            nodes = nodes.withColumn("_empty", follower.isNull() | (follower > F.col("end_pos")))
        return Matcher(nodes, empty)

    def _chain(self, chain: tuple[Compound, ...], contains: bool) -> str:
        own = chain[-1].sql(contains)
        if len(chain) == 1:
            return own
        pattern = chain_pattern(chain[:-1]) + (r"\z" if chain[-1].child else "")
        return f"({own} and ancestors rlike {q(pattern)})"

    def _any(self, selectors: list[str], contains: bool | None) -> str:
        chains = [tuple(chain) for s in selectors for chain in parse_selector(s) or []]
        if contains is None:
            chains = [c for c in chains if not any(p.contains for p in c)]
        tags = sorted({c[0].tag for c in chains if len(c) == 1 and c[0].plain_tag})
        classes = sorted({c[0].classes[0] for c in chains if len(c) == 1 and c[0].plain_class})
        rest = [c for c in chains if len(c) > 1 or not (c[0].plain_tag or c[0].plain_class)]
        tests = [self._chain(c, bool(contains)) for c in rest]
        if tags:
            tests.append(f"(kind = 'element' and tag in ({q_list(tags)}))")
        if classes:
            tests.append(f"(kind = 'element' and arrays_overlap(classes, array({q_list(classes)})))")
        return f"coalesce({' or '.join(tests) or 'false'}, false)"

    def any_of(self, selectors: list[str], contains: bool | None = None) -> Column:
        """Does the row match one of the selectors? Plain tags and classes share one test each.

        ``contains``: True tests ``:contains`` on ``inner_text``, False takes it as met,
        None leaves such selectors out.
        """
        return F.expr(self._any(selectors, contains))

    def within(self, selectors: list[str]) -> Column:
        """Does the row match one of the selectors, or lie inside an element which does?"""
        chains = [tuple(chain) for s in selectors for chain in parse_selector(s) or []]
        pattern = inside_pattern([c for c in chains if not any(p.contains for p in c)])
        inside = f"ancestors rlike {q(pattern)}" if pattern else "false"
        return F.expr(f"({self._any(selectors, None)} or {inside})")

    def indexes(self, selectors: list[str], contains: bool | None = None) -> Column:
        """Array of the (0-based) positions of the selectors the row matches."""
        tests = [f"if({self._any([s], contains)}, {i}, null)" for i, s in enumerate(selectors)]
        return F.expr(f"array_compact(array({', '.join(tests) or 'cast(null as int)'}))")

    @property
    def helpers(self) -> list[str]:
        return ["_empty"]


def match_selectors(nodes: DataFrame, selectors: list[str], text: bool = False) -> DataFrame:
    """Matching elements with ``selector_idx``; selectors not understood are skipped.

    With ``text``, or when a selector asks for it, ``inner_text`` holds the text of
    matched ``a`` elements.
    """
    m = Matcher.over(nodes, selectors)
    chains = [chain for s in selectors for chain in parse_selector(s) or []]
    found = m.nodes.withColumn("_cand", m.any_of(selectors, contains=False))
    if text or any(c.contains for chain in chains for c in chain):
        found = with_link_text(found, F.col("_cand"))
    else:
        found = found.filter("_cand")
    found = found.withColumn("_hit", m.indexes(selectors, contains=True)).filter(F.size("_hit") > 0)
    return found.withColumn("selector_idx", F.explode("_hit")).drop(*m.helpers, "_hit", "_cand")
