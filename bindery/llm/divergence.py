"""How far the sources of a language differ in their use of terms, from a frequent-pattern tree of term rows.

A term's row lists the sources which use it, in the order of sources, with their smoothed shares. The
distance of two sources is the sum over all kept terms of the difference of their shares. It is put
together from three parts: what all terms would give if neither source used them, what changes for the
terms that one of the two uses, and a correction for the terms that both use. The first two follow from
a source's own shares, by running sums. The third comes from the tree: equal rows are counted once, the
counted rows are sorted so that those with a common beginning follow each other, and each task builds
the tree of its rows one path at a time. A node knows how many terms pass it; when the path leaves it,
it adds that many corrections at once for each of its ancestors. Tasks give sums by pair of sources.

All figures are integers. A term's row is no longer than the number of sources of its language, and
pairs of sources are the rows of the result; no pair of terms or documents is made.

Defined cases: null texts, languages and sources count as empty; every pair of language and source that
occurs is a group, even without terms; a language without kept terms has distances of 0 and no term
rows; a language with one source has no pairs; repeated rows are documents of their own; long texts are
counted like others, one at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import materialize
from bindery.operators.scan import lookup

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: counted terms a task holds before it passes them on
HELD_TERMS = 400_000
#: sums of pairs a task holds before it passes them on
HELD_PAIRS = 2_000_000
#: letters in lower case and all bytes of other characters; blanks elsewhere
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, as each task has counted them."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def passed_on(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in held.items():
            names = list(n)
            for at in range(0, len(names), 65536):
                some = names[at : at + 65536]
                columns = [
                    pa.array([lang] * len(some), pa.string()),
                    pa.array([source] * len(some), pa.string()),
                    pa.array(some, pa.binary()).cast(pa.string()),
                    pa.array([n[t] for t in some], pa.int64()),
                    pa.array([in_docs[t] for t in some], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for lang, source, text in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                    found = terms(text)
                    n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                    n.update(found)
                    in_docs.update(set(found))
                if sum(1 + len(n) for n, _ in held.values()) > HELD_TERMS:
                    yield from passed_on(held)
                    held = {}
        yield from passed_on(held)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column | str, total: str, kinds: str, smoothing: int, scale: int) -> Column:
    """``1 + floor(scale * (n + smoothing) / (total + smoothing * kinds))``, exactly; 0 without kept terms."""
    big = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = big((F.col(n) if isinstance(n, str) else n) + smoothing, 20) * big(F.lit(scale), 12)
    below = big(F.col(total), 20) + big(F.col(kinds), 19) * smoothing
    return F.when(F.col(kinds) > 0, 1 + F.call_function("div", above, below)).otherwise(F.lit(0)).cast("long")


class PairSums:
    """Sums by pair of sources of one language, numbered as they are met."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.rows: dict[int, np.ndarray] = {}
        self.cells = 0

    def of(self, source: str) -> int:
        return self.number.setdefault(source, len(self.number))

    def add(self, later: int, earlier: np.ndarray, values: np.ndarray) -> None:
        row = self.rows.get(later)
        if row is None or len(row) <= earlier.max():
            longer = np.zeros(max(2 * int(earlier.max()), 16), np.int64)
            if row is not None:
                longer[: len(row)] = row
            self.cells += len(longer) - (0 if row is None else len(row))
            self.rows[later] = row = longer
        row[earlier] += values  # sources occur once on a path

    def passed_on(self, lang: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        names = list(self.number)
        for later, row in self.rows.items():
            at = np.flatnonzero(row)
            if len(at):
                columns = [[lang] * len(at), [names[i] for i in at], [names[later]] * len(at), row[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class TermTree:
    """The open path of a tree whose rows come in order; a node left behind adds its corrections."""

    def __init__(self, sums: PairSums):
        self.sums = sums
        self.source: list[int] = []
        self.used: list[int] = []  # the source's share of the term
        self.unused: list[int] = []  # its share of a term that it doesn't use
        self.terms: list[int] = []

    def insert(self, row: list[tuple[str, int, int]], times: int) -> None:
        numbers = [self.sums.of(source) for source, _, _ in row]
        same = 0
        for number, (_, used, _), a, b in zip(numbers, row, self.source, self.used, strict=False):
            if number != a or used != b:
                break
            same += 1
        self.leave(same)
        for number, (_, used, unused) in zip(numbers[same:], row[same:], strict=True):
            self.source.append(number)
            self.used.append(used)
            self.unused.append(unused)
            self.terms.append(0)
        if row:
            self.terms[-1] += times

    def leave(self, depth: int) -> None:
        if len(self.terms) <= depth:
            return
        source, used, unused = (np.array(x, np.int64) for x in (self.source, self.used, self.unused))
        for i in range(len(self.terms) - 1, depth - 1, -1):
            n = self.terms[i]
            if i:
                self.terms[i - 1] += n
                p, zero, ps, zeros = used[i], unused[i], used[:i], unused[:i]
                both = np.abs(p - ps) - np.abs(p - zeros) - np.abs(zero - ps) + np.abs(zero - zeros)
                self.sums.add(int(source[i]), source[:i], n * both)
        for x in (self.source, self.used, self.unused, self.terms):
            del x[depth:]


def tree_sums(rows: DataFrame) -> DataFrame:
    """``lang, a, b, value``: the corrections of pairs of sources, from sorted rows ``lang, row, times``."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, sums = None, PairSums()
        tree = TermTree(sums)
        for batch in batches:
            column = batch.column(1)
            parts = column.flatten()
            fields = [parts.field(i).to_pylist() for i in range(3)]
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            begin = 0
            for now, end, times in zip(batch.column(0).to_pylist(), ends, batch.column(2).to_pylist(), strict=True):
                if now != lang or sums.cells > HELD_PAIRS:
                    tree.leave(0)
                    if lang is not None:
                        yield from sums.passed_on(lang, schema)
                    lang, sums = now, PairSums()
                    tree = TermTree(sums)
                tree.insert(list(zip(*(f[begin:end] for f in fields), strict=True)), times)
                begin = end
        tree.leave(0)
        if lang is not None:
            yield from sums.passed_on(lang, schema)

    return rows.select("lang", "row", "times").mapInArrow(run, "lang string, a string, b string, value long")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, source, n, total, is_first``: the counts of kept terms, by source and over the language."""
    # one shuffle: rows of a term stay together for its sources, its documents and its row
    dealt = counted(docs).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    measured = by_source.select(
        "lang",
        "term",
        "source",
        "n",
        F.sum("n").over(of_term).alias("total"),
        F.sum("docs").over(of_term).alias("docs"),
        (F.min("source").over(of_term) == F.col("source")).alias("is_first"),
    )
    return measured.filter(F.col("docs") >= min_docs).drop("docs")


def divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, top_terms: int = TOP_TERMS
) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and a source's own terms.

    Part ``pair`` ranks the other sources of the language by distance, part ``term`` the terms which the
    source uses more than its language does, up to ``top_terms``.
    """
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = materialize(kept_terms(named, min_docs), "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("is_first").alias("kinds"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = named.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = materialize(groups.fillna(0, ["source_n", "lang_n", "kinds"]).withColumn("unused", share(F.lit(0), "source_n", "kinds", smoothing, scale)), "groups")

    used = lookup(kept, groups, ["lang", "source"], "inner").withColumn("used", share("n", "source_n", "kinds", smoothing, scale))
    used = materialize(used, "shares")
    of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = used.select("lang", "source", F.col("term").alias("item"), (F.col("used") - share("total", "lang_n", "kinds", smoothing, scale)).alias("value"))
    own = above.filter("value > 0").withColumn("rank", F.row_number().over(of_group)).filter(F.col("rank") <= top_terms)

    # terms that the first source uses, at the share that the second has of a term it doesn't use
    values = used.groupBy("lang", "source", "used").agg(F.count(F.lit(1)).alias("times"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("unused").alias("at"))
    questions = groups.select("lang", "source", "unused", "kinds").join(others, "lang").filter("source <> other")
    points = values.select(
        "lang", "source", F.col("used").alias("at"), "times", F.lit(None).cast("string").alias("other"), F.lit(0).alias("unused"), F.lit(0).alias("kinds")
    ).unionByName(questions.withColumn("times", F.lit(0)))
    of_source = Window.partitionBy("lang", "source")
    so_far = of_source.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    mass = F.col("times") * F.col("at")
    summed = points.select(
        "lang", "source", "other", "at", "unused", "kinds",
        F.sum("times").over(so_far).alias("n_below"), F.sum(mass).over(so_far).alias("below"),
        F.sum("times").over(of_source).alias("n"), F.sum(mass).over(of_source).alias("all"),
    ).filter("other is not null")
    neither = F.abs(F.col("unused") - F.col("at"))
    one = F.expr("at * n_below - below + (all - below) - at * (n - n_below)") - F.col("n") * neither
    ordered = [F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")]
    either = summed.select("lang", *ordered, (one + F.when(F.expr("source < other"), F.col("kinds") * neither).otherwise(0)).alias("value"))

    cell = F.struct("source", "used", "unused")
    rows = used.groupBy("lang", "term").agg(F.sort_array(F.collect_list(cell)).alias("row"))  # one cell per source at most
    rows = rows.filter(F.size("row") > 1).groupBy("lang", "row").agg(F.count(F.lit(1)).alias("times"))
    both = tree_sums(rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row"))

    pairs = either.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    distances = pairs.select("lang", "value", ways.alias("way")).select("lang", "way.source", "way.item", "value")
    ranked = distances.withColumn("rank", F.row_number().over(of_group))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(ranked, "pair").unionAll(columns(own, "term"))
