"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is the multiset of its filled lines; a line and how often it occurs give one 64-bit digest. A
sketch holds, for a set of digests, 24 cells in three tables: a digest is added to one cell of
each, and a cell keeps count, XOR of digests and XOR of their checksums. Two sketches are
subtracted cell by cell, so what both texts hold cancels, and peeling recovers the rest: a cell with
count 1 or -1 and a matching checksum holds exactly one digest, which is taken out of its other
cells. Where peeling gets stuck there are more differences than the cells can hold: the set is
sketched again larger, as four sketches over digests dealt out by two further bits, each of which
may grow again. Work is linear in the paragraphs at every size.

The likeness of two texts is the Jaccard similarity of their digests, from the recovered
differences. DataFrame functions only.

Defined cases: a null text counts as empty; texts without a filled line have no digest, and two of
them likeness 1; a null ``doc_id`` is the least long; rows equal in ``doc_id`` and text are one document in that order, and each
gives its row; documents are ordered by ``doc_id`` descending (null after all others), then by text key; a document alone is its own
next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import materialize
from bindery.operators.scan import ordered_scan

TABLES, WIDTH = 3, 8
CELLS = TABLES * WIDTH
CHECK = 0x5EED
NULL_ID = -(1 << 63)
#: rows of document keys which one task orders
KEYS_PER_SLICE = 50_000
#: repeated rows written at a time
REPEATS = 10_000
LONGS = "array<bigint>"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digests(text: Column) -> Column:
    """The digests of a text's filled lines, without repeats: hashes of line and number of occurrences."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))

    def counted(s: Column) -> Column:
        n = F.size(s)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(starts, lambda b: F.transform(b, lambda i, j: F.xxhash64(F.get(s, i), F.coalesce(F.get(b, j + 1), n) - i)))

    return bound(F.array_sort(lines), counted)


def cell_of(digest: Column, table: Column, level: Column) -> Column:
    return F.pmod(F.xxhash64(digest, table, level), F.lit(WIDTH))


def check_of(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(CHECK))


def sketch(keys: Column, level: Column) -> Column:
    """Cells ``n, k, c`` of a set of digests: count, XOR of digests, XOR of checksums."""

    def cell(i: Column) -> Column:
        table, place = F.floor(i / WIDTH).cast("int"), i % WIDTH
        inside = F.filter(keys, lambda x: cell_of(x, table, level) == place)
        return bound(
            inside,
            lambda held: F.struct(
                F.size(held).alias("n"),
                F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias("k"),
                F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(check_of(x))).alias("c"),
            ),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c"))
    )


def peel(cells: Column, level: Column) -> Column:
    """``cells, plus, minus``: digests only in the first or only in the second sketch, and the cells left over."""
    none = F.array().cast(LONGS)
    start = F.struct(cells.alias("cells"), none.alias("plus"), none.alias("minus"))

    def pure(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (check_of(c["k"]) == c["c"])

    def step(state: Column, _: Column) -> Column:
        def remove(p: Column) -> Column:
            def without(c: Column, i: Column) -> Column:
                hit = cell_of(p["k"], F.floor(i / WIDTH).cast("int"), level) == i % WIDTH
                less = F.struct(
                    (c["n"] - p["n"]).alias("n"), c["k"].bitwiseXOR(p["k"]).alias("k"), c["c"].bitwiseXOR(p["c"]).alias("c")
                )
                return F.when(hit, less).otherwise(c)

            mine = F.array(p["k"])
            return F.when(p.isNull(), state).otherwise(
                F.struct(
                    F.transform(state["cells"], without).alias("cells"),
                    F.when(p["n"] == 1, F.concat(state["plus"], mine)).otherwise(state["plus"]).alias("plus"),
                    F.when(p["n"] == -1, F.concat(state["minus"], mine)).otherwise(state["minus"]).alias("minus"),
                )
            )

        return bound(F.get(F.filter(state["cells"], pure), F.lit(0)), remove)

    # each step empties a cell at least
    filled = F.size(F.filter(cells, lambda c: (c["n"] != 0) | (c["k"] != 0)))
    steps = F.when(filled > 0, F.sequence(F.lit(1), filled)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step)


def differences(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``plus``, ``minus``: how many digests only the first and only the second set of a pair holds.

    ``pairs`` has the columns of ``by`` and two digest arrays ``a`` and ``b``. Every round sketches,
    subtracts and peels; pairs which got stuck go to the next round as four parts.
    """
    done: list[DataFrame] = []
    now, level = pairs.select(*by, "a", "b"), 0
    while True:
        at = F.lit(level)
        cells = now.withColumn("cells", subtract(sketch(F.col("a"), at), sketch(F.col("b"), at)))
        peeled = cells.withColumn("p", peel(F.col("cells"), at))
        stuck = F.exists("p.cells", lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0))
        tried = materialize(
            peeled.withColumn("stuck", stuck).select(
                *by,
                "stuck",
                F.size("p.plus").alias("plus"),
                F.size("p.minus").alias("minus"),
                F.when(F.col("stuck"), F.col("a")).alias("a"),
                F.when(F.col("stuck"), F.col("b")).alias("b"),
            ),
            f"peeled-{level}",
        )
        done.append(tried.filter(~F.col("stuck")).select(*by, "plus", "minus"))
        rest = tried.filter("stuck")
        if rest.isEmpty():
            break
        part = lambda x, i: F.pmod(F.xxhash64(x, F.lit(-1 - level)), F.lit(4)) == i  # noqa: B023, E731
        now = rest.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
            *by, F.filter("a", lambda x: part(x, F.col("i"))).alias("a"), F.filter("b", lambda x: part(x, F.col("i"))).alias("b")
        )
        level += 1
    found = reduce(DataFrame.unionByName, done)
    return found.groupBy(*by).agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))


def written(cells: Column, keys: Column) -> Column:
    """A sketch as text: the number of digests, then the cells, 13 bytes each, in base64."""

    def cell(c: Column) -> Column:
        low = c["c"].bitwiseAND(F.lit(0xFFFFFFFF))
        return F.concat(F.lpad(F.hex(c["n"].bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(low), 8, "0"))

    packed = F.translate(F.base64(F.unhex(F.array_join(F.transform(cells, cell), ""))), "\r\n", "")
    return F.concat(F.size(keys).cast("string"), F.lit(":"), packed)


def followers(table: DataFrame) -> DataFrame:
    """``d, k, to_d, to_k, half, rows``: for each document the one it follows, half that one's length and its number of rows."""
    narrow = table.groupBy("d", "k", "n_chars").agg(F.count(F.lit(1)).alias("rows")).withColumn("_all", F.lit(0))
    one = F.struct("d", "k", F.floor(F.col("n_chars") / 2).cast("int").alias("half"), "rows")
    order = [F.col("d").desc(), F.col("k")]
    placed = ordered_scan(narrow, ["_all"], order, lasts={"to": one}, limit=KEYS_PER_SLICE)
    # the first document follows the last: the smallest id with the largest key
    last = narrow.agg(F.max_by(one, F.struct(F.bitwise_not("d"), "k"))).first()
    end = F.struct(*[F.lit(v).cast(t) for v, t in zip(last[0] or (None,) * 4, ("long", "long", "int", "long"), strict=True)])
    to = F.coalesce(F.col("to"), end.cast("struct<d:bigint,k:bigint,half:int,rows:bigint>"))
    follows = [F.col("to.d").alias("to_d"), F.col("to.k").alias("to_k"), F.col("to.half").alias("half"), F.col("to.rows").alias("rows")]
    return placed.withColumn("to", to).select("d", "k", *follows)


def edited_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, d, k, rows, n_chars, edited_sha256, own, edited, next``: digests of each text, its edited text and the next text. Written once."""
    text = F.coalesce("text", F.lit(""))
    table = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))
    keys = materialize(followers(table.select("d", "k", F.length("text").alias("n_chars"))), "followers")
    # one shuffle of the texts serves both joins, as long as both take the same columns of it; the second moves halves of texts only
    whole = table.groupBy("d", "k").agg(F.first("text").alias("text"))
    sent = whole.join(keys, ["d", "k"]).select(
        F.col("to_d").alias("d"), F.col("to_k").alias("k"), F.expr("substring(text, 1, half)").alias("tail"), digests(F.col("text")).alias("next"), "rows"
    )
    both = whole.join(sent, ["d", "k"]).withColumn("n_chars", F.length("text").cast("long"))
    edit = F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 2) as int)), tail)")
    changed = both.withColumn("changed", edit)
    return materialize(
        changed.select(
            F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id"),
            "d",
            "k",
            "rows",
            "n_chars",
            F.sha2("changed", 256).alias("edited_sha256"),
            digests(F.col("text")).alias("own"),
            digests(F.col("changed")).alias("edited"),
            "next",
        ),
        "digests",
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of its text and its edited text, and likenesses to the edited and the next text."""
    table = edited_digests(docs)
    others = [F.struct(F.lit(i).alias("kind"), F.col(n).alias("b")) for i, n in enumerate(("edited", "next"))]
    pairs = table.select("d", "k", F.col("own").alias("a"), F.explode(F.array(*others)).alias("o"))
    found = differences(pairs.select("d", "k", "o.kind", "a", "o.b"), ["d", "k", "kind"])
    sides = found.groupBy("d", "k").agg(
        *[F.max(F.when(F.col("kind") == i, F.struct("plus", "minus"))).alias(n) for i, n in enumerate(("to_edited", "to_next"))]
    )

    def likeness(side: str) -> Column:
        union = F.size("own") + F.col(f"{side}.minus")
        return F.when(union == 0, F.lit(1.0)).otherwise((F.size("own") - F.col(f"{side}.plus")) / union).cast("double")

    level = F.lit(0)
    each = table.join(sides, ["d", "k"]).withColumn("_at", F.explode(F.expr(f"sequence(0, (rows - 1) div {REPEATS})")))
    return each.withColumn("_n", F.explode(F.expr(f"sequence(1, least({REPEATS}, rows - _at * {REPEATS}))"))).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(sketch(F.col("own"), level), F.col("own")).alias("fingerprint"),
        written(sketch(F.col("edited"), level), F.col("edited")).alias("edited_fingerprint"),
        likeness("to_edited").alias("near_edited"),
        likeness("to_next").alias("near_next"),
    )
