"""Removal of repeated runs of lines, found by winnowing.

The lines of a text that are not blank are hashed. Every window of ``run_lines`` consecutive line
hashes selects its least, the leftmost of equals, so two texts which share a run of that many lines
share a selected hash. Places selected by several windows are one fingerprint. Later places of a hash
are joined to its first one, and the match is extended to both sides by comparing the lines around.
It is a repeat when it has ``run_lines`` lines. What stands in other surroundings than at the first
place is joined again by the selected hash with its surroundings, so a repeat of any earlier place
counts. Overlapping and adjacent repeats join into maximal runs, which are deleted together with blank
lines inside them. The earliest occurrence stays.

A line of ``long_words`` words or more is a run by itself, whatever stands around it, so a passage on
one line and a text of one line are found. Without ``long_words`` lines repeat in runs only.

Earlier means a smaller ``doc_id`` (null before all), then a smaller text key, then a higher place.
DataFrame functions only; groups of equal hashes are reduced by aggregates and never gathered, and
hot hashes are spread when places are joined to the first one.

Defined cases: a null or empty text stays empty; texts of fewer than ``run_lines`` filled lines change
only by long lines; a character of a script without spaces counts as a word; rows equal in ``doc_id``
and text are one document and share its result; lines are compared without white space of any kind at
their ends, and a line of white space is blank; an empty table gives an empty result; other columns
pass through ``drop_repeated_lines`` and are ignored by ``repeated_runs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import materialize
from bindery.operators.scan import lookup

RUN_LINES = 2
#: a line of so many words repeats by itself
LONG_WORDS = 12
#: white space inside a line
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and c != 10)
ENDS = rf"^[{SPACES}]++|(?<![{SPACES}])[{SPACES}]++$"
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: a word with the white space after it. Words of characters below Thai which end at an ASCII blank are most of all and tested
#: first; atomic, so a line with too few words is read once
WORD = rf"(?>[!-~\x{{A1}}-\x{{DFF}}]++(?=[\x09-\x0D\x1C-\x20]|\z)|[^{SPACES}{UNSPACED}]++|[{UNSPACED}])[{SPACES}]*+"


def _lines(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def is_filled(text: Column | str) -> Column:
    return F.rlike(text, F.lit(rf"[^\n{SPACES}]"))


def _bare(line: Column) -> Column:
    """A line without white space at its ends; few lines have any, and only those need the pattern."""
    white = F.contains(F.lit(SPACES), F.substring(line, 1, 1)) | F.contains(F.lit(SPACES), F.substring(line, -1, 1))
    return F.when(white, F.regexp_replace(line, F.lit(ENDS), F.lit(""))).otherwise(line)


def _has_words(line: Column, n: int) -> Column:
    """Whether a line has ``n`` words or more; it is read up to the last of these only."""
    return F.rlike(line, F.lit(rf"^[{SPACES}]*+(?:{WORD}){{{n}}}"))


def line_places(docs: DataFrame, run_lines: int = RUN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``doc_id, text_key, lines, place, selected, around``: the selected places of each text. Written once.

    ``lines`` is the length of a repeat, ``around`` the ``lines - 1`` hashes on either side with the selected one between.
    """
    text = F.coalesce("text", F.lit(""))
    filled = F.filter(F.transform(_lines(text), _bare), lambda x: x != "")

    def long(x: Column) -> Column:
        # short lines are told by their length alone
        return F.when(F.octet_length(x) >= long_words, _has_words(x, long_words)).otherwise(False)

    hashed = docs.select("doc_id", F.xxhash64(text).alias("text_key"), filled.alias("l")).select(
        "doc_id",
        "text_key",
        F.transform("l", lambda x: F.xxhash64(x)).alias("h"),
        (F.array().cast("array<boolean>") if long_words is None else F.transform("l", long)).alias("long"),
    )
    n = F.size("h")

    def least(i: Column) -> Column:
        # not slice(), which copies the whole array first: texts may have very many lines
        window = F.array(*[F.get("h", i + k) for k in range(run_lines)])
        return (i + F.array_position(window, F.array_min(window)) - 1).cast("int")

    def found(place: Column, lines: int) -> Column:
        around = F.array(*[F.get("h", place + k) for k in range(1 - lines, lines)])
        return F.struct(F.lit(lines).alias("lines"), place.alias("place"), F.get("h", place).alias("selected"), around.alias("around"))

    none = F.array().cast("array<int>")
    runs = F.when(n >= run_lines, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - run_lines, F.lit(0))), least))).otherwise(none)
    singles = F.filter(F.transform("long", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    chosen = hashed.select("doc_id", "text_key", "h", runs.alias("runs"), singles.alias("singles"))
    places = F.concat(F.transform("runs", lambda p: found(p, run_lines)), F.transform("singles", lambda p: found(p, 1)))
    return materialize(chosen.select("doc_id", "text_key", F.inline(places)), "line-places")


def _first_of(rows: DataFrame, by: list[str], begin: Column, *carried: str) -> DataFrame:
    """``by, first`` and the columns carried from the first row, of keys which occur more than once. Written once."""
    held = [F.min_by(c, begin).alias(f"first_{c}") for c in carried]
    firsts = rows.groupBy(*by).agg(F.min(begin).alias("first"), F.max(begin).alias("_last"), *held)
    return materialize(firsts.filter("first <> _last").drop("_last"), "first-places")


def later_repeats(places: DataFrame) -> DataFrame:
    """``doc_id, text_key, start, lines``: lines of a text which occur earlier in the corpus, around each selected place."""
    at = F.struct("doc_id", "text_key", "place")
    by = ["lines", "selected"]
    joined = lookup(places, _first_of(places, by, at, "around"), by, "inner").filter(at != F.col("first"))
    side = F.col("lines") - 1
    equal = F.zip_with("around", "first_around", lambda a, b: F.coalesce(a == b, F.lit(False)))

    def reach(lines: Column) -> Column:
        stop = F.array_position(lines, False).cast("int")
        return F.when(stop == 0, side).otherwise(stop - 1)

    both = joined.withColumn("_equal", equal).withColumns(
        {"left": reach(F.reverse(F.slice("_equal", 1, side))), "right": reach(F.slice("_equal", side + 2, side))}
    )
    matched = materialize(both.select("doc_id", "text_key", "lines", "place", "selected", "around", "left", "right"), "matched-places")
    extended = matched.filter("left + right + 1 >= lines").select(
        "doc_id", "text_key", (F.col("place") - F.col("left")).alias("start"), (F.col("left") + F.col("right") + 1).alias("lines")
    )

    # runs of these places which are not at the first one
    def run(i: Column) -> Column:
        lines = F.slice("around", i + 1, F.col("lines"))
        outside = (side - i > F.col("left")) | (i > F.col("right"))
        mine = outside & ~F.exists(lines, lambda x: x.isNull()) & (F.array_min(lines) == F.col("selected"))
        return F.when(mine, F.struct((F.col("place") - side + i).alias("start"), F.xxhash64(lines).alias("run")))

    others = F.filter(F.transform(F.sequence(F.lit(0), side), run), lambda x: x.isNotNull())
    rest = matched.filter("left < lines - 1 or right < lines - 1").select("doc_id", "text_key", "lines", F.inline(others))
    rest = rest.select("doc_id", "text_key", "start", "lines", "run")
    begin = F.struct("doc_id", "text_key", "start")
    again = lookup(rest, _first_of(rest, ["lines", "run"], begin), ["lines", "run"], "inner").filter(begin != F.col("first"))
    return extended.unionByName(again.select("doc_id", "text_key", "start", "lines"))


def repeated_runs(docs: DataFrame, run_lines: int = RUN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``doc_id, text_key, runs``: for each text with repeats, its runs as ``first, last`` among its filled lines."""
    later = later_repeats(line_places(docs, run_lines, long_words))
    # a text's own repeats: bounded by its length
    windows = later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "lines")).alias("w"))
    covered = F.flatten(F.transform("w", lambda w: F.sequence(w["start"], w["start"] + w["lines"] - 1)))
    lines = windows.select("doc_id", "text_key", F.array_sort(F.array_distinct(covered)).alias("s"))

    def neighbour(i: Column, step: int) -> Column:
        return F.get("s", i + step)

    first = F.filter("s", lambda x, i: (i == 0) | (x > neighbour(i, -1) + 1))
    last = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (neighbour(i, 1) > x + 1))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return lines.select("doc_id", "text_key", runs.alias("runs"))


def drop_repeated_lines(docs: DataFrame, run_lines: int = RUN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` with the text's later runs deleted, and last a struct ``_dedup`` of ``lines, removed, runs``.

    ``runs`` holds first and last line numbers of the original text, from 0.
    """
    runs = repeated_runs(docs, run_lines, long_words).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("runs").alias("_runs"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    keyed = docs.select(row, F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    both = keyed.join(runs, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    split = both.withColumn("_l", _lines(F.coalesce("_row.text", F.lit(""))))
    # numbers of the filled lines, looked at only where something goes
    filled = F.filter(F.transform("_l", lambda x, i: F.when(is_filled(x), i)), lambda i: i.isNotNull())
    at = split.withColumn("_at", F.when(F.col("_runs").isNotNull(), filled))
    placed = at.withColumn(
        "_runs",
        F.transform("_runs", lambda r: F.struct(F.get("_at", r["first"]).alias("first"), F.get("_at", r["last"]).alias("last"))),
    )
    size = F.size("_l")
    gaps = F.transform(
        "_runs", lambda r, i: F.slice("_l", F.coalesce(F.get("_runs", i - 1)["last"], F.lit(-1)) + 2, r["first"] - F.coalesce(F.get("_runs", i - 1)["last"], F.lit(-1)) - 1)
    )
    end = F.element_at("_runs", -1)["last"]
    kept = F.concat(F.flatten(gaps), F.slice("_l", end + 2, size - end - 1))
    text = F.when(F.col("_runs").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.aggregate("_runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0))
    told = F.struct(size.alias("lines"), removed.alias("removed"), F.col("_runs").alias("runs")).alias("_dedup")
    return placed.select(*[(text if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns], told)


def deduplicated(docs: DataFrame, run_lines: int = RUN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``doc_id, text, n_lines, n_removed, removed``: every document with its later runs deleted (``first:last`` line numbers)."""
    done = drop_repeated_lines(docs.select("doc_id", "text"), run_lines, long_words)
    runs = F.transform("_dedup.runs", lambda r: F.concat_ws(":", r["first"].cast("string"), r["last"].cast("string")))
    return done.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("_dedup.lines").cast("long").alias("n_lines"),
        F.col("_dedup.removed").cast("long").alias("n_removed"),
        F.coalesce(F.array_join(runs, ","), F.lit("")).alias("removed"),
    )
