"""Small tables with the odd cases every operator has to stand."""

import random

SYLLABLES = [a + b + c for a in "bcdfgklmnprstvwz" for b in "aeiou" for c in ("", "n", "r")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use for columns of their own
CLASHING = "uid long, kept boolean, size long, label string, runs string, k long, d long, _row string, _doc string, start int, piece int, copies int"


def prose(seed, sentences, per_line=3):
    r = random.Random(seed)
    out = []
    for _ in range(sentences):
        words = ["".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4)))) for _ in range(r.randint(4, 14))]
        out.append(" ".join(words).capitalize() + ".")
    lines = [" ".join(out[i : i + per_line]) for i in range(0, len(out), per_line)]
    return "\n".join(lines)


def odd_rows():
    base = prose(1, 30)
    near = base.replace(base.split()[20], "other", 1)
    rows = [
        (1, base, "en", "a", None),
        (2, near, "en", "a", 5),
        (3, base, "en", "b", 5),
        (3, base, "en", "b", 5),  # a repeated row
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \n\t\n ", "en", "c", 5),
        (7, "one", "en", "c", 3),
        (8, "one two three four", "de", None, 18),
        (9, prose(2, 30), "en", "a", 1),
        (9, prose(3, 12), "en", "b", 1),  # two texts under one id
        (None, prose(4, 25), "fr", "b", 1),
        (None, prose(4, 25), "fr", "b", 1),
        (10, prose(5, 3000), "en", "a", 1),  # very long
        (11, "same line here\n" * 40, "en", "c", 1),
        (12, "é€😀 naïve ß\n" + prose(6, 20), "fr", "a", 1),
        (13, prose(7, 20) + "\n" + "\n".join(base.split("\n")[2:6]) + "\n" + prose(8, 5), "en", "c", 1),
    ]
    return rows


def odd_docs(spark):
    """The odd rows, with further columns whose names clash."""
    extra = (1, True, 2, "x", "y", 3, 4, "z", "w", 5, 6, 7)
    return spark.createDataFrame([r + extra for r in odd_rows()], f"{SCHEMA}, {CLASHING}").repartition(3)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
