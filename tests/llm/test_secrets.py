import hashlib
import random
import re

from pyspark.sql import functions as F

from bindery.llm import secrets
from tests.llm.cases import SCHEMA, empty, odd_docs, odd_rows

KEY = "AKIA" + "ABCDEFGHIJKLMN"
LIVE = "tR4xQ9zLm2Vb7KpW1sYc8Nd"
PUBLIC = "pK3vB8nMx5Qw2ZrT9yHj6Lf"
TEXTS = [
    ("a", f"password = token = {'x1' * 8} end"),
    ("a", f"é😀 API_KEY: 'abcdefghijkl' and apikey=\"{'q' * 12}\" passwd=short"),
    ("b", f"{KEY} AKIASHORT AKIAAKIA{'Z' * 12}"),
    ("b", "deadbeefdeadbeef DEADBEEFDEADBEEF 0123456789abcdefg"),
    ("a", f"see {LIVE} here"),
    ("a", f"see {PUBLIC}"),
    ("b", f"see {PUBLIC}"),
    ("c", f"see {PUBLIC} twice {PUBLIC}"),
    ("a", f"secret={LIVE}"),
    ("c", "PaSsWd\"  :  \"" + "A" * 12 + "\" toKEN='" + "b" * 12 + "'"),
    (None, None),
    ("c", ""),
    ("c", "ſecret=abcdefghijklm toKen=abcdefghijklm"),
]


def base(text):
    """The three kinds as the rules state them."""
    text = text or ""
    out = []
    words = ("password", "passwd", "secret", "token", "api_?key")
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)
    low = re.compile(f"({either})" + r"""["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), 0, m.end()) for m in low.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def joined(found):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)


def noise(seed):
    r = random.Random(seed)
    parts = ["password", "token", "=", ":", " ", "'", '"', "AKIA", "abcdef", "0123456789", "XYZ", "api_key", "secret", "\n", "é", "Q7", "deadbeef"]
    return "".join(r.choice(parts) for _ in range(200))


def test_base_spans_against_the_rules(spark):
    texts = [t for _, t in TEXTS] + [noise(i) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    got = secrets.scan_report(docs, F.col("doc_id"), F.col("source")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert [s for s in r.spans.split(",") if s and not s.startswith("token")] == [s for s in joined(want).split(",") if s]
    assert sum(r.n_assign for r in got) > 20


def test_ownership_separates_copies_from_live_values(spark):
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, (s, t) in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: r for r in secrets.scan_report(docs, F.col("doc_id"), F.col("source")).collect()}
    assert got[4].spans == f"token:4:{4 + len(LIVE)}" and got[4].n_live == 1  # one owner
    assert [got[i].spans for i in (5, 6, 7)] == ["", "", ""]  # three owners
    assert got[8].n_assign == 1 and got[8].n_live == 1
    strict = secrets.scan_report(docs, F.col("doc_id"), F.col("source"), max_owners=0).collect()
    assert all(r.n_live == r.n_token == 0 for r in strict) and sum(r.n_assign for r in strict) == sum(r.n_assign for r in got.values())


def test_counts_over_the_corpus(spark):
    docs = spark.createDataFrame([(i % 7, f"x {PUBLIC}", "en", "ab"[i % 2], 1) for i in range(28)], SCHEMA)
    row = secrets.ownership(secrets.scan(docs, F.col("doc_id"), F.col("source"))).first()
    assert (row.n_documents, row.n_repositories, row.n_owners) == (28, 14, 2)


def test_odd_and_empty(spark):
    assert secrets.scan_report(odd_docs(spark), F.col("doc_id"), F.col("source")).count() == len(odd_rows())
    assert secrets.scan_report(empty(spark), F.col("doc_id"), F.col("source")).count() == 0


def test_long_texts_take_time_in_proportion_and_overlaps_are_found():
    import time

    r = random.Random(9)
    letters = "abcdefghijkABCDEFGHIJK0123456789"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    some = [f"token={word(20)} {word(40)} AKIA{'A1' * 9} {'0a1b' * 5}{word(30)} x" for _ in range(40)]
    text = " ".join(some)
    found = secrets.candidates(text)
    base = [(s, e) for s, kind, e, _ in found if kind < 3]
    wanted = [m.span() for m in secrets.TOKEN.finditer(text) if secrets.random_looking(m[0]) and not any(s < m.end() and m.start() < e for s, e in base)]
    assert [(s, e) for s, kind, e, _ in found if kind == 3] == wanted != []
    started = time.perf_counter()
    assert len(secrets.candidates(" ".join(some * 200))) == 200 * len(found)
    assert time.perf_counter() - started < 20
