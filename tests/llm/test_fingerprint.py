import hashlib
from collections import Counter

from bindery.llm import fingerprint
from bindery.llm.common import materialize
from tests.llm.cases import docs_of, empty, odd_docs, odd_rows, prose


def keys(text):
    return set(Counter(line for line in text.split("\n") if line.strip(" ")).items())


def likeness(a, b):
    return len(keys(a) & keys(b)) / len(keys(a) | keys(b)) if keys(a) | keys(b) else 1.0


def wanted(rows):
    """By doc_id descending, null last; each (doc_id, text) once."""
    docs = sorted({(r[0] is None, -(r[0] or 0), r[1] or "") for r in rows})
    return docs


def test_odd_documents_against_brute_force(spark):
    got = fingerprint.fingerprints(odd_docs(spark)).collect()
    rows = {(r[0], r[1] or "") for r in odd_rows()}
    assert len(got) == len(odd_rows())
    by_hash = {}
    # two texts of one id follow each other by text key: take the order that the results tell
    ids = sorted({r[0] for r in rows}, key=lambda d: (d is None, -(d or 0)))
    for i, d in enumerate(ids):
        texts = [t for e, t in rows if e == d]
        after = [t for e, t in rows if e == ids[(i + 1) % len(ids)]] + texts
        for g in (g for g in got if g.doc_id == d):
            found = []
            for t in texts:
                for nx in after:
                    h = len(t) // 2
                    edit = t[: len(t) - h] + nx[:h]
                    if hashlib.sha256(edit.encode()).hexdigest() == g.edited_sha256 and g.n_chars == len(t):
                        found.append((likeness(t, edit), likeness(t, nx), t))
            assert any(abs(a - g.near_edited) < 1e-9 and abs(b - g.near_next) < 1e-9 for a, b, _ in found), g
            by_hash.setdefault(g.fingerprint, set()).add(found[0][2])
    # equal fingerprints only for equal digests
    assert all(len({frozenset(keys(t)) for t in ts}) == 1 for ts in by_hash.values())


def test_order_wraps_and_slices_agree(spark, monkeypatch):
    rows = [(i, prose(i, 4), "en", "a", 1) for i in range(40)]
    docs = docs_of(spark, rows)
    one = sorted(map(tuple, fingerprint.fingerprints(docs).collect()))
    for d, n, sha, *_ in one:
        text, after = rows[d][1], rows[(d - 1) % 40][1]
        h = n // 2
        assert sha == hashlib.sha256((text[: n - h] + after[:h]).encode()).hexdigest()
    monkeypatch.setattr(fingerprint, "KEYS_PER_SLICE", 8)
    assert sorted(map(tuple, fingerprint.fingerprints(docs).collect())) == one


def test_many_differences_are_recovered_by_larger_sketches(spark):
    rows = [(i, list(range(i, 1500 + i)), list(range(0, 40 * i + 1))) for i in (0, 1, 7, 30)]
    pairs = materialize(spark.createDataFrame(rows, "id long, a array<long>, b array<long>"), "pairs")
    got = {r.id: (r.plus, r.minus) for r in fingerprint.differences(pairs, ["id"]).collect()}
    assert got == {i: (len(set(a) - set(b)), len(set(b) - set(a))) for i, a, b in rows}


def test_equal_texts_and_nothing(spark):
    text = prose(3, 20)
    got = fingerprint.fingerprints(docs_of(spark, [(1, text, None, None, None), (2, text, None, None, None), (3, None, None, None, None)])).collect()
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[2] != prints[3]
    assert {r.doc_id: r.near_next for r in got} == {1: 0.0, 2: 1.0, 3: 0.0}
    alone = fingerprint.fingerprints(docs_of(spark, [(5, text, None, None, None)])).first()
    assert alone.near_next == 1.0
    assert fingerprint.fingerprints(empty(spark)).count() == 0


def test_texts_are_shuffled_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(fingerprint, "materialize", lambda df, label: seen.setdefault(label, df) and materialize(df, label))
    rows = [(i, prose(i, 4), "en", "a", 1) for i in range(20)]
    got = fingerprint.fingerprints(docs_of(spark, [*rows, rows[3], rows[3]])).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(20), 3, 3])
    seen["digests"].collect()
    plan = seen["digests"]._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]
