"""Language-model scores against loops, sums to one, numeric gradients and held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.llm import lbl
from bindery.llm.lbl import CLASSES, Lexicon, Model, fitted, scored
from tests.llm.cases import docs_of, empty, odd_docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens_of(text):
    return [w.translate(LOWER).encode() for w in WORD.findall(text or "")] + [b""]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def base_by_loops(rows):
    counts = Counter()
    for i, text in rows:
        if not held(i):
            counts.update(tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        found = tokens_of(text)
        known = sum(counts[t] > 0 for t in found)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in found)
        out.append((i, held(i), len(found), known, n, base))
    return out


def check(spark, rows, df):
    key = lambda r: (str(r[0]), r[2], r[5])
    ours, theirs = sorted((tuple(r) for r in scored(df).collect()), key=key), sorted(base_by_loops(rows), key=key)
    assert [r[:5] for r in ours] == [r[:5] for r in theirs]
    assert [r[5] for r in ours] == pytest.approx([r[5] for r in theirs], rel=1e-9, abs=1e-9)
    assert all(math.isfinite(r[6]) and r[6] <= 0 for r in ours)
    return ours


@pytest.mark.parametrize("frequent", [65_536, 200])
def test_odd_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(lbl, "FREQUENT", frequent)
    monkeypatch.setattr(lbl, "HELD_WORDS", frequent)
    monkeypatch.setattr(lbl.trained, "__defaults__", (3, 0.05))
    rows = [r[:2] for r in odd_rows()] + [(100 + i, prose(i, 8), "en", "a", 0)[:2] for i in range(30)]
    extra = [(100 + i, prose(i, 8), "en", "a", 0, 1, True, 2, "x", "y", 3, 4, "z", "w", 5, 6, 7) for i in range(30)]
    docs = odd_docs(spark)
    ours = check(spark, rows, docs.unionAll(spark.createDataFrame(extra, docs.schema)))
    repeated = [r[6] for r in ours if r[0] == 3]
    assert repeated[0] == pytest.approx(repeated[1])


def test_empty_and_nothing_to_learn_from(spark, monkeypatch):
    monkeypatch.setattr(lbl.trained, "__defaults__", (2, 0.05))
    assert scored(empty(spark)).collect() == []
    out = [i for i in range(100) if held(i)][:3]
    rows = [(i, f"some words {i}") for i in out]
    ours = check(spark, rows, docs_of(spark, [(i, t, "en", "a", 0) for i, t in rows]))
    assert {r[3:6] for r in ours} == {(0, 0, 0.0)}


def test_scores_follow_from_the_model(spark, monkeypatch):
    """Classes, normalised probabilities and discounted counts, put together by loops."""
    monkeypatch.setattr(lbl, "FREQUENT", 300)
    monkeypatch.setattr(lbl.trained, "__defaults__", (4, 0.05))
    rows = [(i, prose(i, 10) + " the of the", "en", "a", 0) for i in range(40)]
    df = docs_of(spark, rows)
    _, counts, known, model = fitted(df, lbl.is_held_out(F.col("doc_id")))
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    own = {w: int(known.classes[i]) for w, i in known.numbers.items() if known.classes[i] <= lbl.OWN}
    logs = model.log_probabilities()
    members = Counter()
    kinds = Counter()
    for w, c in n.items():
        if c and w and w not in own:
            members[lbl.suffix_class(w)] += c
            kinds[lbl.suffix_class(w)] += 1
    got = {r["doc_id"]: r["score"] for r in scored(df).collect()}
    for i, text, *_ in rows:
        total, context = 0.0, (0, 0)
        for w in tokens_of(text):
            c = 0 if not w else own.get(w) or lbl.suffix_class(w)
            total += float(logs[context[0] * CLASSES + context[1], c])
            if c > lbl.OWN:
                held_back = known.discount * kinds[c] / members[c] if members[c] else 1.0
                total += math.log10((n[w] - known.discount) / members[c] if n.get(w) else held_back)
            context = (context[1], c)
        assert got[i] == pytest.approx(total, rel=1e-6)


def random_model(seed):
    r = np.random.default_rng(seed)
    draw = lambda *shape: r.normal(0, 0.5, shape)
    return Model(draw(CLASSES, 8), draw(2, 8, 8), draw(CLASSES, 8), draw(CLASSES))


def test_probabilities_sum_to_one():
    logs = random_model(1).log_probabilities()
    assert np.allclose((10.0 ** logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    tokens = np.arange(CLASSES) * 3
    n = [np.array([1, 2, 0, 5, 1]), np.array([4])]
    for counts, c in ((n[0], CLASSES - 1), (n[1], 3)):
        tokens, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        tokens[c], kinds[c] = counts.sum(), (counts > 0).sum()
        lex = Lexicon({}, np.array([]), np.array([]), 100, 9, tokens, kinds, 0.6, 0)
        seen = counts[counts > 0]
        inside = 10 ** lex.inside(seen, np.full(len(seen), c))
        assert inside.sum() + lex.unseen()[c] == pytest.approx(1)


def test_gradient_is_that_of_the_objective():
    model, r = random_model(2), np.random.default_rng(3)
    noise = r.random(CLASSES) + 0.1
    noise /= noise.sum()
    cells = np.sort(r.choice(CLASSES**2, 50, replace=False))
    n = r.integers(1, 9, 50).astype(float)
    _, gradient = lbl.noise_contrast(model, noise, 5, cells, n)
    for a, g in zip(model.arrays(), gradient, strict=True):
        for at in (np.unravel_index(i, a.shape) for i in np.argsort(-np.abs(g).ravel())[:6]):
            was = a[at]
            around = []
            for d in (1e-5, -1e-5):
                a[at] = was + d
                around.append(lbl.noise_contrast(model, noise, 5, cells, n)[0])
            a[at] = was
            assert g[at] == pytest.approx((around[0] - around[1]) / 2e-5, rel=1e-4, abs=1e-4)


def test_held_out_texts_gain(spark):
    """Two languages in the corpus: the model scores held-out texts above single-word counts, and well above shuffled ones."""
    a, b = "red blue green sky sea sun".split(), "uno dos tres cuatro cinco seis".split()
    rows = []
    for i in range(300):
        words = (a, b)[i % 2]
        rows.append((i, " ".join(words[(i * 7 + j + (i * j) % 2) % 6] for j in range(60)), "x", "s", 0))
    mixed = [(1000 + i, " ".join((a, b)[(i + j) % 2][(j * 5) % 6] for j in range(60)), "x", "s", 0) for i in range(9)]
    found = scored(docs_of(spark, rows + mixed), F.col("doc_id").isin(*range(0, 300, 9), *range(1000, 1009))).collect()
    whole = [r for r in found if r["held_out"] and r["doc_id"] < 1000]
    assert all(r["score"] > r["base_score"] + 15 for r in whole)
    assert max(r["score"] for r in found if r["doc_id"] >= 1000) < min(r["score"] for r in whole)
