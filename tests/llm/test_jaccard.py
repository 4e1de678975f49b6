import random

import numpy as np
import pytest

from bindery.llm import jaccard
from tests.llm.cases import docs_of, empty, odd_docs, odd_rows, prose


def runs(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, threshold=0.8):
    sets = [runs(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    names = {}
    for i, r in enumerate(rows):
        names.setdefault(find(i), []).append(r[0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    copies = [sum(b == a for b in sets) if a else 1 for a in sets]
    return sorted(((r[0], least[find(i)], links[i], copies[i]) for i, r in enumerate(rows)), key=str)


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def family_rows():
    rows, at = [], 0
    for f in range(8):
        base = prose(f, 40, 40)
        for i in range(1 + 5 * (f % 4)):
            rows.append((at, edited(base, i % 6, f * 100 + i), "en", "a", 1))
            at += 1
    rows += [(at + i, rows[3][1], "en", "a", 1) for i in range(4)]
    return rows


def check(docs, rows):
    got = sorted((tuple(r) for r in jaccard.linked_documents(docs).collect()), key=str)
    assert got == brute(rows)


def test_links_and_classes_against_all_pairs(spark):
    rows = family_rows()
    check(docs_of(spark, rows), rows)


def test_split_prefixes_and_blocks_lose_no_link(spark, monkeypatch):
    rows = family_rows()
    monkeypatch.setattr(jaccard, "PART_ROWS", 4)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 1500)
    check(docs_of(spark, rows), rows)


def test_odd_documents(spark):
    check(odd_docs(spark), odd_rows())
    one = jaccard.one_of_each(odd_docs(spark))
    assert one.columns == odd_docs(spark).columns
    want = {c for _, c, _, _ in brute(odd_rows()) if c is not None}
    ids = [r.doc_id for r in one.collect()]
    # empty texts are classes of their own, and both texts of id 9 stay
    assert sorted(i for i in ids if i is not None) == sorted([*want, 9])
    assert ids.count(None) == 1
    assert jaccard.linked_documents(empty(spark)).count() == jaccard.one_of_each(empty(spark)).count() == 0


def test_prefix_shortens_until_the_target():
    assert jaccard.prefix_depth(0.8) == 5
    assert jaccard.prefix_depth(0.99) == jaccard.DEPTH
    assert jaccard.prefix_depth(0.8, target=0.999) == 6
    assert jaccard.prefix_depth(0.01) == 1


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_signatures_estimate_jaccard(share):
    r = np.random.default_rng(1)
    common, own = r.integers(0, 1 << 63, 2000, dtype=np.uint64), r.integers(0, 1 << 63, 2000, dtype=np.uint64)
    n = int(2000 * share)
    rest = (2000 - n) // 2
    a = np.concatenate([common[:n], own[:rest]])
    b = np.concatenate([common[:n], own[1000 : 1000 + rest]])
    exact = n / (n + 2 * rest)
    assert abs((jaccard.signature(a) == jaccard.signature(b)).mean() - exact) < 0.15


def test_overlaps_are_exact():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, k).astype(np.uint64)) for k in (1, 5, 30, 60, 60)]
    for i, common in jaccard.overlaps(sets):
        assert common.tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]


def test_covered_texts_with_leaders_apart_are_one_family():
    r = np.random.default_rng(4)
    base = r.integers(0, 256, 144).astype(np.uint8)

    def moved(signs, n):
        out = signs.copy()
        out[r.choice(144, n, replace=False)] ^= 255
        return out

    x, y = base, moved(base, 28)  # alike by 0.8
    signs = np.stack([moved(x, 28), moved(y, 28), x, y])
    tails = np.array([[1], [2], [1], [2]], np.uint8)
    assert len(set(jaccard.rooted(jaccard.forest_pairs(np.arange(4), signs, tails)).values())) == 1


def test_the_bitmap_loses_no_key(spark):
    rows = [(i, f"text {i}", "en", "a", 1) for i in range(500)] + [(900, None, "en", "a", 1)]
    docs = docs_of(spark, rows)
    keys = docs.filter("doc_id % 7 = 0 or text is null").selectExpr("xxhash64(coalesce(text, '')) as text_key")
    got = sorted(r.text for r in jaccard.among(docs, keys).collect())
    assert got == sorted(["", *(f"text {i}" for i in range(0, 500, 7))])
