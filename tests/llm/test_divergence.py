"""Divergence of sources against loops, and the tree against sums over terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from bindery.llm import divergence
from bindery.llm.divergence import PairSums, TermTree
from tests.llm.cases import docs_of, empty, odd_docs, odd_rows

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_loops(rows, min_docs):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = [t.translate(LOWER) for t in TERM.findall(text)]
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    key = lambda x: (-x[0], x[1].encode())
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (n[s] + 5 * len(kept)) for t in kept} for s in sources}
        total = sum(n.values())
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 5) // (total + 5 * len(kept)) for t in kept}
        for s in sources:
            far = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=key)
            own = sorted(((p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=key)[:50]
            for part, found in (("pair", far), ("term", own)):
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in divergence.divergence(df, **kw).collect())


def random_docs(seed, n, sources, words):
    r = random.Random(seed)
    names = [f"s{i}" for i in range(sources)] + ["Z", "é"]
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)] + ["Ünder", "ünder", "MIXED", "mixed", "😀"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        text = r.choice([" ", "\n", ", ", "1"]).join(r.choices(vocabulary, weights, k=r.randint(0, 40)))
        rows.append((i, text, r.choice(["en", "en", "de"]), r.choice(names), 0))
    return rows


@pytest.mark.parametrize(("seed", "held"), [(1, 10**6), (2, 50)])
def test_against_loops(spark, monkeypatch, seed, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "HELD_PAIRS", held // 10)
    rows = random_docs(seed, 300, 6, 120)
    assert got(docs_of(spark, rows).repartition(4)) == by_loops([r[1:4] for r in rows], 30) != []
    assert got(docs_of(spark, rows).repartition(4), min_docs=2) == by_loops([r[1:4] for r in rows], 2)


def test_odd_rows(spark):
    rows = [r[1:4] for r in odd_rows()]
    for min_docs in (1, 2, 100):
        assert got(odd_docs(spark), min_docs=min_docs) == by_loops(rows, min_docs)
    assert got(empty(spark)) == []


def test_one_source_holds_nearly_all(spark):
    rows = random_docs(3, 200, 1, 60)
    rows = [(i, t, "en", "hot" if i % 40 else s, n) for i, t, _, s, n in rows]
    assert got(docs_of(spark, rows)) == by_loops([r[1:4] for r in rows], 30)


def test_ties_go_by_utf8(spark):
    rows = [(i, "x y z", "en", s, 0) for i, s in enumerate(["a", "b", "B", "é", "z"] * 30)]
    found = got(docs_of(spark, rows))
    assert [r[3] for r in found if r[1] == "a" and r[2] == "pair"] == ["B", "b", "z", "é"]
    assert {r[4] for r in found} == {0}


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, kinds long")
    value = df.select(divergence.share("n", "total", "kinds", 5, 10**9)).first()[0]
    assert value == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35)


def test_tree_adds_once_for_each_node_and_ancestor(monkeypatch):
    r = random.Random(5)
    zero = {s: r.randint(1, 50) for s in "abcdef"}
    rows = Counter()
    for _ in range(300):
        rows[tuple((s, r.choice((60, 70)), zero[s]) for s in "abcdef" if r.random() < 0.5)] += r.randint(1, 3)
    wanted = Counter()
    for row, times in rows.items():
        for i, (b, pb, zb) in enumerate(row):
            for a, pa, za in row[:i]:
                wanted[a, b] += times * (abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb))
    calls = []
    sums = PairSums()
    add = sums.add
    monkeypatch.setattr(sums, "add", lambda later, earlier, values: (calls.append(len(earlier)), add(later, earlier, values)))
    tree = TermTree(sums)
    for row, times in sorted(rows.items()):
        tree.insert(list(row), times)
    tree.leave(0)
    names = list(sums.number)
    found = {(names[i], names[j]): int(v) for j, line in sums.rows.items() for i, v in enumerate(line) if v}
    assert found == {k: v for k, v in wanted.items() if v}
    # shared beginnings are counted once: as many calls as nodes below the first level
    nodes = {row[:i] for row in rows for i in range(2, len(row) + 1)}
    assert len(calls) == len(nodes) < sum(max(len(row) - 1, 0) for row in rows)
