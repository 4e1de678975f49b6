import re
from collections import defaultdict

import numpy as np

from bindery.llm import mixing
from bindery.llm.common import materialize
from tests.llm.cases import docs_of, empty, odd_docs, odd_rows, prose

WORD = re.compile(mixing.WORD)


def size(text):
    return len(WORD.findall(text or ""))


def targets(sizes, weights=(5, 2, 1), factor=1.5, cap=2.0):
    """Share out, bound, and share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = factor * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        got = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if got[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else got[s] for s in names}
        capped |= over


def by_source(rows):
    out = defaultdict(int)
    for r in rows:
        out[r[3]] += size(r[1])
    return dict(out)


def test_targets_are_shared_out_anew(spark):
    for sizes in ({"a": 1000, "b": 10, "c": 500, None: 700, "é": 1}, {"a": 5}, {"a": 100, "b": 0}, {"z": 0}):
        rows = [(s, n) for s, n in sizes.items()]
        table = spark.createDataFrame(rows, "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(table).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 1, 99):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (5, 6))
    assert (a != b).mean() > 0.9


def rows_of_sources():
    return [(i, prose(i, 10 + 7 * (i % 9)), "en", ("big", "big", "mid", "small", None)[i % 5], 1) for i in range(60)]


def test_taken_words_meet_targets_and_reruns_agree(spark):
    rows = rows_of_sources()
    docs = docs_of(spark, rows)
    options = {"block_words": 16, "slots_per_shard": 64}
    got = mixing.taken_words(docs, **options).collect()
    want, sizes = targets(by_source(rows)), by_source(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size(rows[r.doc_id][1]) and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 48
    again = mixing.taken_words(docs.repartition(5), **options).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_blocks_hold_every_word_once_and_shards_draw_all_sources(spark):
    rows = rows_of_sources()
    table = materialize(mixing.sized(docs_of(spark, rows)).drop("text"), "t")
    goal = mixing.source_targets(table)
    words = defaultdict(list)
    for r in mixing.block_spans(table, goal, 16).collect():
        words[r.doc_id] += range(r.first_word, r.first_word + r.n_words)
    assert {d: sorted(w) for d, w in words.items()} == {r[0]: list(range(size(r[1]))) for r in rows}
    slots = mixing.draw_slots(table, goal, 16, 64, 0).collect()
    passes = defaultdict(set)
    for s in slots:
        assert (s.source_no, s.epoch, s.block) not in passes[0]
        passes[0].add((s.source_no, s.epoch, s.block))
    shards = defaultdict(set)
    for s in slots:
        shards[s.shard].add(s.source_no)
    assert len(shards) > 5 and max(map(len, shards.values())) == 4


def test_mixed_documents_hold_the_words_taken(spark):
    docs = odd_docs(spark)
    options = {"block_words": 16, "slots_per_shard": 32}
    mixed = mixing.mixed_documents(docs, **options)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    texts = {}
    for r in odd_rows():
        texts.setdefault(r[0], set()).update(WORD.findall(r[1] or ""))
    for r in mixed.collect():
        got[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text) and set(WORD.findall(r.text)) <= texts[r.doc_id]
    want = defaultdict(int)
    for r in mixing.taken_words(docs, **options).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_odd_and_empty_tables(spark):
    rows = mixing.taken_words(odd_docs(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.taken_words(empty(spark)).count() == mixing.mixed_documents(empty(spark)).count() == 0
    blank = docs_of(spark, [(1, None, None, None, None), (2, " ", "en", "a", 1)])
    assert [r.taken for r in mixing.taken_words(blank).collect()] == [0, 0]
    assert mixing.mixed_documents(blank).count() == 0
