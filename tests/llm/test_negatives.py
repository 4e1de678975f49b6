"""Hard negatives against loops over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from bindery.llm import negatives
from bindery.llm.negatives import hard_negatives
from bindery.llm.queries import hard_negative_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_loops(rows, every=10, positives=5, count=5, percent=80):
    sound = []
    for uid, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((uid, i, [math.floor(256 * x) for x in v], label))
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for uid, i, v, label in sound:
        if i is None or i % every:
            continue
        pairs = sorted(
            (order(sum(a * b for a, b in zip(v, w, strict=False)), j), other == label, j) for u, j, w, other in sound if u != uid
        )
        scored = [(-key[0], same, j) for key, same, j in pairs]
        for top, same, p in [x for x in scored if x[1]][:positives]:
            inside = [(s, j) for s, other, j in scored if not other and percent * top <= 100 * s <= 100 * top]
            out += [(i, p, r, j, top, s) for r, (s, j) in enumerate(inside[:count], 1)]
    return sorted(out, key=str)


def got(spark, rows, every=10, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hard_negatives(df, F.col("vec_id") % every == 0, **kw)
    return sorted((tuple(r) for r in found.collect()), key=str)


def random_rows(seed, n, dim, labels, grid=None):
    r = random.Random(seed)
    value = (lambda: r.choice(grid)) if grid else (lambda: r.gauss(0, 0.2))
    # exact in single precision
    return [(i, [round(value() * 4096) / 4096 for _ in range(dim)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "dim", "labels", "grid"), [(1, 300, 8, 3, None), (2, 200, 2, 2, (0, 0.25, 0.5)), (3, 60, 4, 40, None)])
def test_against_loops(spark, monkeypatch, seed, n, dim, labels, grid):
    monkeypatch.setattr(negatives, "PART_BYTES", 8 * dim * 37)
    monkeypatch.setattr(negatives, "CHUNK_BYTES", 8 * dim * 4)
    monkeypatch.setattr(negatives, "TILE_SCORES", 50)
    rows = random_rows(seed, n, dim, labels, grid)
    assert got(spark, rows) == by_loops(rows) != []


def test_odd_rows(spark):
    rows = random_rows(4, 80, 4, 3) + [
        (90, None, 1),
        (100, [0.5, None, 0.5, 0.5], 1),
        (110, [0.5, float("nan"), 0.5, 0.5], 1),
        (120, [0.5, float("inf"), 0.5, 0.5], 1),
        (130, [0.5, 0.5, 0.5, 0.5], None),
        (None, [0.5, 0.5, 0.5, 0.5], 1),
        (None, [0.5, 0.5, 0.5, 0.5], 2),
        (140, [0.5, 0.5], 1),  # shorter
        (150, [0.25] * 9, 2),  # longer
        (160, [], 0),
        (170, [0.5, 0.5, 0.5, 0.5], 1),
        (170, [0.5, 0.5, 0.5, 0.5], 1),  # a repeated anchor
        (-10, [-0.5, 0.5, -0.5, 0.5], 1),
    ]
    assert got(spark, rows) == by_loops(rows)


def test_large_group_of_equal_vectors(spark):
    rows = [(i, [0.5, 0.5], i % 2) for i in range(400)]
    found = got(spark, rows, every=100)
    assert found == by_loops(rows, every=100)
    assert len(found) == 4 * 5 * 5


def test_large_components(spark):
    rows = [(i, [float(2 ** (14 + i % 9)), 3.0], i % 3) for i in range(40)]
    assert got(spark, rows) == by_loops(rows)
    beyond = [(i, [1e30], i % 2) for i in range(12)]
    assert {r[4:] for r in got(spark, beyond)} == {(2**63 - 1, 2**63 - 1)}


def test_other_counts(spark):
    rows = random_rows(5, 120, 4, 3)
    assert got(spark, rows, positives=2, negatives=7, percent=50) == by_loops(rows, positives=2, count=7, percent=50)


def test_empty_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(none, F.col("vec_id") % 10 == 0).collect() == []
    rows = [(*r, 1, "x", b"k", 0, 1) for r in random_rows(6, 300, 4, 3)]
    extra = f"{SCHEMA}, uid int, key string, vec binary, _part int, anchor int"
    spark.createDataFrame(rows, extra).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = hard_negative_rows(spark, str(tmp_path))
    shifted = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label, *_ in rows]
    assert sorted((tuple(r) for r in found.collect()), key=str) == by_loops(shifted, every=100)


def test_keys_sort_as_the_search_does():
    import numpy as np

    scores, ids = np.array([5, -3, 5, 7]), np.array([2, -1, 1, 9])
    keys = negatives.packed((100, 3), scores, 1, ids, np.zeros(4, np.uint8))
    read = [negatives.opened(k) for k in sorted(k.tobytes() for k in keys)]
    assert [(s, i) for _, s, _, i in read] == [(7, 9), (5, 1), (5, 2), (-3, -1)]
    assert read[0][0] == (100, 3)
