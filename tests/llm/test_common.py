import random

from bindery.llm.common import components, materialize, ranked_rows


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def test_ranks_are_gapless_whatever_the_parts(spark):
    rows = spark.createDataFrame([(i % 2 if i % 3 else None, i) for i in range(200)], "g int, i int")
    table = materialize(rows.fillna({"g": 7}), "ranks")
    for parts in (1, 5):
        got = {}
        for r in ranked_rows(table, ["g"], ["i"], "at", parts).collect():
            got.setdefault(r.g, []).append(r["at"])
        assert all(sorted(v) == list(range(len(v))) for v in got.values())
