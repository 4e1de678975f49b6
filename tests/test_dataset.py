"""The dataset's commit, its partial writes, incremental builds, and outlines with any number of levels."""

import random

import pytest
from pyspark.sql import functions as F

from bindery.operators.outline import parents_by_level
from bindery.plans.corpus import build_book_corpus
from bindery.plans.incremental import changed_sites, site_digests, update_book_corpus
from bindery.sources import html as H
from bindery.sources.sinks import drop_old_versions, newest_manifest, read_book_table, write_book_dataset


def rows_of(spark, path, name):
    return sorted((tuple(r) for r in read_book_table(spark, str(path), name).drop("site_bucket").collect()), key=str)


def test_many_tasks_write_few_files(spark, tmp_path):
    table = spark.range(400).selectExpr("'s' || id % 9 as site", "id").repartition(40)
    write_book_dataset({"t": table}, str(tmp_path), buckets=4)
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 4
    assert read_book_table(spark, str(tmp_path), "t").count() == 400


def test_a_hot_site_is_spread_by_bytes(spark, tmp_path):
    df = spark.range(0, 20000, numPartitions=4).selectExpr("if(id < 10, 'cold', 'hot') site", "sha2(string(id), 512) text")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        write_book_dataset({"t": df}, str(tmp_path), buckets=2)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert len(list((tmp_path / "t").rglob("*.parquet"))) >= 4


def test_a_write_which_fails_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "site string, n int")
    write_book_dataset({"one": df, "two": df}, str(tmp_path), buckets=4)
    broken = df.withColumn("n", F.when(F.col("site") == "b", F.raise_error(F.lit("half-way")).cast("int")).otherwise(7))
    with pytest.raises(Exception, match="half-way"):
        write_book_dataset({"one": df.withColumn("n", F.lit(9)), "two": broken}, str(tmp_path), buckets=4)
    assert (tmp_path / "one").is_dir() and newest_manifest(spark, str(tmp_path)).number == 1
    assert rows_of(spark, tmp_path, "one") == rows_of(spark, tmp_path, "two") == [("a", 1), ("b", 2)]
    write_book_dataset({"one": df.withColumn("n", F.lit(9)), "two": df}, str(tmp_path), buckets=4)
    assert rows_of(spark, tmp_path, "one") == [("a", 9), ("b", 9)]
    drop_old_versions(spark, str(tmp_path))
    assert len(list((tmp_path / "one").glob("v=*"))) == 1 and rows_of(spark, tmp_path, "two") == [("a", 1), ("b", 2)]


def test_a_later_write_does_not_overwrite_a_commit(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "site string, n int")
    write_book_dataset({"t": df}, str(tmp_path), buckets=4)

    class Meanwhile(dict):
        def items(self):
            write_book_dataset({"t": df.withColumn("n", F.lit(5))}, str(tmp_path), buckets=4)
            return super().items()

    with pytest.raises(RuntimeError, match="another write"):
        write_book_dataset(Meanwhile(t=df.withColumn("n", F.lit(6))), str(tmp_path), buckets=4)
    assert rows_of(spark, tmp_path, "t") == [("a", 5)]


def test_some_sites_are_replaced_and_others_stay(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", i) for i in range(40)], "site string, n int")
    write_book_dataset({"t": df}, str(tmp_path), buckets=4)
    sites = spark.createDataFrame([("s3",), ("s7",), ("new",)], "site string")
    write_book_dataset({"t": spark.createDataFrame([("s3", 100), ("new", 101)], "site string, n int")}, str(tmp_path), buckets=4, sites=sites)
    wanted = sorted([(f"s{i}", i) for i in range(40) if i not in (3, 7)] + [("s3", 100), ("new", 101)])
    assert rows_of(spark, tmp_path, "t") == sorted(wanted, key=str)
    gone = spark.createDataFrame([(f"s{i}",) for i in range(40)] + [("new",)], "site string")
    write_book_dataset({"t": df.limit(0)}, str(tmp_path), buckets=4, sites=gone)
    assert rows_of(spark, tmp_path, "t") == []
    with pytest.raises(ValueError, match="buckets"):
        write_book_dataset({"t": df}, str(tmp_path), buckets=8, sites=sites)


TEXT = "<p>" + "Words of a page that is long enough to be kept. " * 3 + "</p>"
SCHEMA = "site string, page_id long, url string, html string"


def page(site, i, title, text=TEXT):
    return (site, i, f"https://{site}/{i}", f"<title>{title}</title><article><h1>{title}</h1>{text}</article>")


def test_digests_do_not_depend_on_order_and_tell_changes(spark):
    rows = [page("a", 1, "One"), page("a", 2, "Two"), page("b", 3, "Three"), page("c", 4, None), ("d", 5, None, None)]
    now = site_digests(spark.createDataFrame(rows, SCHEMA).repartition(4))
    again = site_digests(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2))
    assert changed_sites(now, again).collect() == []
    other = [page("a", 1, "Two"), page("a", 2, "One"), rows[2], rows[2], rows[3], ("d", 5, None, "")]
    assert sorted(r.site for r in changed_sites(site_digests(spark.createDataFrame(other, SCHEMA)), now).collect()) == ["a", "b", "d"]
    fewer = site_digests(spark.createDataFrame(rows[:2] + [page("e", 9, "New")], SCHEMA))
    assert sorted(r.site for r in changed_sites(fewer, now).collect()) == ["b", "c", "d", "e"]


def test_only_changed_sites_are_built_again(spark, tmp_path, monkeypatch):
    first = [page("a", 1, "One"), page("a", 2, "Two"), page("b", 3, "Three"), page("c", 4, "Four"), page("bad", 7, "x", "")]
    second = [page("a", 1, "One"), page("a", 2, "Changed"), page("a", 8, "More"), first[2], first[4], page("d", 6, "New")]
    path = str(tmp_path / "inc")
    assert sorted(r.site for r in update_book_corpus(spark.createDataFrame(first, SCHEMA), path, buckets=4).collect()) == ["a", "b", "bad", "c"]
    seen = []
    built = build_book_corpus

    def watched(pages, **options):
        seen.extend(r.site for r in pages.select("site").distinct().collect())
        return built(pages, **options)

    monkeypatch.setattr("bindery.plans.incremental.build_book_corpus", watched)
    pages = spark.createDataFrame(second, SCHEMA)
    assert sorted(r.site for r in update_book_corpus(pages, path, buckets=4).collect()) == ["a", "c", "d"]
    assert sorted(seen) == ["a", "d"]  # the pages of "b" and "bad" are not shredded, "c" is gone
    full = str(tmp_path / "full")
    write_book_dataset(vars(built(pages)), full, buckets=4)
    for name in vars(built(pages)):
        assert rows_of(spark, path, name) == rows_of(spark, full, name), name
    before = newest_manifest(spark, path)
    assert update_book_corpus(pages, path, buckets=4).collect() == []
    assert newest_manifest(spark, path) == before


def by_loops(levels):
    out = []
    for i, level in enumerate(levels):
        chain, want = [], level
        for j in range(i - 1, -1, -1):
            if levels[j] < want:
                chain.append(j)
                want = levels[j]
        out.append((f"e{chain[0]}" if chain else None, len(chain)))
    return out


@pytest.mark.parametrize("limit", [None, 40])
def test_parents_with_many_levels(spark, limit):
    r = random.Random(3)
    sites = {
        "deep": [r.randint(0, 100) for _ in range(300)],
        "rising": list(range(90)),
        "falling": list(range(90, 0, -1)),
        "flat": [2] * 30,
        "few": [0, 3, 1],
    }
    rows = [(s, i, f"e{i}", i, level) for s, levels in sites.items() for i, level in enumerate(levels)]
    df = spark.createDataFrame(rows, "site string, page_id long, id string, order int, level int").repartition(5)
    got = {(x.site, x.order): (x.parent_id, x.depth) for x in parents_by_level(df, limit).collect()}
    assert got == {(s, i): want for s, levels in sites.items() for i, want in enumerate(by_loops(levels))}


def test_the_plan_does_not_grow_with_the_levels(spark):
    def size(levels):
        df = spark.range(levels).selectExpr("'s' site", "id page_id", "string(id) id", "int(id) `order`", "int(id) level")
        return len(parents_by_level(df)._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert size(5) == size(100)
    assert H.MAX_LEVELS > 100
