"""Bring a written corpus up to date by rebuilding only the sites whose pages have changed.

A site's books depend on nothing but its own pages. So its pages are summed up in a digest which does
not depend on their order, and sites whose digest is that of the last state are left as they are: their
pages are hashed, but neither shredded nor shuffled. Digests are a table of the dataset and are committed
with the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.plans.corpus import build_book_corpus
from bindery.session import materialize, materialize_counted
from bindery.sources.sinks import SITE_BUCKETS, newest_manifest, read_book_table, write_book_dataset


def site_digests(pages: DataFrame) -> DataFrame:
    """``site, n_pages, digest``: equal for equal sets of pages, whatever their order or partitions.

    Two independent sums over hashes of the pages, as decimals that do not overflow; summed map-side.
    """
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ("page_id", "url", "html")]
    one, two = F.xxhash64(*fields), F.xxhash64(F.lit(1), *fields)
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    sums = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"), total(one).alias("a"), total(two).alias("b"))
    return sums.select("site", "n_pages", F.concat_ws(":", "a", "b").alias("digest"))


def changed_sites(now: DataFrame, before: DataFrame) -> DataFrame:
    """Sites which are new, have other pages than before, or are gone."""
    old = before.select("site", F.col("n_pages").alias("_n"), F.col("digest").alias("_digest"))
    both = now.join(old, "site", "full")
    same = F.col("n_pages").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_digest"))
    return both.filter(~same).select("site")


def update_book_corpus(pages: DataFrame, path: str, buckets: int = SITE_BUCKETS, **options) -> DataFrame:
    """Build the corpus of ``pages`` into the dataset at ``path``; returns the sites that were rebuilt.

    The first build, or one after a change of ``options``, has to go to a new folder: digests tell of
    pages only. ``seeds`` and ``given`` may hold further sites.
    """
    spark = pages.sparkSession
    now = materialize(site_digests(pages), "digests")
    if newest_manifest(spark, path) is None:
        write_book_dataset(vars(build_book_corpus(pages, **options)) | {"digests": now}, path, buckets)
        return now.select("site")
    changed, n = materialize_counted(changed_sites(now, read_book_table(spark, path, "digests").drop("site_bucket")), "changed")
    if n:
        corpus = build_book_corpus(pages.join(changed, "site", "left_semi"), **options)
        digests = now.join(changed, "site", "left_semi")
        write_book_dataset(vars(corpus) | {"digests": digests}, path, buckets, sites=changed)
    return changed
