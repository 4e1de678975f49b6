"""Nodes by page: dealt into parts of bounded size, or stored so that every operator reads them without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.session import scratch_dir
from bindery.sources.html import KEY, html_nodes

# characters of HTML whose nodes one task sorts, and what a page counts at least
SLICE_CHARS = 4 << 20
PAGE_CHARS = 512


def page_slices(pages: DataFrame, html: str = "html") -> int:
    """Into how many parts the nodes of ``pages`` go, for a task to hold as many of them whatever the size of the table.

    Counted by the characters of the HTML, as nodes compress far better than they lie in memory: by the bytes of
    a shuffle, a task would get too many. ``pages`` is read once for it.
    """
    chars = pages.agg(F.sum(F.coalesce(F.length(html), F.lit(0)) + PAGE_CHARS)).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, chars // SLICE_CHARS + 1)


def by_page(nodes: DataFrame, slices: int | None) -> DataFrame:
    """``nodes`` dealt by page into ``slices`` parts; None leaves it to the session's shuffles."""
    return nodes if slices is None else nodes.repartition(slices, *KEY)


def bucketed_nodes(
    pages: DataFrame, html: str = "html", carry: tuple[str, ...] = (), buckets: int | None = None, name: str | None = None
) -> DataFrame:
    """The node table of ``pages`` as a table bucketed by page, one sorted file per bucket.

    Whatever groups, joins or looks along pages, which all node operators do, finds their rows together
    and shuffles nothing, in this job and in later ones that read the table by its ``name``. A bucket
    should fit a task: choose ``buckets`` by the size of the pages (default: the session's shuffle
    partitions). The files lie in the shared scratch area.
    """
    spark = pages.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"nodes_{uuid.uuid4().hex}"
    dealt = html_nodes(pages, html, carry).repartition(count, *[F.col(c) for c in KEY])
    writer = dealt.write.bucketBy(count, *KEY).sortBy(*KEY, "pos").option("path", f"{scratch_dir(spark)}/{name}")
    writer.saveAsTable(name)
    return spark.table(name)
