"""Page tables: one row per fetched page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions.urls import url_origin


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by a unique key when there are fewer tasks than cores.

    A file is cut at its row groups only, so one small file is one task; an input
    with enough of them is left as it was read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_pages(spark: SparkSession, path: str, site: Column | None = None) -> DataFrame:
    """Read ``page_id, url, html`` and derive ``site``, by default the URL's origin."""
    df = spread(spark.read.parquet(path).select("page_id", "url", "html"), "page_id")
    site = F.coalesce(url_origin(F.col("url")), F.lit("")) if site is None else site
    return df.select(site.alias("site"), "page_id", "url", "html")
