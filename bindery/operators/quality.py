"""Data quality: rejected rows are kept apart, or stop the job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Error codes.
ERROR_CODES = (
    "CRAWL_FAILED CRAWL_TIMEOUT PARSE_FAILED NORMALIZE_FAILED IMAGE_DOWNLOAD_FAILED EPUB_GENERATION_FAILED "
    "INVALID_URL INVALID_CONFIG NO_CHAPTERS_FOUND NO_CONTENT_FOUND BROWSER_ERROR"
).split()


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without, and rejected rows with, their ``error_code``."""
    return df.filter("error_code is null").drop("error_code"), df.filter("error_code is not null")


def fail_fast(df: DataFrame) -> DataFrame:
    """Good rows; the job fails with the code and URL of the first rejected row it meets.

    The check sits in a filter, so column pruning cannot drop it.
    """
    message = F.concat(F.lit("["), "error_code", F.lit("] (URL: "), F.coalesce("url", F.lit("")), F.lit(")"))
    ok = F.when(F.col("error_code").isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    return df.filter(ok).drop("error_code")
