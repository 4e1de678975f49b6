"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from bindery.plans.queries import QUERIES
from bindery.session import get_spark

HEADLINE = (
    "html_nodes render_html nav_links link_audit canonical_pages remove_noise parse_pages normalize_pages "
    "fix_headings image_catalog create_chapters build_chapters resolve_duplicate_orders hierarchical_toc "
    "infer_metadata build_report next_chain book_corpus"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bindery-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    # start JVM, code generation and Python workers outside the timings
    QUERIES["parse_pages"](spark, sf_dir).limit(1).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "pages_per_sec": {n: round(pages / seconds[n], 1) for n in ("html_nodes", "parse_pages", "normalize_pages", "book_corpus")},
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
