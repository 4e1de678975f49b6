"""A training corpus from the documents table, in stages; each result is written and read by the next.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``. Null texts
count as empty; empty tables pass through; further columns of ``docs`` are kept.

* quality rules: documents that the base rules or the compression bands reject go.
* line dedup: later repeats of line runs are deleted, ``n_chars`` is counted anew, and documents of
  which only white space is left go.
* n-gram Jaccard join: of each class of near duplicates the document with the smallest id stays.
* mixing sources: documents as the mix takes them, one row per pass over the source.
* best-fit packing: pieces of documents and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bindery.llm import jaccard, linededup, mixing, packing, quality
from bindery.llm.common import materialize, read_table


def quality_rules(spark, docs, sf_dir):
    return quality.keep_quality(docs)


def line_dedup(spark, docs, sf_dir):
    done = linededup.drop_repeated_lines(docs).filter((F.col("_dedup.removed") == 0) | linededup.is_filled("text"))
    changed = F.when(F.col("_dedup.removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return done.select(*[(changed.cast(t) if c == "n_chars" else F.col(c)).alias(c) for c, t in docs.dtypes])


def jaccard_join(spark, docs, sf_dir):
    return jaccard.one_of_each(docs)


def source_mix(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def best_fit_packing(spark, docs, sf_dir):
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]
#: Compressed sizes, drawn shards and token ids have no SQL form; the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
