"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import divergence, fingerprint, jaccard, lbl, linededup, mixing, negatives, oracles, packing, quality, quotes, secrets, spans, warc
from bindery.llm.common import read_table


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, sf_dir, "documents"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back."""
    return warc.page_records(warc.write_warc(read_table(spark, sf_dir, "pages")))


def paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(read_table(spark, sf_dir, "documents"))


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.deduplicated(read_table(spark, sf_dir, "documents"))


def quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mail: each turn quotes the two before it, nested; linked, unquoted and put in reply order again."""
    found = quotes.conversations(quotes.quoting(read_table(spark, sf_dir, "conversations")))
    as_ids = [F.col(a).cast("long").alias(b) for a, b in (("group", "conv_id"), ("number", "turn"))]
    ends = [F.col(f"{a}_{b}").cast("long").alias(f"{a}_{c}") for a in ("reply_to", "thread") for b, c in (("group", "conv"), ("number", "turn"))]
    return found.select(*as_ids, *ends, "depth", "n_quotes", "n_linked", "text")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository and its source for the owner."""
    return secrets.scan_report(read_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("source"))


def shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(read_table(spark, sf_dir, "documents"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read_table(spark, sf_dir, "documents"))


def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_metrics(read_table(spark, sf_dir, "documents"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.scored(read_table(spark, sf_dir, "documents"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def hard_negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; labels of ids divisible by 7 are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bin_completion": packed,
    "op2_warc_round_trip": warc_round_trip,
    "op3_paragraph_sketch": paragraph_sketches,
    "op4_winnowed_lines": line_runs,
    "op5_sentence_spans": sentence_spans,
    "op6_quotation_threads": quotation_threads,
    "op7_secret_ownership": secret_scan,
    "op8_lsh_forest_join": shingle_join,
    "op9_source_mix": source_mix,
    "op10_compression_bands": quality_bands,
    "op11_log_bilinear": model_scores,
    "op12_term_tree_audit": source_divergence,
    "op13_window_negatives": hard_negative_rows,
}
ORACLES: dict[str, str] = oracles.ORACLES
