"""Mixing sources to target weights in fixed-length blocks.

The words of a source, its documents one after another, are cut into blocks of equal length.
Targets come from the weights, bounded by a multiple of the source and shared out anew until none
is above. Every output shard draws how many of its slots each source gets from a multinomial with
its own seed; running totals over shards number a source's slots, and what the draws leave short
of the source's quota goes to one last shard, what exceeds it is left out, so totals are exact.
A slot's number is mapped through the source's pseudorandom permutation of block numbers, one for
each pass over the source, and joined to the blocks by index.

Sources are counted, weighted and held by the driver: their number is that of the weights a user
assigns. Documents, blocks and slots never pass it.

Defined cases: a null or empty text has size 0 and nothing is taken of it; sources follow code
point order, a null source is one source and comes last; a repeated row is a document of its own;
rows equal in ``doc_id`` and text are interchangeable; an empty table gives an empty result; other
columns are ignored by ``mix`` and passed on by ``mixed_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import materialize, numbered, per_batch
from bindery.operators.scan import ordered_scan

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 128
SLOTS_PER_SHARD = 4096


def sized(docs: DataFrame) -> DataFrame:
    """``uid, doc_id, source, text_key, size`` and the other columns given; for writing before use."""
    text = F.coalesce("text", F.lit(""))
    return numbered(docs).withColumns({"size": F.regexp_count(text, F.lit(WORD)).cast("long"), "text_key": F.xxhash64(text)})


def source_targets(table: DataFrame, weights: Sequence[float] = (5, 2, 1), factor: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_no, source_size, target``: one row per source.

    Sorted by cap over weight, the capped sources come first: a row is capped when the level that
    the rest would get is not below its own. The first uncapped row's level holds for all after it.
    """
    sizes = table.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn(
        "_w", F.element_at(given, F.col("source_no") % len(weights) + 1)
    )
    most = F.lit(float(cap)) * F.col("source_size")
    order = Window.orderBy("_ratio", "source_no")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        named.withColumn("_ratio", most / F.col("_w"))
        .withColumn("_all", F.lit(float(factor)) * F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / F.sum("_w").over(after))
    )
    level = F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(everything)
    return levels.withColumn("_final", level).select(
        "source", "source_no", "source_size", F.least(most, F.coalesce(F.col("_final") * F.col("_w"), most)).alias("target")
    )


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of ``0 … n - 1`` chosen by ``key``, element by element: Feistel rounds, walked back into range."""
    bits = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x, m, b, k = out[todo], mask[todo], bits[todo], key[todo].astype(np.uint64)
        left, right = x >> b, x & m
        for r in range(4):
            h = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & m)
        out[todo] = (left << b) | right
        todo[todo] = out[todo] >= n[todo].astype(np.uint64)
    return out.astype(np.int64)


def draw_slots(table: DataFrame, targets: DataFrame, block_words: int, slots_per_shard: int, seed: int) -> DataFrame:
    """``shard, source_no, epoch, block``: a row per slot, the block it shows and the pass over the source."""
    spark = table.sparkSession
    plan = []
    for r in sorted(targets.collect(), key=lambda r: r["source_no"]):
        blocks = -(-r["source_size"] // block_words)
        plan.append((r["source_no"], blocks, round(r["target"] / r["source_size"] * blocks) if blocks else 0))
    quotas = np.array([q for _, _, q in plan], np.int64)
    slots = int(quotas.sum())
    shards = -(-slots // slots_per_shard)
    counts_schema = "shard long, source_no int, drawn long"

    def rows(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"shard": [], "source_no": [], "drawn": []}
        for shard in columns["id"]:
            size = min(slots_per_shard, slots - shard * slots_per_shard)
            counts = np.random.default_rng([seed, shard]).multinomial(size, quotas / slots)
            used = np.flatnonzero(counts)
            out["shard"] += [shard] * len(used)
            out["source_no"] += used.tolist()
            out["drawn"] += counts[used].tolist()
        return out

    drawn = materialize(per_batch(spark.range(shards), counts_schema, rows), "draws")
    totals = spark.createDataFrame(plan, "source_no int, blocks long, quota long") if plan else spark.createDataFrame([], "source_no int, blocks long, quota long")
    # one row per source: bounded by the weights
    started = ordered_scan(drawn, ["source_no"], [F.col("shard")], sums={"start": F.col("drawn")}).join(F.broadcast(totals), "source_no")
    inside = started.select(
        "shard", "source_no", "blocks", F.col("start").alias("lo"), F.least(F.col("start") + F.col("drawn"), F.col("quota")).alias("hi")
    )
    done = drawn.groupBy("source_no").agg(F.sum("drawn").alias("done"))
    short = totals.join(done, "source_no", "left").select(
        F.lit(shards).cast("long").alias("shard"), "source_no", "blocks", F.coalesce("done", F.lit(0)).alias("lo"), F.col("quota").alias("hi")
    )
    # the last shard's share may be long for a small corpus only: it is what draws leave over
    ranges = inside.unionByName(short).filter("lo < hi")

    @F.pandas_udf("long")
    def block_of(source: pd.Series, slot: pd.Series, n: pd.Series) -> pd.Series:
        s, i, m = (x.to_numpy(np.int64) for x in (source, slot, n))
        key = (s + 1) * 1_000_003 + (i // m) * 7_919 + seed
        return pd.Series(permuted(i % m, m, key))

    each = ranges.withColumn("slot", F.explode(F.sequence("lo", F.col("hi") - 1)))
    return each.select("shard", "source_no", F.floor(F.col("slot") / F.col("blocks")).alias("epoch"), block_of("source_no", "slot", "blocks").alias("block"))


def block_spans(table: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """``source_no, block, uid, doc_id, first_word, n_words``: the parts of documents that make up each block."""
    narrow = table.select("uid", "doc_id", "source", "text_key", "size").filter("size > 0")
    order = [F.col(c).asc_nulls_last() for c in ("doc_id", "text_key", "uid")]
    placed = ordered_scan(narrow, ["source"], order, sums={"start": F.col("size")})
    # one row per source
    named = F.broadcast(targets.select(F.col("source").alias("_source"), "source_no"))
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)
    each = placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(end, (F.col("block") + 1) * block_words)
    return each.select("source_no", "block", "uid", "doc_id", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("n_words"))


def mix(
    table: DataFrame,
    targets: DataFrame,
    block_words: int = BLOCK_WORDS,
    slots_per_shard: int = SLOTS_PER_SHARD,
    seed: int = 0,
) -> DataFrame:
    """``shard, source_no, epoch, block, uid, doc_id, first_word, n_words``: the mix as parts of documents.

    ``table`` is a written result of ``sized``, ``targets`` that of ``source_targets``.
    """
    slots = draw_slots(table, targets, block_words, slots_per_shard, seed)
    return slots.join(block_spans(table, targets, block_words), ["source_no", "block"])


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` (words the mix takes, repeats counted)."""
    table = materialize(sized(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    targets = materialize(source_targets(table), "targets")
    taken = mix(table, targets, **options).groupBy("uid").agg(F.sum("n_words").alias("taken"))
    named = F.broadcast(targets.withColumnRenamed("source", "_source"))
    return (
        table.join(taken, "uid", "left")
        .join(named, F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: for each pass over a source, every document cut to the words taken.

    A document taken whole keeps its text; parts are joined by a line break. ``n_chars`` is counted anew where given.
    """
    columns = docs.columns
    held = F.struct(*[F.col(c) for c in columns]).alias("_row")
    whole = materialize(sized(docs.select("doc_id", "source", "text", held)).drop("text"), "mix-documents")
    narrow = whole.select("uid", "doc_id", "source", "text_key", "size")
    targets = materialize(source_targets(narrow), "targets")
    spans = mix(narrow, targets, **options)
    # the parts of one document in one pass: bounded by its own length
    parts = spans.groupBy("uid", "epoch").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("parts"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, size: pd.Series, parts: pd.Series) -> pd.Series:
        word = re.compile(WORD)
        out = []
        for t, n, spans in zip(text, size, parts, strict=True):
            if sum(s["n_words"] for s in spans) == n:
                out.append(t)
                continue
            ends = [m.span() for m in word.finditer(t)]
            runs: list[list[int]] = []
            for s in spans:
                if runs and runs[-1][1] == s["first_word"]:
                    runs[-1][1] += s["n_words"]
                else:
                    runs.append([s["first_word"], s["first_word"] + s["n_words"]])
            out.append("\n".join(t[ends[a][0] : ends[b - 1][1]] for a, b in runs))
        return pd.Series(out)

    made = whole.join(parts, "uid").withColumn("_cut", cut(F.col("_row.text"), "size", "parts"))
    changed = {"text": F.col("_cut"), "n_chars": F.length("_cut").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return made.select(*[(changed[c] if c in changed else F.col("_row")[c]).alias(c) for c in columns])
