"""Hard negatives of anchors by a secondary-sort shuffle of scored pairs.

Anchors meet the rows in cells of a grid: rows are dealt into parts and anchors into chunks by hash,
and a cell multiplies one part by one chunk. A pair which may count is packed into a key of fixed
length, (anchor, descending score, positives first, id), whose byte order is the order of an anchor's
search. ``repartitionAndSortWithinPartitions`` brings an anchor's keys into one task in that order,
and an iterator reads them once: a positive opens a window below its own score, a negative goes to
every window that still takes it. Nothing of an anchor is held but its open windows.

Two such shuffles are made. The first finds the positives. The second takes them and, of each cell,
the first negatives of every window, which are all that can be among the first of the whole table;
so the shuffle grows with anchors and parts, never with pairs, whatever the scores and ties are.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part;
a null id is never an anchor and comes last among equal scores; of vectors with different lengths the
shorter is filled up with zeros; repeated rows are rows of their own, so a repeated anchor gives its
results once per row and may have its copy as a positive; scores beyond 64 bits count as the largest
or smallest of 64; a positive with a score below zero has an empty window; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from bindery.llm.common import materialize, numbered

POSITIVES = 5
NEGATIVES = 5
#: a negative's score is between so many hundredths of the positive's and all of it
LOWEST_PERCENT = 80
#: bytes of doubles in a part of the rows and in a chunk of the anchors
PART_BYTES = 32 << 20
CHUNK_BYTES = 8 << 20
#: parts have this many rows at least, unless there are enough of them for all cores
LEAST_PART_ROWS = 1024
#: scores held at a time
TILE_SCORES = 4 << 20

TOP = 2**63 - 1
BASE = 2**63
KEY = ">QQQBBQ"
PACKED = np.dtype([("anchor", ">u8"), ("row", ">u8"), ("score", ">u8"), ("kind", "u1"), ("no_id", "u1"), ("id", ">u8")])
POSITIVE, NEGATIVE = 0, 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def unsigned(x: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones of the same order."""
    return x.astype(np.int64).view(np.uint64) ^ np.uint64(BASE)


def packed(anchor: tuple[int, int], scores: np.ndarray, kind: int, ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
    out = np.empty(len(scores), PACKED)
    out["anchor"], out["row"] = anchor[0] + BASE, anchor[1] + BASE
    out["score"] = ~unsigned(scores)
    out["kind"], out["no_id"], out["id"] = kind, no_id, unsigned(ids)
    return out


def opened(key: bytes) -> tuple[tuple[int, int], int, int, int | None]:
    """Anchor, score, kind and id of a key."""
    anchor, row, score, kind, no_id, i = struct.unpack(KEY, key)
    return (anchor - BASE, row - BASE), TOP - score, kind, None if no_id else i - BASE


def grid_of(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows of ``floor(256 * x)``, filled up with zeros."""
    column = lists.combine_chunks()
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    lengths = np.asarray(column.value_lengths(), np.int64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer inner products, within 64 bits."""
    reach = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * rows.shape[1]
    if reach < 2**53:  # every partial sum is exact in a double
        return (anchors @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in v] for v in m], object).reshape(m.shape) for m in (anchors, rows)]
    return np.clip(whole[0] @ whole[1].T, -BASE, TOP).astype(np.int64)


def first_of(scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the places ``at``, ascending, the ``n`` with the highest scores; the first of equal ones."""
    if len(at) <= n:
        return at
    values = scores[at]
    least = np.partition(values, len(at) - n)[len(at) - n]
    above = at[values > least]
    return np.concatenate([above, at[values == least][: n - len(above)]])


def in_windows(scores: np.ndarray, at: np.ndarray, tops: list[int], n: int, percent: int) -> np.ndarray:
    """Of the places ``at``, those among the first ``n`` of some window which begins at one of ``tops``."""
    spans = {top: -(-percent * top // 100) for top in tops if top >= 0}
    if not spans:
        return at[:0]
    at = at[(scores[at] <= max(spans)) & (scores[at] >= min(spans.values()))]
    at = at[np.argsort(-scores[at], kind="stable")]
    values = scores[at]
    taken = np.zeros(len(at), bool)
    for top, low in spans.items():
        start = int(np.searchsorted(-values, -top, "left"))
        stop = int(np.searchsorted(-values, -low, "right"))
        taken[start : min(stop, start + n)] = True
    return at[taken]


def scored_keys(rows: pa.Table, anchors: pa.Table, choose) -> pa.Table:
    """Keys of the pairs of a cell that ``choose(scores, places of the rows, same label, anchor)`` names."""
    schema = pa.schema([("key", pa.binary())])
    if not rows.num_rows or not anchors.num_rows:
        return schema.empty_table()
    rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])  # nulls are last
    dim = max(max((len(v) for v in t["vec"]), default=0) for t in (rows, anchors))
    left, right = grid_of(rows["vec"], dim), grid_of(anchors["vec"], dim)
    column = lambda t, name: t[name].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    ids, no_id = column(rows, "vec_id"), rows["vec_id"].is_null().to_numpy().astype(np.uint8)
    labels, uids = column(rows, "label"), column(rows, "uid")
    of_label = {x: np.flatnonzero(labels == x) for x in np.unique(column(anchors, "label"))}
    named = [anchors[n].to_pylist() for n in ("vec_id", "uid", "label")]
    tops = anchors["tops"].to_pylist() if "tops" in anchors.column_names else [None] * anchors.num_rows
    step = max(TILE_SCORES // max(rows.num_rows, 1), 1)
    out = []
    for begin in range(0, anchors.num_rows, step):
        scores = products(left, right[begin : begin + step])
        for j, line in enumerate(scores, begin):
            anchor, label = (named[0][j], named[1][j]), named[2][j]
            kind, at = choose(line, of_label[label], labels != label, uids != anchor[1], tops[j])
            out.append(packed(anchor, line[at], kind, ids[at], no_id[at]).tobytes())
    keys = b"".join(out)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PACKED.itemsize), len(keys) // PACKED.itemsize, [None, pa.py_buffer(keys)])
    return pa.table([fixed.cast(pa.binary())], schema=schema)


def cells(rows: DataFrame, anchors: DataFrame, parts: int, chunks: int, choose) -> DataFrame:
    """Every part of the rows meets every chunk of the anchors; a group is one part and one chunk."""
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", deal(parts).alias("_part"), every(chunks).alias("_chunk"))
    named_anew = [F.col(c).alias(c) for c in anchors.columns]  # both sides come from one table
    right = anchors.select(*named_anew, deal(chunks).alias("_chunk"), every(parts).alias("_part"))
    sides = [df.groupBy("_part", "_chunk") for df in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(lambda a, b: scored_keys(a, b, choose), "key binary")


def in_order(keys: DataFrame, read) -> RDD:
    """``read`` over the keys of each task: all keys of an anchor, one after the other, in order."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = keys.rdd.map(lambda row: (bytes(row[0]), None))
    return pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16])).mapPartitions(read)


def first_positives(n: int):
    def read(keys: Iterator) -> Iterator[tuple]:
        anchor, seen = None, 0
        for key, _ in keys:
            now, score, _, _ = opened(key)
            anchor, seen = (anchor, seen + 1) if now == anchor else (now, 1)
            if seen <= n:
                yield now[1], score, bytearray(key)

    return read


def open_windows(positives: int, negatives: int, percent: int):
    def read(keys: Iterator) -> Iterator[tuple]:
        anchor, windows = None, []
        for key, _ in keys:
            now, score, kind, i = opened(key)
            if now != anchor:
                anchor, windows = now, []
            if kind == POSITIVE:
                if len(windows) < positives:
                    windows.append([i, score, 0])
                continue
            for window in windows:
                if window[2] < negatives and 100 * score >= percent * window[1]:
                    window[2] += 1
                    yield anchor[0], window[0], window[2], i, window[1], score

    return read


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = LOWEST_PERCENT,
) -> DataFrame:
    """The first negatives below each of an anchor's first positives.

    ``anchor`` marks the anchor rows. An anchor's positives are its first ``positives`` other rows of
    the same label by score, then id; a positive's negatives are the first ``negatives`` rows of other
    labels with scores from ``percent`` hundredths of the positive's up to the positive's.
    """
    spark = vectors.sparkSession
    named = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vec"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = numbered(named.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & sound))
    seen = Observation()
    is_anchor = F.col("anchor") & F.col("vec_id").isNotNull()
    measures = [F.count(F.lit(1)).alias("rows"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("vec")).alias("dim")]
    table = materialize(whole.observe(seen, *measures), "vectors")
    n, n_anchors, dim = (seen.get[k] or 0 for k in ("rows", "anchors", "dim"))
    part_rows = max(PART_BYTES // (8 * max(dim, 1)), 1)
    wanted = min(2 * spark.sparkContext.defaultParallelism, n // LEAST_PART_ROWS)
    parts = max(-(-n // part_rows), wanted, 1)
    chunks = max(-(-n_anchors // max(CHUNK_BYTES // (8 * max(dim, 1)), 1)), 1)

    rows = table.select("uid", "vec_id", "label", "vec")
    anchors = table.filter(is_anchor).select("uid", "vec_id", "label", "vec")

    def near(scores, same, other, not_self, tops):
        return POSITIVE, first_of(scores, same[not_self[same]], positives)

    found = spark.createDataFrame(
        in_order(cells(rows, anchors, parts, chunks, near), first_positives(positives)), "uid long, score long, key binary", verifySchema=False
    )
    found = materialize(found, "positives")
    tops = found.groupBy("uid").agg(F.collect_list("score").alias("tops"))  # of at most ``positives`` rows

    def below(scores, same, other, not_self, tops):
        return NEGATIVE, in_windows(scores, np.flatnonzero(other), tops, negatives, percent)

    candidates = cells(rows, anchors.join(tops, "uid"), parts, chunks, below)
    keys = materialize(found.select("key").unionAll(candidates), "keys")
    return spark.createDataFrame(in_order(keys, open_windows(positives, negatives, percent)), RESULT, verifySchema=False)
