"""Removal of repeated passages by sliding spans of sentences.

A text is cut into sentences after stops. As a passage may be quoted from the middle of a sentence
and may hold no stops, it is also cut by winnowing: words are hashed, and of every ``CUT_WINDOW``
consecutive words the one with the least hash (the last of equal ones) ends a sentence. Cuts depend
on nothing but the ``CUT_WINDOW - 1`` words to both sides; line ends and other white space play no
part. From every sentence on, the shortest run of at least ``SENTENCES`` sentences and ``WORDS``
words is hashed. A run which occurs earlier in the corpus is a repeat, and sentences covered by any
repeat are removed.

Any repeated passage of 50 words holds a repeated run: but for its first and last ``CUT_WINDOW - 1``
words it is cut alike wherever it stands, a cut falls into every ``CUT_WINDOW`` words, and
``WORDS + 4 * CUT_WINDOW`` is less than 50.

Earlier means a smaller ``doc_id`` (null before all), then a smaller text key, then a higher place.
Hashes are reduced by an aggregate and joined back to their places; their groups are never gathered.

Defined cases: a null or empty text stays empty; texts with no run never change; rows equal in
``doc_id`` and text are one document and share its result; words are compared exactly, white space
between them not at all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import materialize, per_batch

SENTENCES = 2
WORDS = 15
#: one word or more of so many consecutive ones ends a sentence by its hash
CUT_WINDOW = 8
STOPS = (".", "!", "?", "…", "。")
WORD = re.compile(r"\S+")


def word_mark(w: str) -> int:
    """The hash of a word, with its lowest bit set if a stop ends the word."""
    h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1
    return h & ~1 | w.rstrip("\"')]»”").endswith(STOPS)


def sentences(text: str, marks: dict[str, int]) -> list[list[str]]:
    """The sentences of a text as lists of words; ``marks`` remembers the hashes of words and which end by a stop."""
    words = text.split()
    if len(marks) > 500_000:
        marks.clear()
    for w in words:
        if w not in marks:
            marks[w] = word_mark(w)
    marked = np.fromiter((marks[w] for w in words), np.int64, len(words))
    ends = marked & 1 == 1
    if len(words) >= CUT_WINDOW:
        # backwards, so that the first of equal hashes is the last in the text
        least = np.lib.stride_tricks.sliding_window_view((marked >> 1)[::-1], CUT_WINDOW).argmin(axis=1)
        ends[len(words) - 1 - (least + np.arange(len(least)))] = True
    at = [0, *(np.flatnonzero(ends) + 1).tolist(), len(words)]
    return [words[i:j] for i, j in pairwise(at) if i < j]


def run_ends(parts: list[list[str]]) -> list[int]:
    """For each sentence that begins a run, the sentence behind its end."""
    ends, upto, words = [], 0, 0
    for i in range(len(parts)):
        while upto < len(parts) and (upto - i < SENTENCES or words < WORDS):
            words += len(parts[upto])
            upto += 1
        if upto - i < SENTENCES or words < WORDS:
            break
        ends.append(upto)
        words -= len(parts[i])
    return ends


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def run_hashes(parts: list[list[str]]) -> list[int]:
    joined = [" ".join(p) for p in parts]
    return [signed(xxhash.xxh64_intdigest(" ".join(joined[i:j]).encode("utf-8", "surrogatepass"))) for i, j in enumerate(run_ends(parts))]


def sentence_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, runs``: the hashes of a text's runs, by the sentence they begin at. Written once."""
    text = F.coalesce("text", F.lit(""))
    table = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))

    def rows(columns: dict[str, list]) -> dict[str, list]:
        marks: dict[str, int] = {}
        return {"doc_id": columns["doc_id"], "text_key": columns["text_key"], "runs": [run_hashes(sentences(t, marks)) for t in columns["text"]]}

    return materialize(per_batch(table, "doc_id long, text_key long, runs array<long>", rows), "sentence-runs")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, starts``: for each text with repeats, the sentences at which a repeated run begins."""
    each = sentence_runs(docs).select("doc_id", "text_key", F.posexplode("runs").alias("start", "run"))
    # most runs occur once: bare counts sort them out before places are compared
    often = each.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run")
    matched = materialize(each.join(often, "run", "left_semi"), "matched-runs")
    place = F.struct("doc_id", "text_key", "start")
    first = matched.groupBy("run").agg(F.min(place).alias("first"))
    later = matched.join(first, "run").filter(place != F.col("first"))
    # a text's own runs: bounded by its length
    return later.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("start")).alias("starts"))


def without(text: str, starts: list[int], marks: dict[str, int]) -> tuple[str, int, int, str]:
    """The text left over, its sentences, those removed, and the removed spans in code points."""
    parts = sentences(text, marks)
    runs = run_ends(parts)
    gone = [False] * len(parts)
    upto = 0
    for s in starts:
        for i in range(max(s, upto), runs[s]):
            gone[i] = True
        upto = max(upto, runs[s])
    begins = [m.start() for m in WORD.finditer(text)] + [len(text)]
    spans, kept, word, at = [], [], 0, 0
    for p, g in zip(parts, gone, strict=True):
        a, b = begins[word], begins[word + len(p)]
        word += len(p)
        if g:
            kept.append(text[at:a])
            at = b
            if spans and spans[-1][1] == a:
                spans[-1][1] = b
            else:
                spans.append([a, b])
    kept.append(text[at:])
    return "".join(kept), len(parts), sum(gone), ",".join(f"{a}:{b}" for a, b in spans)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_sentences_removed, removed``: every document without its repeated passages (``start:end`` in code points)."""
    repeats = repeated_spans(docs).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "starts")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_key"))
    both = keyed.join(repeats, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")

    @F.pandas_udf("text string, n long, removed string")
    def cut(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        marks: dict[str, int] = {}
        out = [(t, 0, "") if s is None else (lambda r: (r[0], r[2], r[3]))(without(t, list(s), marks)) for t, s in zip(text, starts, strict=True)]
        return pd.DataFrame(out, columns=["text", "n", "removed"])

    done = both.select("doc_id", cut("text", "starts").alias("c"))
    return done.select("doc_id", F.col("c.text").alias("text"), F.col("c.n").alias("n_sentences_removed"), F.col("c.removed").alias("removed"))
