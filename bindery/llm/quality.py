"""Quality rules by compression bands.

A text's zstandard ratio (compressed over raw bytes) falls with its length and, at a given
length, tells apart text that repeats itself (too low) and noise such as encoded bytes (too high).
Whole texts are held against limits by length class, and each fixed chunk, always of the same
length, against one band of its own. The lowest ratios lie below those of prose in 25 languages
(manual pages and licences); above the last class they fall on with length.

A low-variety layer of marks between or behind the words does not show in the ratio of a whole text,
as prose of other languages or lengths compresses as well. It shows in parts: a text with many
marks whose ratio is clearly below that of its words alone has such a layer.

Defined cases: a null or empty text has no words, fails the base rules and is dropped; a repeated
row is judged as often as it occurs; ``doc_id`` may be null; an empty table gives an empty result;
other columns are ignored by ``quality_metrics`` and passed on unchanged by ``keep_quality``.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import give_back_memory, own_columns, per_batch

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MARKS = string.punctuation.encode()


@dataclass(frozen=True)
class Bands:
    """Limits of the verdict: a row per length class (bytes up to, lowest ratio, highest ratio)."""

    whole: tuple[tuple[float, float, float], ...] = (
        (512, 0.38, 0.90),
        (1024, 0.33, 0.82),
        (2048, 0.29, 0.74),
        (4096, 0.26, 0.68),
        (8192, 0.24, 0.64),
        (16384, 0.225, 0.62),
        (32768, 0.205, 0.60),
        (65536, 0.19, 0.60),
        (float("inf"), 0.19, 0.60),
    )
    #: beyond the last length class but one the lowest ratio falls with this power of the length
    fall: float = 0.15
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.32, 0.75)
    #: a text goes when more than this share of its full chunks lies outside the band
    chunk_share: float = 0.25
    #: marks are a layer from this share of the bytes on, when the text's ratio is below so much of its words' ratio
    layer_share: float = 0.12
    layer_ratio: float = 0.955
    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3


def base_metrics(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated three-word windows."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at exactly the six ASCII white-space characters
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = [line for line in raw.split(b"\n") if line.split()]
    repeated = 0
    if n >= 4:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        if len(numbers) < 2_000_000:
            base = len(numbers)
            grams = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
        else:  # products would pass 64 bits: number the pairs first
            pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1].astype(np.int64)
            grams = pairs[:-1] * len(numbers) + ids[2:]
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for j in range(3):
            covered[j : n - 2 + j] |= twice
        repeated = int(covered.sum())
    return n, word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def ratios(raw: bytes, compressor, chunk_bytes: int) -> tuple[float, list[float]]:
    """The ratio of the whole text and of each full chunk."""
    ends = range(0, len(raw) + 1, chunk_bytes)
    chunks = [len(compressor.compress(raw[i:j])) / chunk_bytes for i, j in pairwise(ends)]
    return len(compressor.compress(raw)) / max(len(raw), 1), chunks


def has_layer(raw: bytes, compressor, bands: Bands) -> bool:
    """Whether the marks of a text are a layer of little variety: it compresses better with them than its words alone."""
    whole, words = b" ".join(raw.split()), b" ".join(raw.translate(None, MARKS).split())
    if not words or len(whole) - len(words) < bands.layer_share * len(whole):
        return False
    return len(compressor.compress(whole)) * len(words) < bands.layer_ratio * len(compressor.compress(words)) * len(whole)


def in_bands(n_bytes: int, whole: float, chunks: list[float], bands: Bands) -> bool:
    low, high = next((lo, hi) for upto, lo, hi in bands.whole if n_bytes <= upto)
    longest = bands.whole[-2][0]
    if n_bytes > longest:
        low *= (longest / n_bytes) ** bands.fall
    outside = sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in chunks)
    return low <= whole <= high and outside <= bands.chunk_share * len(chunks)


def judge(text: str | None, compressor, bands: Bands) -> dict:
    """All figures and the verdict of one text."""
    text = text or ""
    n, chars, symbols, dup_lines, repeated = base_metrics(text)
    raw = text.encode("utf-8", "surrogatepass")
    failed = n < bands.min_words or 100 * repeated > bands.max_repeat_percent * n
    whole, chunks = ratios(raw, compressor, bands.chunk_bytes)
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": not failed and in_bands(len(raw), whole, chunks, bands) and not has_layer(raw, compressor, bands),
        "ratio": whole,
        "lowest_chunk": min(chunks, default=None),
        "highest_chunk": max(chunks, default=None),
    }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, lowest_chunk double, highest_chunk double"
)


def quality_metrics(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Figures and verdict for every row of ``docs`` (``doc_id, text``): a narrow pass, no shuffle."""

    def rows(columns: dict[str, list]) -> dict[str, list]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        found = [judge(t, compressor, bands) for t in columns["text"]]
        out = {k: [f[k] for f in found] for k in (found[0] if found else ())}
        return out | {"doc_id": columns["doc_id"]}

    return per_batch(own_columns(docs, "doc_id", "text"), SCHEMA, rows)


def keep_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with all their columns; only texts go to Python."""

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            yield pa.array([judge(t.as_py(), compressor, bands)["kept"] for t in texts], pa.bool_())
        give_back_memory()

    return docs.filter(kept("text"))
