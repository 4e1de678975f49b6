import pathlib
import random
import re

import pytest
import zstandard

from bindery.llm import quality
from tests.llm.cases import empty, odd_docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base figures word by word."""
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered),
    )


TEXTS = [
    "",
    "a b",
    "a b c",
    "a b c a b c",
    "x x x x",
    "\x1c a\x85b\xa0c  d",
    "## a|b <c>\n## a|b <c>\n\n \n",
    "é€😀 naïve\nß ß ß ß ß",
    prose(1, 20),
    prose(1, 9) + "\n" + prose(1, 9),
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_metrics(text):
    assert quality.base_metrics(text) == plain(text)


def test_bands_reject_repetition_and_noise_but_keep_prose():
    judge = lambda t: quality.judge(t, zstandard.ZstdCompressor(level=3), quality.Bands())["kept"]
    r = random.Random(1)
    syllables = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(9000)]
    for n in (80, 400, 3000, 12000):
        clean = " ".join(r.choice(syllables) for _ in range(n))
        assert judge(clean)
        assert not judge(" ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) for _ in range(n)))
        assert not judge(" ".join("".join(chr(r.randrange(33, 126)) for _ in range(40)) for _ in range(max(n // 8, 60))))


def test_every_row_is_judged(spark):
    docs = odd_docs(spark)
    got = quality.quality_metrics(docs).collect()
    assert len(got) == len(odd_rows())
    want = sorted((r[0] is None, r[0] or 0, *plain(r[1])) for r in odd_rows())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((g.doc_id is None, g.doc_id or 0, *(g[n] for n in names)) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.kept and g.base_failed)


def test_keep_quality_agrees_and_passes_columns_on(spark):
    docs = odd_docs(spark)
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns
    n = quality.quality_metrics(docs).filter("kept").count()
    assert kept.count() == n > 3
    assert quality.keep_quality(empty(spark)).count() == quality.quality_metrics(empty(spark)).count() == 0


def keeps(text):
    return quality.judge(text, zstandard.ZstdCompressor(level=3), quality.Bands())["kept"]


@pytest.mark.parametrize("name", ["GPL-3", "LGPL-2.1", "GFDL-1.3", "Apache-2.0", "GPL-2", "MPL-2.0"])
def test_real_prose_is_kept(name):
    path = pathlib.Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no licence texts here")
    text = path.read_text()
    assert keeps(text) and keeps(text[: len(text) // 2]) and keeps(text[:3000])


def test_the_lowest_ratio_falls_on_with_length():
    bands = quality.Bands()
    low = bands.whole[-1][1]
    assert quality.in_bands(65536, low, [], bands) and not quality.in_bands(65536, 0.9 * low, [], bands)
    assert quality.in_bands(2**23, 0.6 * low, [], bands) and not quality.in_bands(2**23, 0.3 * low, [], bands)


def test_a_layer_of_marks_is_rejected():
    for seed, n in ((1, 12), (2, 40), (3, 150)):
        text = prose(seed, n)
        r = random.Random(seed)
        assert keeps(text)
        assert not keeps(text.replace(" ", " | "))
        assert not keeps(" ".join(w + r.choice(["&&&", "%%%", "***", "$$$", "###"]) for w in text.split()))
