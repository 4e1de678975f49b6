"""The pipeline's stages, each on what the one before kept."""

import re
from collections import Counter, defaultdict

import zstandard

import corpus_pipeline
from bindery.llm import quality
from bindery.llm.common import materialize
from tests.llm.cases import SCHEMA, empty, odd_docs, odd_rows, prose
from tests.llm.test_dedup import lines_left
from tests.llm.test_jaccard import brute, edited
from tests.llm.test_mixing import targets
from tests.llm.test_packing import check_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rows = [r for r in odd_rows() if r[1] != prose(3, 12)]  # one text per id
    base = prose(50, 60)
    rows += [(100 + i, edited(base, 3 * i, i), "en", "d", 1) for i in range(4)]
    rows += [(120 + i, prose(200 + i, 20 + i, 2), "en", "abcd"[i % 4], 1) for i in range(20)]
    rows += [(150, prose(203, 23, 2), "en", "a", 1), (151, "!?&%$ " * 200, "en", "b", 1)]
    return rows


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_in_order(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = [corpus()]
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frames.append(materialize(stage(spark, frames[-1], str(tmp_path)), f"stage-{i}"))
        if i < 4:
            assert frames[-1].columns == docs.columns
            seen.append(rows_of(frames[-1]))

    compressor = zstandard.ZstdCompressor(level=3)
    kept = [r for r in seen[0] if quality.judge(r[1], compressor, quality.Bands())["kept"]]
    assert sorted(map(str, seen[1])) == sorted(map(str, kept)) and 20 < len(kept) < len(seen[0])

    left = lines_left(seen[1], 2)
    want = []
    for r in seen[1]:
        text, n = left[r[0], r[1]]
        if not n:
            want.append(r)
        elif text.strip():
            want.append((r[0], text, r[2], r[3], len(text)))
    assert sorted(map(str, seen[2])) == sorted(map(str, want)) and len(want) < len(seen[1])

    classes = Counter(c for _, c, _, _ in brute(seen[2]))
    assert sorted(str(r[0]) for r in seen[3]) == sorted(map(str, classes))
    assert {str(r) for r in seen[3]} <= {str(r) for r in seen[2]}

    sizes, taken, words = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in seen[3]:
        sizes[r[3]] += len(WORD.findall(r[1]))
        words[r[0]].update(WORD.findall(r[1]))
    for r in seen[4]:
        taken[r[3]] += len(WORD.findall(r[1]))
        assert set(WORD.findall(r[1])) <= words[r[0]] and r[4] == len(r[1])
    for s, t in targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 128 + 64

    packed = frames[5].collect()
    n = check_packed(packed, seen[4])
    assert n == -(-sum(r.length for r in packed) // 2048)


def check_packed(rows, docs):
    """As for documents, but a document may come in two passes: compare pieces of equal text as a bag."""
    merged = defaultdict(list)
    for d in docs:
        merged[d[0]].append(d[1])
    if all(len(v) == 1 for v in merged.values()):
        return check_rows(rows, [(d[0], d[1]) for d in docs], 2048)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 2048
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(d[0] for d in docs)
    return len(places)


def test_run_chains_the_stages(spark, tmp_path):
    spark.createDataFrame(corpus()[:24], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) > 5 and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())


def test_odd_columns_and_empty_tables_pass_through(spark):
    for docs in (odd_docs(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, ""), "stage")
        last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert last.count() == 0 if not docs.count() else last.count() > 0
