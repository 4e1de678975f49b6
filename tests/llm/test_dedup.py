"""Line runs and sentence spans against brute force."""

import random

from bindery.llm import linededup, spans
from tests.llm.cases import docs_of, empty, odd_docs, odd_rows, prose


def passages():
    r = random.Random(5)
    shared = [prose(900 + i, 9, 1) for i in range(3)]
    rows = []
    for i in range(24):
        lines = prose(i, 12, 2).split("\n")
        if i % 3:
            at = r.randrange(len(lines))
            lines[at:at] = shared[i % 3].split("\n")[: r.randint(1, 9)]
        if i % 5 == 0:
            lines.insert(2, "  ")
        rows.append((i, "\n".join(lines), "en", "a", 1))
    return rows


def lines_left(rows, n, long=12):
    """Delete lines in windows of ``n`` filled lines seen before, long lines seen before, and blank lines between them."""
    seen, out = {}, {}
    docs = {(r[0], r[1] or "") for r in rows}
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = text.split("\n")
        at = [i for i, line in enumerate(lines) if line.strip()]
        gone = set()
        for s in range(len(at) - n + 1):
            window = tuple(lines[i].strip() for i in at[s : s + n])
            if window in seen:
                gone.update(range(s, s + n))
            else:
                seen[window] = (d, s)
        for s, i in enumerate(at):
            line = lines[i].strip()
            if len(line.split()) >= long:
                if (line,) in seen:
                    gone.add(s)
                seen[line,] = (d, s)
        cut = {at[i] for i in gone} | {j for i in gone if i + 1 in gone for j in range(at[i], at[i + 1])}
        out[d, text] = "\n".join(line for i, line in enumerate(lines) if i not in cut), len(cut)
    return out


def check_lines(spark, docs, rows, n):
    want = lines_left(rows, n)
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in linededup.deduplicated(docs, n).collect()), key=str)
    assert got == sorted(((r[0], *want[r[0], r[1] or ""]) for r in rows), key=str)
    return sum(x[2] for x in got)


def test_line_runs_against_brute_force(spark):
    rows = passages()
    for n in (2, 3):
        assert check_lines(spark, docs_of(spark, rows), rows, n) > 20


def test_line_runs_of_odd_documents(spark):
    # the two texts of id 9 share nothing, so their order does not matter
    assert check_lines(spark, odd_docs(spark), odd_rows(), 2) > 20
    done = linededup.drop_repeated_lines(odd_docs(spark))
    assert done.columns == [*odd_docs(spark).columns, "_dedup"] and done.count() == len(odd_rows())
    assert linededup.deduplicated(empty(spark)).count() == 0


def test_long_lines_repeat_by_themselves(spark):
    r = random.Random(3)
    line = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    passage, short, han = line(55), line(49), "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(60))
    own = [line(9) for _ in range(8)]
    texts = [
        f"{own[0]}\n{passage}\n{short}\n{own[1]}\n{han}",
        f"{own[2]}\n  {passage} \n\n{own[3]}\n{short}\n{own[4]}\n{passage}",
        passage,
        f"{own[5]}\n{han}\n{own[6]}",
        short,
    ]
    docs = docs_of(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    done = {x.doc_id: x for x in linededup.deduplicated(docs, long_words=50).collect()}
    assert [done[i].removed for i in range(5)] == ["", "1:1,6:6", "0:0", "1:1", ""]
    assert done[1].text == f"{own[2]}\n\n{own[3]}\n{short}\n{own[4]}" and done[2].text == ""
    assert all(x.n_removed == 0 for x in linededup.deduplicated(docs, long_words=None).collect())


def test_a_repeat_in_other_surroundings_than_the_first_is_found(spark):
    r = random.Random(6)
    vocabulary = [f"line {i}" for i in range(5)]
    rows = [(i, "\n".join(r.choice(vocabulary) for _ in range(r.randint(1, 9))), "en", "a", 1) for i in range(60)]
    for n in (2, 3, 4):
        assert check_lines(spark, docs_of(spark, rows), rows, n) > 20


def test_white_space_at_line_ends_does_not_hide_a_repeat(spark):
    lines = prose(77, 12, 1).split("\n")
    texts = ["\n".join(lines), "\r\n".join(lines), "\n\t\n".join(f"\u3000{x}\xa0 " for x in lines), "one\n" + lines[0] + "\ntwo"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    docs = docs_of(spark, rows)
    check_lines(spark, docs, rows, 2)
    done = {x.doc_id: x.text for x in linededup.deduplicated(docs).collect()}
    assert done[0] == texts[0] and done[1] == done[2] == ""


def test_a_line_of_twelve_words_repeats_by_itself(spark):
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(i, f"{line(f'own{i}', 5)}\n{line('long', 12)}\n{line(f'mine{i}', 20)}\n{line('short', 11)}", "en", "a", 1) for i in range(4)]
    assert check_lines(spark, docs_of(spark, rows), rows, 2) == 3


def test_hot_lines_are_spread(spark, monkeypatch):
    from bindery.operators import scan

    monkeypatch.setattr(scan, "SAFE_BROADCAST_ROWS", 3)
    monkeypatch.setattr(linededup, "lookup", lambda a, b, on, how: scan.lookup(a, b, on, how, hot=5))
    rows = [(i, f"{prose(i, 6, 1)}\nread more\nshare this\n{prose(i + 500, 3, 1)}\nread more\n{prose(i % 3, 2, 1)}", "en", "a", 1) for i in range(40)]
    assert check_lines(spark, docs_of(spark, rows), rows, 2) > 100


def spans_left(rows):
    """Remove sentences in runs seen before, run by run."""
    seen, out = set(), {}
    for d, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        parts = spans.sentences(text, {})
        gone = set()
        for i in range(len(parts)):
            j = i
            while j < len(parts) and (j - i < spans.SENTENCES or sum(map(len, parts[i:j])) < spans.WORDS):
                j += 1
            if j - i < spans.SENTENCES or sum(map(len, parts[i:j])) < spans.WORDS:
                continue
            run = tuple(w for p in parts[i:j] for w in p)
            if run in seen:
                gone.update(range(i, j))
            seen.add(run)
        out[d, text] = [w for i, p in enumerate(parts) if i not in gone for w in p], len(gone)
    return out


def check_spans(docs, rows):
    want = spans_left(rows)
    got = spans.deduplicated(docs).collect()
    have = sorted(((r.doc_id, r.text.split(), r.n_sentences_removed) for r in got), key=str)
    assert have == sorted(((r[0], *want[r[0], r[1] or ""]) for r in rows), key=str)
    return got


def test_sentence_spans_against_brute_force(spark):
    rows = passages()
    got = check_spans(docs_of(spark, rows), rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        cuts = [tuple(map(int, s.split(":"))) for s in r.removed.split(",") if s]
        left = texts[r.doc_id]
        for a, b in reversed(cuts):
            left = left[:a] + left[b:]
        assert left == r.text
    assert sum(r.n_sentences_removed for r in got) > 30


def test_sentence_spans_of_odd_documents(spark):
    check_spans(odd_docs(spark), odd_rows())
    assert spans.deduplicated(empty(spark)).count() == 0


def test_a_passage_from_the_middle_of_a_sentence_is_found(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(400)}" for _ in range(60)]
    passage = " ".join(words)
    own = [" ".join(f"v{r.randrange(10**6)}" for _ in range(40)) for _ in range(4)]
    rows = [(1, f"{own[0]} {passage} {own[1]}", "en", "a", 1), (2, f"{own[2]}\n{passage}  {own[3]}", "en", "a", 1)]
    first, second = sorted(spans.deduplicated(docs_of(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert first.text == rows[0][1]
    left = second.text.split()
    assert sum(w in words for w in left) <= 30 and all(w in left for w in own[2].split()[:30])


def test_every_passage_of_fifty_words_holds_a_common_run():
    r = random.Random(7)
    words = lambda n, k: [f"w{r.randrange(k)}" for _ in range(n)]
    for i in range(2000):
        passage = words(50, 3 if i % 4 == 0 else 10**6)
        runs = []
        for _ in range(2):
            text = words(r.randrange(30), 10**6) + passage + words(r.randrange(30), 10**6)
            runs.append(set(spans.run_hashes(spans.sentences("".join(w + r.choice(" \n") for w in text), {}))))
        assert runs[0] & runs[1]


def test_a_passage_wrapped_otherwise_and_without_stops_is_removed(spark):
    r = random.Random(8)
    words = lambda n, to="v": [f"{to}{r.randrange(10**6)}" for _ in range(n)]
    passages = [words(50, "w") for _ in range(40)]
    wrapped = lambda p, n: "\n".join(" ".join(p[i : i + n]) for i in range(0, len(p), n))
    rows = [(100 * k + i, wrapped(words(20) + p + words(20), n), "en", "a", 1) for i, p in enumerate(passages) for k, n in ((0, 9), (1, 13))]
    for row in spans.deduplicated(docs_of(spark, rows)).collect():
        p = passages[row.doc_id % 100]
        left = sum(w in p for w in row.text.split())
        assert len(row.text.split()) - left == 40 and (left == 50 if row.doc_id < 100 else left <= 35)
