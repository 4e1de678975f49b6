from bindery.llm import quotes

MESSAGES = [
    ("a", 0, "Hello there.\nHow are you?"),
    ("a", 1, "> Hello there.\n> How are you?\nFine, thanks."),
    ("a", 2, "On Monday X wrote:\n> > hello   THERE. How are\n>> you?\n> Fine, thanks.\n\nGood to hear."),
    ("a", 3, ">How are you?\nA second answer to the first."),
    ("b", 0, "Hello there.\nHow are you?"),
    ("b", 1, "> Hello there.\n> How are you?\nAnother group."),
    ("c", 5, "> Good to hear.\nFrom afar."),
    ("c", 6, "> nobody wrote this\nAlone."),
    ("d", 0, None),
    ("d", 1, ""),
    ("d", 2, ">\n> \nOnly marks."),
    (None, 1, "no group"),
    (None, 2, "> no group\nreply"),
    (None, None, "> no group\nno number"),
    ("e", 1, "twice"),
    ("e", 1, "twice"),
    ("e", 2, "> twice\nto one of two"),
]


def test_threads(spark):
    df = spark.createDataFrame([(*m, "x", 1) for m in MESSAGES], "conv_id string, turn long, text string, uid string, own int").repartition(3)
    got = quotes.conversations(df).collect()
    assert len(got) == len(MESSAGES)
    by = {(r.group, r.number): r for r in got}

    def reply(g, n):
        r = by[g, n]
        return None if r.reply_to_number is None else (r.reply_to_group, r.reply_to_number)

    assert reply("a", 1) == ("a", 0)
    assert reply("a", 2) == ("a", 1)
    assert reply("a", 3) == ("a", 0)
    assert reply("b", 1) == ("b", 0)
    assert reply("c", 5) == ("a", 2)  # of another group, found in the whole corpus
    assert reply("c", 6) is None and reply("d", 2) is None
    assert reply(None, 2) == (None, 1)
    assert reply("e", 2) == ("e", 1)
    assert (by["c", 5].thread_group, by["c", 5].thread_number, by["c", 5].depth) == ("a", 0, 3)
    assert by["a", 2].n_quotes == by["a", 2].n_linked == 2
    assert by["a", 2].text == "Good to hear."
    assert by["a", 0].text == "Hello there.\nHow are you?"
    assert by["d", 0].text == "" and by["d", 2].text == "Only marks."


def test_long_chains_and_nothing(spark):
    rows = [("g", 0, "start")] + [("g", i, f"> {'start' if i == 1 else f'line {i - 1}'}\nline {i}") for i in range(1, 40)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id string, turn long, text string")).collect()
    assert {(r.number, r.depth, r.thread_number) for r in got} == {(i, i, 0) for i in range(40)}
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0


def test_levels():
    assert quotes.level("> > a") == (2, "a") and quotes.level(">>a") == (2, "a") and quotes.level(" > a") == (1, "a")
    assert quotes.level("a > b") == (0, "a > b") and quotes.level(">") == (1, "")
    assert quotes.blocks("x\n> y\n> z\nw") == [(0, "x"), (1, "y\nz"), (0, "w")]


def test_partial_and_inline_quotes(spark):
    rows = [
        ("p", 0, "first line\nsecond line\nthird line\nfourth line"),
        ("p", 1, "second line\nother words"),
        ("p", 2, "> second line\n> third line\nSome of it."),  # two lines of four
        ("p", 3, "> first line\n> second line\nAnswer one\nover two lines.\n> fourth line\nAnswer two\nover lines too."),
        ("p", 4, "> > first line\n> Answer two\n> over lines too.\nTo a part of an inline reply."),
        ("q", 0, "> first line\n> third line\n> a line nobody wrote\nFrom another group."),
        ("q", 1, "> nobody\n> wrote\n> fourth line\nToo little in common."),
    ]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id string, turn long, text string").repartition(2)).collect()
    to = {(r.group, r.number): (r.reply_to_group, r.reply_to_number) for r in got}
    none = (None, None)
    assert to == {("p", 0): none, ("p", 1): none, ("p", 2): ("p", 0), ("p", 3): ("p", 0), ("p", 4): ("p", 3), ("q", 0): ("p", 0), ("q", 1): none}
