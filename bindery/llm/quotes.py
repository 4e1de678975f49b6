"""Chat threads from quoted passages.

Messages quote what they answer with ``>`` before each line, nested for quotes in quotes. A message
is parsed into runs of lines of one quote level; level 0 is what its author wrote. Level by level the
quoted lines form a passage, whose normalised text is hashed, as are the whole, the parts between
quotes and the lines of what every message's author wrote. A passage is joined to the messages which
wrote it: to the latest earlier one of the same group, or else to the earliest one of the corpus. A
passage that no message wrote as a whole is joined by its lines, to the message which wrote most of
them and at least half. A message replies to the
origin of its outermost passage; following replies gives threads, ordered by reply.

Hashes are reduced to one origin per group and one per corpus before the join, so a first turn which a
third of all conversations share is one row there.

Defined cases: a null text counts as empty; a message without quotes, or whose quotes no message
wrote, begins a thread; quotes link to messages before their own (by group, then number); a passage of white space only is no passage; rows equal in group and number
are kept, the smallest text stands for them as an origin; null groups are one group; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import materialize, numbered, per_batch

MARK = re.compile(r"^(?:[ \t]*>)+[ \t]?")
INTRO = re.compile(r"^(?:on .{1,200} wrote|le .{1,200} a écrit|am .{1,200} schrieb.{0,100}|-{2,} ?original message ?-{2,}):?$", re.IGNORECASE)


def level(line: str) -> tuple[int, str]:
    """How deep a line is quoted, and the line without its marks."""
    m = MARK.match(line)
    return (m[0].count(">"), line[m.end() :]) if m else (0, line)


def blocks(text: str) -> list[tuple[int, str]]:
    """Runs of lines of one quote level, in order."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        depth, rest = level(line.rstrip("\r"))
        if not out or out[-1][0] != depth:
            out.append((depth, []))
        out[-1][1].append(rest)
    return [(d, "\n".join(lines)) for d, lines in out]


def own_parts(parts: list[tuple[int, str]]) -> list[str]:
    """What the author wrote, by the quotes between: level 0 without the lines that introduce a quote."""
    out = []
    for i, (depth, text) in enumerate(parts):
        if depth:
            continue
        lines = text.split("\n")
        if i + 1 < len(parts):
            while lines and (not lines[-1].strip() or INTRO.match(lines[-1].strip())):
                lines.pop()
        out.append("\n".join(lines).strip("\n"))
    return [p for p in out if p.strip()]


def own_text(parts: list[tuple[int, str]]) -> str:
    return "\n".join(own_parts(parts))


def passage_hash(text: str) -> str | None:
    """The hash of a passage's words in lower case; white space and line breaks do not matter."""
    words = " ".join(text.lower().split())
    return hashlib.sha256(words.encode("utf-8", "surrogatepass")).hexdigest() if words else None


def line_hashes(text: str) -> list[str]:
    """The different hashes of a passage's lines; none for a passage of one line."""
    found = {passage_hash(line) for line in text.split("\n")} - {None}
    return sorted(found) if len(found) > 1 else []


def parsed(messages: DataFrame, group: str, number: str, text: str) -> DataFrame:
    """``uid, grp, num, own, quoted, wrote``: own text, quoted passages outermost first, hashes of what was written. Written once."""
    table = messages.select(F.col(group).cast("string").alias("grp"), F.col(number).cast("long").alias("num"), F.coalesce(text, F.lit("")).alias("text"))
    schema = "uid long, grp string, num long, own string, quoted array<struct<depth: int, hash: string, lines: array<string>>>, wrote array<string>"

    def rows(columns: dict[str, list]) -> dict[str, list]:
        own, quoted, wrote = [], [], []
        for t in columns["text"]:
            parts = blocks(t)
            mine = own_text(parts)
            own.append(mine)
            found = [{"depth": d, "hash": h, "lines": line_hashes(p)} for d, p in parts if d and (h := passage_hash(p))]
            quoted.append(sorted(found, key=lambda q: q["depth"]))
            pieces = {passage_hash(p) for p in (mine, *own_parts(parts), *mine.split("\n"))} - {None}
            wrote.append(sorted(pieces))
        return {k: columns[k] for k in ("uid", "grp", "num")} | {"own": own, "quoted": quoted, "wrote": wrote}

    return materialize(per_batch(numbered(table), schema, rows), "messages")


def links(table: DataFrame) -> DataFrame:
    """``uid, parent``: the message that each quoting message replies to."""
    wrote = table.select("uid", "grp", "num", F.explode("wrote").alias("hash"))
    # combined map-side: a row per hash and message number of a group, and a row per hash
    in_group = wrote.groupBy("hash", "grp", "num").agg(F.min("uid").alias("origin"))
    anywhere = wrote.groupBy("hash").agg(F.min(F.struct("grp", "num", "uid")).alias("first"))
    quotes = table.select("uid", "grp", "num", F.posexplode("quoted").alias("place", "q")).select("uid", "grp", "num", "place", "q.depth", "q.hash", "q.lines")
    near = in_group.select(F.col("hash").alias("_h"), F.col("grp").alias("_g"), F.col("num").alias("_n"), "origin")

    def same_group(df: DataFrame) -> DataFrame:
        return df.join(near, (F.col("hash") == F.col("_h")) & F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_n") < F.col("num")))

    latest = same_group(quotes).groupBy("uid", "place").agg(F.max_by("origin", "_n").alias("close"))
    both = quotes.join(latest, ["uid", "place"], "left").join(anywhere, "hash", "left")
    # every link leads to an earlier message, so replies form no cycle
    earlier = F.col("first") < F.struct("grp", "num", "uid")
    whole = materialize(both.withColumn("parent", F.coalesce("close", F.when(earlier, F.col("first.uid")))).drop("hash", "close", "first"), "quote-origins")
    # only what no message wrote as a whole goes by lines
    missed = whole.filter("parent is null and size(lines) > 0").withColumn("n", F.size("lines"))
    lines = missed.select("uid", "grp", "num", "place", "n", F.explode("lines").alias("hash"))
    enough = 2 * F.col("votes") >= F.col("n")
    of_group = same_group(lines).groupBy("uid", "place", "n", "_n").agg(F.count(F.lit(1)).alias("votes"), F.min("origin").alias("origin"))
    close = of_group.filter(enough).groupBy("uid", "place").agg(F.max_by("origin", F.struct("votes", "_n")).alias("close"))
    of_all = lines.join(anywhere, "hash").filter(earlier).groupBy("uid", "place", "n", "first").agg(F.count(F.lit(1)).alias("votes"))
    far = of_all.filter(enough).groupBy("uid", "place").agg(F.min_by("first.uid", F.struct(-F.col("votes"), F.col("first"))).alias("far"))
    by_lines = missed.select("uid", "place", "depth").join(close, ["uid", "place"], "left").join(far, ["uid", "place"], "left")
    found = whole.select("uid", "place", "depth", "parent").unionByName(by_lines.select("uid", "place", "depth", F.coalesce("close", "far").alias("parent")))
    return found.filter("parent is not null").groupBy("uid").agg(
        F.min_by("parent", F.struct("depth", "place")).alias("parent"), F.count(F.lit(1)).alias("linked")
    )


def threads(table: DataFrame, linked: DataFrame) -> DataFrame:
    """``uid, root, depth``: replies followed to the message that begins the thread, by doubling.

    Messages which point at a beginning are done; only the others are joined on.
    """
    steps = F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps")
    start = table.select("uid").join(linked, "uid", "left").select("uid", F.coalesce("parent", "uid").alias("up"), steps)
    now = materialize(start.withColumn("done", F.col("steps") == 0), "jumps")
    while not now.filter("not done").isEmpty():
        ahead = now.select(F.col("uid").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        moved = now.filter("not done").join(ahead, "up").select(
            "uid", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("_steps") == 0).alias("done")
        )
        now = materialize(now.filter("done").unionByName(moved), "jumps")
    return now.select("uid", F.col("up").alias("root"), F.col("steps").alias("depth"))


def conversations(messages: DataFrame, group: str = "conv_id", number: str = "turn", text: str = "text") -> DataFrame:
    """One row per message: what it replies to, its thread and place in reply order, and its text without quotes."""
    table = parsed(messages, group, number, text)
    linked = materialize(links(table), "reply-links")
    placed = threads(table, linked)
    names = table.select("uid", F.col("grp").alias("_grp"), F.col("num").alias("_num"))

    def named(uid: str, prefix: str) -> DataFrame:
        return names.select(F.col("uid").alias(uid), F.col("_grp").alias(f"{prefix}_group"), F.col("_num").alias(f"{prefix}_number"))

    whole = table.join(placed, "uid").join(linked, "uid", "left")
    whole = whole.join(named("parent", "reply_to"), "parent", "left").join(named("root", "thread"), "root")
    return whole.select(
        F.col("grp").alias("group"),
        F.col("num").alias("number"),
        "reply_to_group",
        "reply_to_number",
        "thread_group",
        "thread_number",
        F.col("depth").cast("long").alias("depth"),
        F.size("quoted").cast("long").alias("n_quotes"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("own").alias("text"),
    )


def quoting(turns: DataFrame) -> DataFrame:
    """Mail-like messages from turns: each quotes the turn before it, and in that the turn before that, above its own text."""
    text = F.coalesce("text", F.lit(""))
    said = turns.select("conv_id", "turn", text.alias("text")).groupBy("conv_id", "turn").agg(F.min("text").alias("text"))

    def earlier(n: int) -> DataFrame:
        return said.select(F.col("conv_id").alias("_c"), (F.col("turn") + n).alias("_t"), F.col("text").alias(f"before{n}"))

    def joined(df: DataFrame, n: int) -> DataFrame:
        return df.join(earlier(n), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")

    def quoted(column: str, marks: str):
        return F.concat(F.lit(marks), F.regexp_replace(column, "\n", f"\n{marks}"), F.lit("\n"))

    both = joined(joined(turns.select("conv_id", "turn", text.alias("text")), 1), 2)
    body = F.concat(
        F.when(F.col("before2").isNotNull() & F.col("before1").isNotNull(), quoted("before2", ">> ")).otherwise(F.lit("")),
        F.when(F.col("before1").isNotNull(), quoted("before1", "> ")).otherwise(F.lit("")),
        F.col("text"),
    )
    return both.select("conv_id", "turn", body.alias("text"))
