"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text: assignments, access keys, hex runs, and bare tokens
which look random. Each candidate value is reduced to a hash, and the corpus is asked how many
distinct repositories and owners hold it. A value which many owners hold is a copied example; one
held by few, and not itself a placeholder, looks live. Assignments, access keys and hex runs are
always reported, with that verdict; bare random-looking tokens only when they look live, since a
widely copied one is a public identifier.

Defined cases: a null or empty text has no span; repeated rows are rows of their own but count
once per owner and repository; a null repository or owner is one unknown; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import materialize, numbered, per_batch

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|your|changeme|placeholder|x{6,}|0{6,}|123456", re.IGNORECASE | re.ASCII)
MIN_VALUE = 12
#: bits per character from which a bare token looks random
MIN_ENTROPY = 3.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def random_looking(value: str) -> bool:
    mixed = any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)
    return mixed and entropy(value) >= MIN_ENTROPY


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` in code points; kinds by their place in ``KINDS``."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        # a match with a short value uses up its characters all the same
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    # the characters taken, as intervals apart from each other: one look at the last that begins before a token's end
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted((s, e) for s, _, e, _ in found):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for m in TOKEN.finditer(text):
        if random_looking(m[0]):
            at = bisect_left(starts, m.end()) - 1
            if at < 0 or ends[at] <= m.start():
                found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per row of ``docs``: ``uid, doc_id, repository, owner, found`` (candidate structs). Written once."""
    table = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    schema = (
        "uid long, doc_id long, repository string, owner string, "
        "found array<struct<kind: int, start: long, end: long, value_hash: string, placeholder: boolean>>"
    )

    def rows(columns: dict[str, list]) -> dict[str, list]:
        found = [
            [
                {
                    "kind": kind,
                    "start": start,
                    "end": end,
                    "value_hash": hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest(),
                    "placeholder": bool(PLACEHOLDER.search(value)),
                }
                for start, kind, end, value in candidates(t)
            ]
            for t in columns["text"]
        ]
        return {k: columns[k] for k in ("uid", "doc_id", "repository", "owner")} | {"found": found}

    return materialize(per_batch(numbered(table), schema, rows), "secret-scan")


def ownership(scanned: DataFrame) -> DataFrame:
    """``value_hash, n_documents, n_repositories, n_owners`` over the whole corpus.

    Counts pass through (value, owner, repository) and (value, owner), so a value which a third of
    all rows hold is combined before each shuffle and never gathered.
    """
    each = scanned.select("repository", "owner", F.explode("found").alias("f")).select("repository", "owner", F.col("f.value_hash").alias("value_hash"))
    by_repository = each.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(
        F.sum("n").alias("n_documents"), F.sum("r").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")
    )


def secret_spans(docs: DataFrame, repository: Column, owner: Column, max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """``uid, doc_id, kind, start, end, value_hash, n_owners, n_repositories, live``, a row per reported span.

    A value is a copied example when more than ``max_owners`` owners or more than
    ``max_repositories`` repositories hold it, or when it reads as a placeholder.
    """
    return _spans(scan(docs, repository, owner), max_owners, max_repositories)


def _spans(scanned: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    each = scanned.select("uid", "doc_id", F.explode("found").alias("f")).select("uid", "doc_id", "f.*")
    counted = each.join(ownership(scanned), "value_hash")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories) & ~F.col("placeholder")
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    reported = counted.withColumn("live", live).filter(F.col("live") | (F.col("kind") < 3))
    return reported.select(
        "uid", "doc_id", names.alias("kind"), F.col("kind").alias("kind_no"), "start", "end", "value_hash", "n_owners", "n_repositories", "live"
    )


def scan_report(docs: DataFrame, repository: Column, owner: Column, max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """One row per row of ``docs`` with the counts and the spans of its text."""
    scanned = scan(docs, repository, owner)
    spans = _spans(scanned, max_owners, max_repositories)
    # the spans of one text: its own length bounds them
    per_doc = spans.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind", "live"))).alias("s")
    )

    def joined(base: bool) -> Column:
        kept = F.filter("s", lambda x: x["kind_no"] < 3) if base else F.col("s")
        return F.coalesce(
            F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit("")
        )

    def count(test) -> Column:
        return F.size(F.filter("s", lambda x: test(x))).cast("long")

    def of_kind(k: int) -> Column:
        return count(lambda x: x["kind_no"] == k)

    out = scanned.select("uid", "doc_id").join(per_doc, "uid", "left").withColumn("s", F.coalesce("s", F.array()))
    return out.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(True), 256).alias("base_sha256"),
        joined(False).alias("spans"),
        of_kind(3).alias("n_token"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_example"),
    )
