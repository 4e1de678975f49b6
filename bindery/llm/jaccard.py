"""Similarity join of documents on word shingles by a MinHash LSH forest.

A text's signature is cut into ``TREES`` labels of ``DEPTH`` minimum hashes. In a tree, texts are
sorted by their labels, so those under one prefix stand together. Matching starts at whole labels: texts
that share one are compared by whole signatures with leaders, where a text close to a leader is covered
by it, a text near a leader joins its family, and one near none leads on. A covered text stops there;
for the others the prefix is shortened by one value and they meet the leaders of the neighbouring
labels, down to the prefix at which pairs at the threshold share one in some tree with the target
recall. Shorter ones would only bring together texts below the threshold. Two covered texts at the
threshold differ by 0.2, and by 0.2 each from their leaders, so the leaders are alike by 0.4 at least,
well above the limit of a family; leaders cover each other only when nearly equal, which keeps that
margin. Under crowded prefixes texts are dealt into parts, and the leaders of all parts meet in pairs of blocks.

A family's texts are then brought together once and every pair in it verified exactly, in blocks of
bounded size, from inverted lists; no pair leaves a task. Which texts are in families is told to the
scan of the texts by a bitmap of fixed size; it only saves shuffling, the join after it decides.
Verified links make the classes.

Texts with equal shingle sets are copies: one stands for all, and a link counts its copies.

Defined cases: a text of fewer than five words is one shingle; a null, empty or blank text has none,
no link, and a class of its own; repeated rows are copies; a class is named by its smallest ``doc_id``
(null if it has none); an empty table gives an empty result; other columns are ignored by ``classes``
and passed on by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import components, materialize, numbered
from bindery.operators.scan import lookup

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 6
TARGET_RECALL = 0.9999
#: signature likeness from which a text is covered by a leader, from which a leader is, and from which a text joins a family
COVERED = 0.8
LEADER_COVERED = 0.95
NEAR = 0.25
#: texts of one prefix which a task compares with leaders; more are split, and their leaders compared after
PART_ROWS = 20_000
#: shingles in a block of a family; a long text of few shingles counts by its length
BLOCK_SHINGLES = 1_000_000
#: bits of the bitmap of texts in families (16 MB in all), and of one of its rows
FILTER_BITS = 1 << 27
ROW_BITS = 1 << 15
ODD = (np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
MULTIPLIERS = np.random.default_rng(8).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = np.random.default_rng(80).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def shingles(text: str, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of ``n`` words; a shorter text is one run."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    size = min(n, len(words))
    runs = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        runs += hashes[j : len(words) - size + 1 + j] * ODD[j]
    runs ^= runs >> np.uint64(32)
    runs *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(runs ^ (runs >> np.uint64(32)))


def signature(runs: np.ndarray) -> np.ndarray:
    """The least of each hash function over the shingles, 32 bits each."""
    out = np.full(len(MULTIPLIERS), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(runs), 4096):
        hashed = (MULTIPLIERS[:, None] * runs[None, at : at + 4096] + ADDENDS[:, None]) >> np.uint64(32)
        out = np.minimum(out, hashed.min(axis=1).astype(np.uint32))
    return out


def prefix_keys(signed: np.ndarray, depth: int) -> list[int]:
    """A key for each tree and its label's first ``depth`` values, as signed 64-bit integers; the last five bits are the tree."""
    labels = signed.reshape(TREES, DEPTH)[:, :depth]
    hashed = [xxhash.xxh3_64_intdigest(label.tobytes(), tree) & ~31 | tree for tree, label in enumerate(labels)]
    return [h - (1 << 64) if h >> 63 else h for h in hashed]


def set_key(runs: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(runs.tobytes()) + f"{len(runs):x}"


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which pairs at the threshold meet with the target recall, shortened from whole labels."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def signatures(docs: DataFrame, depth: int) -> DataFrame:
    """``uid, doc_id, text_key, set_key, n_shingles, weight, prefixes, signature``: a row per document. Written once.

    ``prefixes`` holds the key of each tree's prefix, ``signature`` one byte of each minimum, which is enough to compare by.
    """
    text = F.coalesce("text", F.lit(""))
    table = numbered(docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for uid, doc_id, key, text in zip(*(batch.column(c) for c in ("uid", "doc_id", "text_key", "text")), strict=True):
                    whole = text.as_py()
                    runs = shingles(whole)
                    signed = signature(runs)
                    sizes = len(runs), max(len(runs), len(whole) // 8)
                    found = prefix_keys(signed, depth), signed.astype(np.uint8).tobytes()
                    yield uid.as_py(), doc_id.as_py(), key.as_py(), set_key(runs), *sizes, *found

        names = ["uid", "doc_id", "text_key", "set_key", "n_shingles", "weight", "prefixes", "signature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        yield from _batches(rows(), names, types, 512)

    schema = "uid long, doc_id long, text_key long, set_key string, n_shingles long, weight long, prefixes array<long>, signature binary"
    return materialize(table.mapInArrow(run, schema), "signatures")


def distinct_sets(signed: DataFrame) -> DataFrame:
    """``node, set_key, text_key, weight, copies, prefixes, signature``: one row per different shingle set that is not empty."""
    filled = signed.filter("n_shingles > 0")
    return filled.groupBy("set_key").agg(
        F.min("uid").alias("node"),
        F.min_by("text_key", "uid").alias("text_key"),
        F.min_by("weight", "uid").alias("weight"),
        F.count(F.lit(1)).alias("copies"),
        F.first("prefixes").alias("prefixes"),
        F.first("signature").alias("signature"),
    )


def grouped(rows: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, from batches sorted by them."""
    key, held = None, []
    for batch in rows:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key and held:
                    yield key, held
                    held = []
                key = now
                held.append(row)
    if held:
        yield key, held


def leaders(nodes: np.ndarray, signs: np.ndarray, covered: float = COVERED, near: float = NEAR) -> list[tuple[int, int]]:
    """``(node, leader)`` for all nodes of one prefix; a leader is paired with itself."""
    out: list[tuple[int, int]] = []
    rest = np.arange(len(nodes))
    while len(rest):
        lead, others = rest[0], rest[1:]
        out.append((int(nodes[lead]), int(nodes[lead])))
        likeness = (signs[others] == signs[lead]).mean(axis=1)
        out += [(int(nodes[i]), int(nodes[lead])) for i in others[likeness >= near]]
        rest = others[likeness < covered]
    return out


def forest_pairs(nodes: np.ndarray, signs: np.ndarray, tails: np.ndarray) -> list[tuple[int, int]]:
    """``(node, leader)`` of the nodes under a tree's shortest prefix, from whole labels upwards.

    ``tails`` holds each label's values after that prefix. What a leader covers stops; leaders go on to the shorter prefix.
    """
    out: list[tuple[int, int]] = []
    going = np.lexsort((nodes, *tails.T[::-1]))
    for kept in range(tails.shape[1], -1, -1):
        labels = tails[going, :kept]
        starts = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]).any(axis=1)])
        limit = COVERED if kept == tails.shape[1] else LEADER_COVERED
        leading = []
        for run in np.split(going, starts[1:]):
            pairs = leaders(nodes[run], signs[run], limit)
            out += pairs
            leads = {lead for _, lead in pairs}
            leading += [i for i in run if nodes[i] in leads]
        going = np.array(leading, np.int64)
    return out


def rooted(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """For each node of ``pairs`` the smallest node it is connected to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def prefix_matches(sets: DataFrame, depth: int) -> DataFrame:
    """``a, b``: nodes and the smallest node of the family they are near to under a prefix, over all trees."""
    # narrow rows find the prefixes that two texts share; signatures go only where they are compared
    members = sets.select("node", F.explode("prefixes").alias("prefix"))
    sizes = members.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    parts = F.ceil(F.col("rows") / PART_ROWS).cast("int")
    together = members.join(sizes, "prefix").withColumn("parts", parts)
    dealt = together.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def compare(heads: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for (prefix, _), held in grouped(batches, ["prefix", "part"]):
                    nodes = np.array([r["node"] for r in held], np.int64)
                    signs = np.frombuffer(b"".join(r["signature"] for r in held), np.uint8).reshape(len(held), -1)
                    tails = signs.reshape(len(held), TREES, DEPTH)[:, prefix & 31, depth:]
                    pairs = leaders(nodes, signs, LEADER_COVERED) if heads else forest_pairs(nodes, signs, tails)
                    roots, leads = rooted(pairs), {b for _, b in pairs}
                    parts = held[0]["parts"]
                    for r in held:
                        a = r["node"]
                        if roots[a] != a or (parts > 1 and a in leads):
                            yield prefix, a, roots[a], parts, a in leads

            names = ["prefix", "a", "b", "parts", "leads"]
            yield from _batches(rows(), names, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()])

        return run

    def compared(rows: DataFrame, heads: bool) -> DataFrame:
        signed = rows.join(sets.select("node", "signature"), "node").select("prefix", "part", "node", "signature", "parts")
        in_order = signed.repartition("prefix", "part").sortWithinPartitions("prefix", "part", "node")
        return in_order.mapInArrow(compare(heads), "prefix long, a long, b long, parts int, leads boolean")

    first = materialize(compared(dealt, False), "prefix-matches")
    near = first.filter("a <> b").select("a", "b")
    heads = first.filter("parts > 1 and leads").select("prefix", F.col("a").alias("node"))
    if heads.isEmpty():
        return near
    # every two leaders of a prefix meet in one pair of blocks
    crowds = heads.groupBy("prefix").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("blocks"))
    placed = heads.join(crowds, "prefix").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    return near.unionByName(compared(met.select("prefix", "node", part.alias("part"), F.lit(1).alias("parts")), True).select("a", "b"))


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the sizes of its intersections with all sets, from inverted lists."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    lists = owner[order]
    begins = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(values)))])
    at = 0
    for i, s in enumerate(sets):
        mine = inverse[at : at + len(s)]
        at += len(s)
        lo, n = begins[mine], begins[mine + 1] - begins[mine]
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        yield i, np.bincount(lists[steps], minlength=len(sets))


def verified(members: list[dict], within: bool, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """``(node, root, links, texts)`` of the members with a link: between two blocks, or inside one."""
    sets = [shingles(m["text"]) for m in members]
    sizes = np.array([len(s) for s in sets])
    side = np.array([m["block"] for m in members])
    copies = np.array([m["copies"] for m in members])
    nodes = np.array([m["node"] for m in members])
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, texts = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    for i, common in overlaps(sets):
        linked = common >= threshold * (sizes[i] + sizes - common) - 1e-9
        linked &= (np.arange(len(sets)) != i) & (within | (side != side[i]))
        links[i], texts[i] = copies[linked].sum(), linked.sum()
        for j in np.flatnonzero(linked):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    for i in np.flatnonzero(texts):
        yield int(nodes[i]), int(nodes[find(i)]), int(links[i]), int(texts[i])


def among(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``text_key, text`` of the rows of ``docs`` whose key may be one of ``members``: a bitmap of fixed size, some others pass."""
    place = F.pmod(F.xxhash64("text_key"), F.lit(FILTER_BITS))
    bucket, bit = F.floor(place / ROW_BITS).cast("int"), (place % ROW_BITS).cast("int")
    marks = members.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).withColumns({"bucket": bucket, "bit": bit})
    # at most FILTER_BITS / ROW_BITS rows of 4 KB
    marked = keyed.join(F.broadcast(marks), "bucket")
    isset = F.expr("shiftright(cast(conv(hex(substring(bits, bit div 8 + 1, 1)), 16, 10) as int), bit % 8) % 2 = 1")
    return marked.filter(isset).select("text_key", "text")


def verified_links(docs: DataFrame, sets: DataFrame, families: DataFrame, threshold: float) -> DataFrame:
    """``node, root, links, texts``: exact links of each text, by blocks; a node may have several rows."""
    members = materialize(
        families.select("node", F.col("label").alias("family")).join(sets.drop("signature", "prefixes", "set_key"), "node"), "family-members"
    )
    sizes = members.groupBy("family").agg(F.sum("weight").alias("total"))
    placed = lookup(members, materialize(sizes, "family-sizes"), ["family"], "inner")
    placed = placed.withColumn("blocks", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    # texts of members only; equal texts are reduced before they are shuffled
    texts = among(docs, members).groupBy("text_key").agg(F.first("text").alias("text"))
    full = placed.join(texts, "text_key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = full.withColumn("_other", other).select(
        "family",
        F.least("block", "_other").alias("one"),
        F.greatest("block", "_other").alias("two"),
        "block",
        "node",
        "copies",
        "text",
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (_, one, two), held in grouped(batches, ["family", "one", "two"]):
                yield from verified(held, one == two, threshold)

        yield from _batches(rows(), ["node", "root", "links", "texts"], [pa.int64()] * 4)

    dealt = pairs.repartition("family", "one", "two").sortWithinPartitions("family", "one", "two", "node")
    return materialize(dealt.mapInArrow(verify, "node long, root long, links long, texts long"), "verified-links")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``uid, doc_id, text_key, class_id, n_links, n_copies``: one row per document.

    ``n_links`` counts the other documents at or above the threshold, ``n_copies`` those with equal shingles, itself included.
    """
    depth = prefix_depth(threshold)
    signed = signatures(docs, depth)
    sets = materialize(distinct_sets(signed), "distinct-sets")
    families = components(prefix_matches(sets, depth))
    links = verified_links(docs, sets, families, threshold)
    linked = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        sets.select("set_key", "node", "copies")
        .join(counted, "node", "left")
        .join(linked, "node", "left")
        .select("set_key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    )
    each = signed.select("uid", "doc_id", "text_key", "set_key", "n_shingles").join(named, "set_key", "left")
    alone = F.col("n_shingles") == 0
    marked = materialize(
        each.select(
            "uid",
            "doc_id",
            "text_key",
            F.when(alone, F.col("uid")).otherwise(F.col("label")).alias("label"),
            F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
            F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
        ),
        "classes",
    )
    first = marked.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("_first"))
    return lookup(marked, materialize(first, "class-firsts"), ["label"], "inner")


def linked_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return classes(docs, threshold).select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest ``doc_id``, then of the smallest text key.

    Of rows equal in both, one stays.
    """
    found = classes(docs, threshold)
    first = found.select(F.col("_first.doc_id").alias("_d"), F.col("_first.text_key").alias("_k")).distinct()
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    keyed = docs.select(row, F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    kept = keyed.join(first, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left_semi")
    # repeated rows of the chosen documents only
    one = kept.groupBy("_doc", "_key").agg(F.first("_row").alias("_row"))
    return one.select(*[F.col("_row")[c].alias(c) for c in docs.columns])

