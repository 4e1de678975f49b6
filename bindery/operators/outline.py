"""Parents in an ordered list of levels: for each entry the nearest earlier one of a lower level.

A stack of the entries still open tells: entries of the same or a higher level are closed by the next
one, what is left on top is its parent, and the height is its depth. The stack never holds two entries
of one level, so it stays small however long a site is. Sites are scanned in order by streaming over
sorted partitions. A site too large for one task is cut into slices by range; each slice gives the
stack it ends with, these are put together along the slices (one small row each), and every slice is
scanned again from the stack it starts with. The plan does not depend on the number of levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.operators.scan import SAFE_GROUP_ROWS, group_sizes
from bindery.session import materialize

Stack = list[tuple[int, str]]


def _push(stack: Stack, level: int, ident: str) -> None:
    while stack and stack[-1][0] >= level:
        stack.pop()
    stack.append((level, ident))


def _with_parents(df: DataFrame, carried: dict[int, tuple[str, Stack]]) -> DataFrame:
    """Add ``parent_id, depth``; partitions hold whole groups of ``_slice, site`` in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack = None, []
        for batch in batches:
            parents, depths = [], []
            columns = [batch.column(c).to_pylist() for c in ("_slice", "site", "level", "id")]
            for part, site, level, ident in zip(*columns, strict=True):
                if (part, site) != group:
                    group = (part, site)
                    before, held = carried.get(part, (None, []))
                    stack = list(held) if before == site else []
                _push(stack, level, ident)
                parents.append(stack[-2][1] if len(stack) > 1 else None)
                depths.append(len(stack) - 1)
            columns = [*batch.columns, pa.array(parents, pa.string()), pa.array(depths, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "parent_id", "depth"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, parent_id string, depth int").drop("_slice")


def _last_stacks(df: DataFrame) -> DataFrame:
    """Per slice the site it ends in, whether it holds nothing else, and the stack at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack, first = None, [], True

        def told() -> pa.RecordBatch:
            levels, ids = [[x[0] for x in stack]], [[x[1] for x in stack]]
            row = {"slice": [group[0]], "site": [group[1]], "alone": [first], "levels": levels, "ids": ids}
            types = (pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            for part, site, level, ident in zip(*(batch.column(c).to_pylist() for c in ("_slice", "site", "level", "id")), strict=True):
                if (part, site) != group:
                    if group and group[0] != part:
                        yield told()
                    first = group is None or group[0] != part
                    group, stack = (part, site), []
                _push(stack, level, ident)
        if group:
            yield told()

    return df.select("_slice", "site", "level", "id").mapInArrow(run, "slice int, site string, alone boolean, levels array<int>, ids array<string>")


def parents_by_level(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Add ``parent_id`` (null at the top) and ``depth`` to entries ``site, id, level, order, page_id``."""
    limit = SAFE_GROUP_ROWS if limit is None else limit
    largest, total = group_sizes(entries, ["site"])
    order = ["site", "order", "page_id"]
    if largest <= limit:
        return _with_parents(entries.withColumn("_slice", F.lit(0)).repartition("site").sortWithinPartitions(*order), {})
    slices = int(max(total // max(limit // 4, 1) + 1, 2))
    ranged = entries.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    table = materialize(ranged, "outline").repartition(slices, "_slice").sortWithinPartitions("_slice", *order)
    carried: dict[int, tuple[str, Stack]] = {}
    site, stack = None, []
    for row in sorted(_last_stacks(table).collect()):  # a row per slice, of at most one entry per level
        if row.site != site or not row.alone:
            stack = []
        site, stack = row.site, [x for x in stack if x[0] < row.levels[0]] + list(zip(row.levels, row.ids, strict=True))
        carried[row.slice + 1] = (site, stack)
    return _with_parents(table, carried)
