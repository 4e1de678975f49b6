"""Running computations over ordered groups, and lookups, which survive hot keys.

A site may hold a third of all rows, so a plain window by site would put that
third into one task. ``ordered_scan`` counts the groups first. When the largest
is small it uses a plain window. Otherwise rows are range-partitioned on
(group, order) into slices of similar size whatever the groups, each slice is
scanned on its own, and what earlier slices of the same group carry over is added
from a table with at most one row per slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.session import materialize, materialize_counted

# rows of one group a single task may scan
SAFE_GROUP_ROWS = 4_000_000
# slices whose carried values, a row each, may be broadcast
SAFE_CARRY_ROWS = 20_000
# slices which a limit below SAFE_GROUP_ROWS may ask for: each is a task, and samples and reports to the driver
SAFE_SLICES = 500
# rows on one side of a join which may be broadcast; narrow key rows only
SAFE_BROADCAST_ROWS = 200_000
# rows of one key above which a lookup spreads them
HOT_KEY_ROWS = 1_000_000
SALTS = 64


def group_sizes(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups; counts are combined map-side."""
    row = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def ordered_scan(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    position: str | None = None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    limit: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Add columns computed over the earlier rows of each group.

    ``position`` is the 0-based place in the group, ``sums`` the sum over earlier
    rows (0 at the start), ``lasts`` the last non-null value among earlier rows.
    ``order`` must be total inside a group. Pass narrow rows: ``df`` is read more
    than once. ``at_most`` is a known bound on the rows of any group, which saves
    counting when it is small enough. A ``limit`` of very few rows is exceeded by tables of which it would
    make more than ``SAFE_SLICES`` slices; slices never hold more than ``SAFE_GROUP_ROWS`` asks for.
    """
    sums, lasts = sums or {}, lasts or {}
    limit = SAFE_GROUP_ROWS if limit is None else limit
    largest, total = (at_most, 0) if at_most is not None and at_most <= limit else group_sizes(df, by)
    if largest <= limit:
        return df.select("*", *_running(by, order, position, sums, lasts))

    # slices as small as asked for, but no more of them than the driver keeps track of
    asked, needed = total // max(limit // 4, 1) + 1, total // (SAFE_GROUP_ROWS // 4) + 1
    slices = int(max(min(asked, max(needed, SAFE_SLICES)), 2))
    keyed = df.withColumns({f"_s_{n}": e for n, e in sums.items()} | {f"_l_{n}": e for n, e in lasts.items()})
    ranged = keyed.repartitionByRange(slices, *[F.col(c) for c in by], *order)
    table = materialize(ranged.withColumn("_slice", F.spark_partition_id()), "slices")

    held_sums = {n: F.col(f"_s_{n}") for n in sums}
    held_lasts = {n: F.col(f"_l_{n}") for n in lasts}
    local = table.select("*", *_running(["_slice", *by], order, position, held_sums, held_lasts))

    newest = Window.partitionBy("_slice", *by).orderBy(*order)
    last_value = [
        F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col("_row"))).alias(f"_c_{n}") for n, c in held_lasts.items()
    ]
    numbered = table.withColumn("_row", F.row_number().over(newest)) if lasts else table
    totals = numbered.groupBy("_slice", *by).agg(
        F.count("*").alias("_count"), *[F.sum(c).alias(f"_c_{n}") for n, c in held_sums.items()], *last_value
    )
    # a group has at most one row per slice here
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    keys = ["_slice", *by]
    carry = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        *[F.sum(c).over(earlier).alias(c) for c in ("_count", *[f"_c_{n}" for n in sums])],
        *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts],
    ).filter("_count is not null")
    # only the first group of a slice can continue from an earlier one: at most one row per slice
    match = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    joined = local.join(F.broadcast(carry) if slices <= SAFE_CARRY_ROWS else carry, match, "left")
    helpers = [f"_s_{n}" for n in sums] + [f"_l_{n}" for n in lasts] + [f"_k{i}" for i in range(len(keys))]
    done = joined.drop("_slice", *helpers)
    if position:
        done = done.withColumn(position, (F.col(position) + F.coalesce("_count", F.lit(0))).cast("int"))
    for n in sums:
        done = done.withColumn(n, F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)))
    for n in lasts:
        done = done.withColumn(n, F.coalesce(n, f"_c_{n}"))
    return done.drop("_count", *[f"_c_{n}" for n in (*sums, *lasts)])


def _running(by, order, position, sums, lasts) -> list[Column]:
    ordered = Window.partitionBy(*by).orderBy(*order)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    out = [(F.row_number().over(ordered) - 1).alias(position)] if position else []
    out += [F.coalesce(F.sum(e).over(earlier), F.lit(0)).alias(n) for n, e in sums.items()]
    out += [F.last(e, ignorenulls=True).over(earlier).alias(n) for n, e in lasts.items()]
    return out


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    right_rows: int | None = None,
    hot: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Join ``left`` to the row of ``right`` with the same key, ``right`` being unique on ``on``.

    A small ``right`` is broadcast after counting it (or by the given count).
    Otherwise the hot keys of ``left`` are counted, combined map-side; their rows are
    spread over salts and only the ``right`` rows of those keys are repeated per salt.
    Both sides may be read more than once, so pass tables or cheap expressions.
    """
    if right_rows is None:
        right_rows = right.limit(SAFE_BROADCAST_ROWS + 1).count()
    if right_rows <= SAFE_BROADCAST_ROWS and hot >= HOT_KEY_ROWS:
        return left.join(F.broadcast(right), on, how)
    heavy, n = materialize_counted(left.groupBy(*on).count().filter(F.col("count") > hot).select(*on), "heavy")
    if n == 0:
        return left.join(right, on, how)
    marks = heavy.withColumn("_heavy", F.lit(True))
    # at most rows / hot keys; the count is checked all the same
    marks = F.broadcast(marks) if n <= SAFE_BROADCAST_ROWS else marks
    salt = F.pmod(F.xxhash64(*[c for c in left.columns if c not in on] or on), F.lit(SALTS)).cast("int")
    repeats = F.sequence(F.lit(0), F.when(F.col("_heavy"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    salted = left.join(marks, on, "left").withColumn("_salt", F.when(F.col("_heavy"), salt).otherwise(0)).drop("_heavy")
    copies = right.join(marks, on, "left").withColumn("_salt", F.explode(repeats)).drop("_heavy")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
