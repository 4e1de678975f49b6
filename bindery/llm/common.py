"""What the operators of this subpackage share: input columns, Python passes over batches, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bindery.session import materialize


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, dealt out again when it has fewer splits than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones cannot clash; a null text counts as empty."""
    return docs.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) if n == "text" else F.col(n) for n in names])


def numbered(docs: DataFrame, uid: str = "uid") -> DataFrame:
    """A number for each row. It holds only once the result is written: pass it on to a written table."""
    return docs.withColumn(uid, F.monotonically_increasing_id())


def give_back_memory() -> None:
    """At the end of a task: workers live on, and what they have freed is else kept for later tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def per_batch(df: DataFrame, schema: str, rows: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Apply ``rows`` to the columns of each Arrow batch; it returns the columns of ``schema``."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few rows at a time: texts may be very long
            for at in range(0, batch.num_rows, 512):
                out = rows(batch.slice(at, 512).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)
        give_back_memory()

    return df.mapInArrow(run, struct)


def ranked_rows(df: DataFrame, by: list[str], order: list[str], position: str, salts: int) -> DataFrame:
    """Add a 0-based rank within each group, of groups which may hold a third of all rows.

    A group is split into ``salts`` parts by a hash of ``order``; rows are numbered per part and
    moved up by the sizes of the parts before. Ranks are gapless and total, but follow the parts.
    ``order`` must be unique in a group. ``df`` is read twice: pass a written table.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    parts = df.groupBy(*by, part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*by, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    local = df.withColumn("_part", part).withColumn("_row", F.row_number().over(inside) - 1)
    return local.join(starts, [*by, "_part"]).withColumn(position, F.col("_start") + F.col("_row")).drop("_part", "_start", "_row")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: the smallest node of each node's connected component.

    Large-star and small-star steps on written edge tables (Kiveris et al., 2014). A step takes
    the least neighbour by an aggregate with map-side combining and joins it back; neighbours of
    a node are never gathered, and no edge leaves the cluster. Ends when no edge changes.
    """

    def undirected(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        # neighbours of a node: all of them (large), or the smaller ones (small)
        near = undirected(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = near.join(least, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        now = materialize(star(star(now, True), False), "edges")
        was, seen = seen, state(now)
        if was == seen:
            break
    # now every edge leads from a node to the smallest of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("label"))
    ).distinct()


__all__ = ["components", "give_back_memory", "materialize", "numbered", "own_columns", "per_batch", "ranked_rows", "read_table"]
