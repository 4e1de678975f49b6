"""Write a book corpus as tables partitioned by site bucket, all of them at once.

A write puts its files into folders of its own, ``<table>/v=<version>/site_bucket=…``. What counts is the
newest manifest below ``_manifests``: it names, for each table, the version that holds each bucket. It is
written last and put in place by one rename, so a reader sees the tables of one write or of the one
before, and a write which ends half-way changes nothing. A write of some sites replaces the buckets these
are in and leaves the others where they are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

# sites share folders, so that many small sites do not make many small files
SITE_BUCKETS = 256
MANIFESTS = "_manifests"


@dataclass
class Manifest:
    """A committed state: per table its schema and the version of each bucket that has rows."""

    number: int
    buckets: int
    tables: dict[str, dict]


class _Folder:
    """A folder on the file system that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.to_path = jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self.to_path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.read = lambda p: jvm.org.apache.commons.io.IOUtils.toString(self.fs.open(p), "UTF-8")

    def at(self, name: str):
        return self.to_path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        where = self.at(name)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def put(self, name: str, text: str) -> bool:
        """A whole file under its name, or False where that name is taken."""
        draft = self.at(f"{MANIFESTS}/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        done = not self.fs.exists(self.at(name)) and self.fs.rename(draft, self.at(name))
        if not done:
            self.fs.delete(draft, False)
        return done


def newest_manifest(spark: SparkSession, path: str) -> Manifest | None:
    folder = _Folder(spark, path)
    names = [n for n in folder.names(MANIFESTS) if n.endswith(".json")]
    return Manifest(**json.loads(folder.read(folder.at(f"{MANIFESTS}/{names[-1]}")))) if names else None


def site_bucket(buckets: int = SITE_BUCKETS):
    return F.pmod(F.xxhash64("site"), F.lit(buckets)).cast("int")


def read_book_table(spark: SparkSession, path: str, name: str, manifest: Manifest | None = None) -> DataFrame:
    """A table of the newest state, or of the one given, with its ``site_bucket``."""
    manifest = manifest or newest_manifest(spark, path)
    if manifest is None or name not in manifest.tables:
        raise FileNotFoundError(f"no table {name} below {path}")
    table = manifest.tables[name]
    schema = StructType.fromJson(table["schema"]).add("site_bucket", IntegerType())
    folders = sorted(f"{path.rstrip('/')}/{name}/v={version}/site_bucket={b}" for b, version in table["versions"].items())
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema.add("v", StringType())).option("basePath", f"{path.rstrip('/')}/{name}").parquet(*folders)
    return found.drop("v")


def write_book_dataset(
    tables: dict[str, DataFrame], path: str, buckets: int = SITE_BUCKETS, sites: DataFrame | None = None
) -> Manifest:
    """Write all tables as the next state of the dataset at ``path``.

    With ``sites`` (a column ``site``) the tables hold the rows of these sites only, and other sites
    keep theirs. Rows are dealt by bucket and evened out by bytes while they are shuffled: a hot site
    is spread over several files, small buckets share a task. Each table's plan runs once. Fails, leaving
    the dataset as it is, when another write has committed meanwhile.
    """
    spark = next(iter(tables.values())).sparkSession
    before = newest_manifest(spark, path)
    if sites is not None and before is not None and before.buckets != buckets:
        raise ValueError(f"the dataset has {before.buckets} buckets, not {buckets}")
    folder = _Folder(spark, path)
    version = uuid.uuid4().hex
    old = before.tables if before and sites is not None else {}
    # one row per bucket
    touched = [r[0] for r in sites.select(site_bucket(buckets)).distinct().collect()] if sites is not None else []
    done = {}
    for name, df in tables.items():
        rows = df.withColumn("site_bucket", site_bucket(buckets))
        kept = {b: v for b, v in old.get(name, {"versions": {}})["versions"].items() if int(b) not in touched}
        if name in old and touched:
            others = read_book_table(spark, path, name, before).filter(F.col("site_bucket").isin(*touched))
            rows = rows.unionByName(others.join(sites.select("site").distinct(), "site", "left_anti"))
        rows.hint("rebalance", "site_bucket").write.partitionBy("site_bucket").parquet(f"{path.rstrip('/')}/{name}/v={version}")
        new = [n.split("=")[1] for n in folder.names(f"{name}/v={version}") if n.startswith("site_bucket=")]
        done[name] = {"schema": df.schema.jsonValue(), "versions": kept | dict.fromkeys(new, version)}
    carried = {name: table for name, table in old.items() if name not in done}
    manifest = Manifest((before.number if before else 0) + 1, buckets, carried | done)
    if not folder.put(f"{MANIFESTS}/{manifest.number:012d}.json", json.dumps(vars(manifest))):
        raise RuntimeError(f"another write has committed state {manifest.number} of {path}")
    return manifest


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Delete what the newest manifest does not name, once nobody reads older states or writes a new one."""
    manifest, folder = newest_manifest(spark, path), _Folder(spark, path)
    if manifest is None:
        return
    for name in folder.names(MANIFESTS):
        if name != f"{manifest.number:012d}.json":
            folder.fs.delete(folder.at(f"{MANIFESTS}/{name}"), False)
    for table in folder.names(""):
        if table == MANIFESTS:
            continue
        used = manifest.tables.get(table, {"versions": {}})["versions"]
        for version in (n for n in folder.names(table) if n.startswith("v=")):
            for bucket in (n for n in folder.names(f"{table}/{version}") if n.startswith("site_bucket=")):
                if used.get(bucket.split("=")[1]) != version[2:]:
                    folder.fs.delete(folder.at(f"{table}/{version}/{bucket}"), True)
            if version[2:] not in used.values():
                folder.fs.delete(folder.at(f"{table}/{version}"), True)
