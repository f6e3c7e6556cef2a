"""Versioned tables on a shared folder: a writer's rows are seen whole or not at all.

Each write goes to a folder of its own; then a commit file is created, which names the
folders that now make up the table. Creating a file that must not exist yet is the one atomic step
that file systems and object stores share, so a write that fails, or a second writer of the
same version, leaves the table as it was. Readers take the highest commit.

``write_version`` replaces the whole table. ``merge_buckets`` keeps a table by key in a fixed
number of buckets and rewrites only the buckets that a batch touches: what a reader
scans does not grow with the number of batches, and a batch that is replayed finds its
commit and does nothing. ``vacuum`` removes folders that no recent commit names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WIDTH = 12


class Commits:
    """The commit files of a table's folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.base = self.jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        self.fs = self.base.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self._path("_commits")

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.base, name)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(self.folder) if f.getPath().getName().isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.folder, f"{number:0{_WIDTH}d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> dict | None:
        own = self.numbers()
        return self.read(own[-1]) if own else None

    def add(self, number: int, content: dict) -> bool:
        """False if that commit is there already."""
        at = self.jvm.org.apache.hadoop.fs.Path(self.folder, f"{number:0{_WIDTH}d}")
        if self.fs.exists(at):
            return False
        try:
            stream = self.fs.create(at, False)
        except Exception as e:                          # another writer was first
            if "AlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Remove data folders that none of the last ``keep`` commits names; their number."""
        named = {f.split("/")[1] for n in self.numbers()[-keep:] for f in self.read(n)["folders"].values()}
        data, gone = self._path("data"), 0
        if self.fs.exists(data):
            for f in self.fs.listStatus(data):
                if f.getPath().getName() not in named:
                    gone += bool(self.fs.delete(f.getPath(), True))
        return gone


def write_version(df: DataFrame, path: str) -> int:
    """Replace the table at ``path`` by ``df``; the new version's number. The old version stays readable
    until the commit, and after it for those who read it already."""
    commits = Commits(df.sparkSession, path)
    number = (commits.numbers() or [-1])[-1] + 1
    folder = f"data/{number}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{folder}")
    if not commits.add(number, {"folders": {"all": folder}, "schema": df.schema.json()}):
        raise RuntimeError(f"version {number} of {path} was committed by another writer")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The table's current (or an earlier) version; None before the first commit."""
    from pyspark.sql.types import StructType
    commits = Commits(spark, path)
    entry = commits.latest() if number is None else commits.read(number)
    if entry is None:
        return None
    schema = StructType.fromJson(json.loads(entry["schema"]))
    folders = [f"{path.rstrip('/')}/{f}" for f in entry["folders"].values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_buckets(batch: DataFrame, path: str, number: int, key: str, buckets: int,
                  merge: Callable[[DataFrame], DataFrame]) -> bool:
    """Commit ``merge(old rows of the touched buckets + batch)`` as version ``number``; False if that
    version is there already (a replayed batch)."""
    spark = batch.sparkSession
    commits = Commits(spark, path)
    if number in commits.numbers():
        return False
    entry = commits.latest() or {"folders": {}, "schema": batch.schema.json()}
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    touched = [str(r[0]) for r in batch.select(bucket).distinct().collect()]      # at most ``buckets``
    rows, folders = batch, dict(entry["folders"])
    old = [f"{path.rstrip('/')}/{folders[b]}" for b in touched if b in folders]
    if old:
        rows = spark.read.schema(batch.schema).parquet(*old).unionByName(batch)
    if touched:
        folder = f"data/{number}-{uuid.uuid4().hex}"
        merged = merge(rows).select(*batch.columns).withColumn("__bucket", bucket)
        merged.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path.rstrip('/')}/{folder}")
        folders |= {b: f"{folder}/__bucket={b}" for b in touched}
    return commits.add(number, {"folders": folders, "schema": batch.schema.json()})
