"""A table with one row a key that is kept in hash buckets, of which a change rewrites only those it touches.

Layout: ``data/<version>-<attempt>/_bucket=<n>/`` holds the rows of a bucket as of a version; ``manifests/<version>`` is a table of (bucket, folder) for all
buckets that have rows. A version counts once its manifest is complete, which is written last, so readers see all of it or nothing and
what a lost writer left is never read. A version that is applied again starts from the one before it, so a replayed batch gives the same state.
Folders that neither of the newest two versions reads are deleted. There is one writer at a time, as of a streaming query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType())])


class BucketTable:
    """The table at a path that all machines reach. ``buckets`` is fixed for the life of the table: rows of a bucket should stay within what a few tasks rewrite at once."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 256):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def versions(self) -> list[int]:
        """Complete versions, in order."""
        return sorted(int(n) for n in self._names("manifests") if self._fs.exists(self._at(f"manifests/{n}/_SUCCESS")))

    def folders(self, version: int) -> dict[int, str]:
        """The folder of each bucket that has rows; at most ``buckets`` entries."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{version:012d}").collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The rows of the last version (below a number); None if there is none or it has no rows."""
        known = [v for v in self.versions() if before is None or v < before]
        folders = self.folders(known[-1]) if known else {}
        return self._read(sorted(folders.values())) if folders else None

    def apply(self, version: int, changes: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> int:
        """Makes the version from the one before it and a batch of changes; the number of buckets that were written.

        ``merge(before, changes)`` gives the rows of the touched buckets from what they hold (None: nothing) and all changes; every row of it must have the key of one of these.
        """
        known = [v for v in self.versions() if v < version]
        held = self.folders(known[-1]) if known else {}
        touched = [r[0] for r in changes.select(self._bucket().alias("b")).distinct().collect()]  # numbers of buckets
        old = [held[b] for b in touched if b in held]
        rows = merge(self._read(old) if old else None, changes).withColumn("_bucket", self._bucket())
        folder = f"data/{version:012d}-{uuid.uuid4().hex}"
        # A bucket is one task's rows unless Spark splits them, so a version adds few files.
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        written = {int(n.split("=")[1]) for n in self._names(folder) if n.startswith("_bucket=")}
        kept = {b: f for b, f in held.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in written}
        self.spark.createDataFrame(sorted(kept.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{version:012d}")
        self._forget(version)
        return len(written)

    def _forget(self, version: int) -> None:
        """Deletes versions before the last two up to this one, and what is not read any more."""
        known = [v for v in self.versions() if v <= version]
        for v in known[:-2]:
            self._fs.delete(self._at(f"manifests/{v:012d}"), True)
        used = {f for v in self.versions() if v >= (known[-2:] or [0])[0] for f in self.folders(v).values()}
        for name in self._names("data"):
            if int(name.split("-")[0]) > version:
                continue
            parts = [p for p in self._names(f"data/{name}") if p.startswith("_bucket=")]
            gone = [p for p in parts if f"data/{name}/{p}" not in used]
            if len(gone) == len(parts):
                self._fs.delete(self._at(f"data/{name}"), True)
            else:
                for p in gone:
                    self._fs.delete(self._at(f"data/{name}/{p}"), True)
