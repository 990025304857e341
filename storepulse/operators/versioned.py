"""Keyed tables that a batch changes in part.

The rows of a table lie in hash buckets of their key. A batch reads and rewrites only the buckets that hold one of
its keys, in a folder of its own version; the version's manifest names, for every bucket, the version whose folder
holds it, and counts once Spark's writer has marked it complete. What is current is found in storage, so a restart
goes on from the newest complete version, and a batch that runs again starts from the version before its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionedTable:
    """A table of ``schema`` under ``root``, bucketed by ``key``. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: T.StructType | str, n_buckets: int = 16):
        self.spark, self.root, self.key, self.n_buckets = spark, root.rstrip("/"), key, n_buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.n_buckets)).cast("int")

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [s.getPath() for s in files.listStatus(path)]
        return sorted(int(p.getName()[2:]) for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def places(self, before: int | None = None) -> dict[int, int]:
        """Bucket to the version that holds it, as of the newest version (before ``before``)."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.root}/manifest/v={known[-1]}").collect()}  # a row per bucket

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Current rows (as of before a version), of all or some buckets."""
        held = [(b, v) for b, v in sorted(self.places(before).items()) if buckets is None or b in buckets]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/v={v}/_bucket={b}" for b, v in held])

    def change(self, version: int, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Write ``version``: ``merge(rows of the touched buckets, batch)`` replaces these buckets, all others stay where
        they are. Returns the touched buckets. The batch should be a written or cached one, as it is read more than once."""
        touched = sorted(r[0] for r in batch.select(self.bucket().alias("_bucket")).distinct().collect())  # bounded by the buckets
        places = {b: v for b, v in self.places(version).items() if b not in touched}
        if touched:
            rows = merge(self.read(version, touched), batch).select(*self.schema.names).withColumn("_bucket", self.bucket())
            folder = f"{self.root}/data/v={version}"
            rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
            kept = self.spark.read.parquet(folder).select("_bucket").distinct().collect() if self._some(folder) else []
            places |= {int(r[0]): version for r in kept}
        self.spark.createDataFrame(sorted(places.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        return touched

    def _some(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return any(s.isDirectory() for s in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))
