"""Keyed tables that micro-batches are merged into."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketedTable:
    """A table of one row a key, the last one by ``order``, in buckets of keys.

    A merge reads and writes only the buckets that its batch touches, each in a folder of its own version, so
    readers of older versions aren't disturbed. Then a manifest, which names every bucket's folder, the schema and the
    batch, is written beside the data and renamed into place: a batch is merged as a whole or not at all. A table
    that is opened again reads the latest manifest, so a restarted query goes on where it ended, and a batch that is
    merged already, or one before it, changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, *order: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.at: dict[int, str] = {}
        self.schema: T.StructType | None = None
        self.batch = -1
        self._open()

    # --- manifests --------------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _open(self) -> None:
        Path, fs, at = self._fs()
        if not fs.exists(at):
            return
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        batches = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
        if not batches:
            return
        stream = fs.open(Path(f"{self.path}/manifests/{max(batches)}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if found["buckets"] != self.buckets or found["key"] != self.key:
            raise ValueError(f"{self.path} has {found['buckets']} buckets of {found['key']}")
        self.batch, self.schema = found["batch"], T.StructType.fromJson(found["schema"])
        self.at = {int(b): p for b, p in found["at"].items()}

    def _commit(self, number: int, at: dict[int, str], schema: T.StructType) -> None:
        Path, fs, _ = self._fs()
        draft, final = (Path(f"{self.path}/manifests/{n}") for n in (f"_{number}", f"{number}.json"))
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps({"batch": number, "key": self.key, "buckets": self.buckets, "schema": schema.jsonValue(), "at": at}).encode()))
        finally:
            out.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"batch {number} is merged by another writer")
        self.batch, self.at, self.schema = number, at, schema

    # --- rows -------------------------------------------------------------------------------------

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merge ``batch``; ``number`` grows from batch to batch, and one that was merged isn't merged again."""
        if number <= self.batch:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = batch.withColumn("_bucket", bucket).persist()
        try:
            touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most ``buckets`` rows
            old = [self.at[b] for b in touched if b in self.at]
            every = rows.unionByName(self.spark.read.schema(batch.schema).parquet(*old).withColumn("_bucket", bucket)) if old else rows
            last = every.groupBy("_bucket", self.key).agg(F.max_by(F.struct(*batch.columns), F.struct(*self.order)).alias("_row"))
            version = f"{self.path}/v{number}"
            if touched:
                last.select("_bucket", "_row.*").repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(version)
            self._commit(number, self.at | {b: f"{version}/_bucket={b}" for b in touched}, batch.schema)
        finally:
            rows.unpersist()

    def read(self) -> DataFrame:
        """All buckets, each in its latest version."""
        if not self.at:
            raise ValueError("nothing was merged into this table")
        return self.spark.read.schema(self.schema).parquet(*[self.at[b] for b in sorted(self.at)])
