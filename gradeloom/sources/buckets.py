"""A table in buckets that is changed by whole buckets: only those that an update touches are written anew."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketTable:
    """Parquet folders, one a bucket of the key's hash, and manifests that name the folder of each bucket.

    A change writes the touched buckets to a new folder and then a new manifest under the next number, by a
    rename that fails if that number is there: readers see the table before or after, never between, and of two
    writers one has an error. A manifest holds the last batch of each writer; a batch that comes again changes nothing.
    All files go through Hadoop's file system of the path, so any store that Spark reads will do.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets
        jvm = spark._jvm
        self.of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests

    def version(self) -> int:
        """The number of the last manifest, -1 without one."""
        folder = self.of(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return {"buckets": {}, "batches": {}, "bytes": 0}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version}", wholetext=True).first()[0])

    def _commit(self, version: int, manifest: dict) -> None:
        made, to = self.of(f"{self.path}/manifest/.{version}-{self.spark._jvm.java.util.UUID.randomUUID()}"), self.of(f"{self.path}/manifest/{version}")
        out = self.fs.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.fs.exists(to) or not self.fs.rename(made, to):
            raise RuntimeError(f"version {version} of {self.path} was written by someone else")

    # --- reading and changing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        held = self.manifest(version)["buckets"]
        paths = [p for b, p in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, new: DataFrame, merge, batch_id: int | None = None, writer: str = "") -> dict:
        """Put ``merge(rows of the touched buckets, new)`` in place of these buckets; ``new`` needs the keys.

        Returns {"touched", "bytes"}: buckets and bytes written; nothing for a batch that was seen.
        """
        version = self.version()
        now = self.manifest(version)
        if batch_id is not None and now["batches"].get(writer, -1) >= batch_id:
            return {"touched": 0, "bytes": 0}
        touched = sorted(r[0] for r in new.select(self._bucket().alias("b")).distinct().collect())  # at most the number of buckets
        folder = f"data/{version + 1}"
        rows = merge(self.read(touched, version), new)
        if touched:
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._fields()]).withColumn("__bucket", self._bucket())
            rows.repartition(min(len(touched), self.buckets), "__bucket").sortWithinPartitions("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        size, held = 0, dict(now["buckets"])
        for b in touched:
            path = f"{folder}/__bucket={b}"
            held.pop(str(b), None)
            if self.fs.exists(self.of(f"{self.path}/{path}")):  # else nothing is left of the bucket
                held[str(b)] = path
                size += self.fs.getContentSummary(self.of(f"{self.path}/{path}")).getLength()
        batches = dict(now["batches"]) | ({} if batch_id is None else {writer: batch_id})
        self._commit(version + 1, {"buckets": held, "batches": batches, "bytes": size})
        return {"touched": len(touched), "bytes": size}

    def _fields(self):
        return self.spark.createDataFrame([], self.schema).schema.fields

    def upsert(self, new: DataFrame, batch_id: int | None = None, writer: str = "") -> dict:
        """New rows in place of those of the same key; of several new rows of a key the one that is largest in all columns counts."""
        names = [f.name for f in self._fields()]
        one = new.groupBy(*self.keys).agg(F.max(F.struct(*[c for c in names if c not in self.keys])).alias("r")).select(*self.keys, "r.*")

        def merge(old, new):
            kept = old.join(new.select(*self.keys), self.keys, "left_anti")
            return kept.select(names).unionByName(new.select(names))

        return self.change(one, merge, batch_id, writer)

    def add(self, deltas: DataFrame, batch_id: int | None = None, writer: str = "") -> dict:
        """Add numbers to the rows of their key; rows whose numbers are all 0 go."""
        numbers = [f.name for f in self._fields() if f.name not in self.keys]

        def merge(old, new):
            sums = old.unionByName(new.select(old.columns)).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in numbers])
            return sums.where(" OR ".join(f"{c} <> 0" for c in numbers))

        return self.change(deltas.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in numbers]), merge, batch_id, writer)


def buckets_for(size: int, target: int = 256 << 20) -> int:
    """Buckets of about ``target`` bytes each for a table that is to hold ``size`` bytes."""
    return max(1, math.ceil(size / target))
