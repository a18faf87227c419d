"""A stored index of keys, so that a batch looks its keys up without reading all of history.

``<path>/bucket=B/batch_id=N`` holds the keys that batch ``N`` added whose first two hex digits are ``B``, sorted, with a
Parquet Bloom filter.  A lookup opens the buckets its keys fall into; few keys go into the scan as a filter, which skips
row groups by statistics and Bloom filter, many are joined.  ``<path>-top/batch_id=N`` is one row: the highest id up
to batch ``N``.  A batch written again replaces its own parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

POINT_KEYS = 500
"""Up to this many keys are looked up by a filter pushed into the scan."""
BUCKETS = 256


@dataclass(frozen=True)
class KeyIndex:
    """An index of ``key`` (hex digests) to ``id`` under ``path``."""

    path: str
    key: str

    @property
    def schema(self) -> StructType:
        return StructType([StructField(self.key, StringType()), StructField("id", LongType())])

    def _names(self, spark: SparkSession, path: str) -> set[str]:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        return {s.getPath().getName() for s in files.listStatus(root)} if files.exists(root) else set()

    def _bucket(self):
        return F.conv(F.substring(self.key, 1, 2), 16, 10).cast("int")

    def top(self, spark: SparkSession, before: int) -> int:
        """The highest id of the batches before ``before``."""
        parts = [int(n.removeprefix("batch_id=")) for n in self._names(spark, f"{self.path}-top") if n.startswith("batch_id=")]
        earlier = [n for n in parts if n < before]
        if not earlier:
            return 0
        return spark.read.schema("id bigint").parquet(f"{self.path}-top/batch_id={max(earlier)}").first()[0]

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """``(key, id)`` of the stored ones among ``keys`` (distinct, staged), from the batches before ``before``."""
        spark = keys.sparkSession
        few = [r[0] for r in keys.limit(POINT_KEYS + 1).collect()]
        if len(few) <= POINT_KEYS:
            hit = {int(k[:2], 16) for k in few}
        else:
            hit = {r[0] for r in keys.select(self._bucket()).distinct().collect()}
        there = self._names(spark, self.path)
        folders = [f"{self.path}/bucket={b}" for b in sorted(hit) if f"bucket={b}" in there]
        if not folders:
            return spark.createDataFrame([], self.schema)
        full = StructType([*self.schema.fields, StructField("bucket", LongType()), StructField("batch_id", LongType())])
        stored = spark.read.schema(full).option("basePath", self.path).parquet(*folders)
        stored = stored.where(F.col("batch_id") < before).select(self.key, "id")
        if len(few) <= POINT_KEYS:
            return stored.where(F.col(self.key).isin(few))
        return stored.join(keys, self.key, "left_semi")

    def add(self, fresh: DataFrame, batch_id: int, top: int) -> None:
        """Stores the keys of batch ``batch_id``; ``top`` is the highest id with them."""
        spark = fresh.sparkSession
        rows = fresh.select(self.key, "id", self._bucket().alias("bucket"), F.lit(batch_id).alias("batch_id"))
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", self.key)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id")
        writer = writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        # a filter as large as the bucket's keys ask for: without this each of the buckets takes 1 MB in every batch
        expected = 2 * fresh.count() // BUCKETS + 64
        writer.option(f"parquet.bloom.filter.expected.ndv#{self.key}", str(expected)).parquet(self.path)
        spark.range(1).select(F.lit(top).alias("id")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}-top/batch_id={batch_id}"
        )

    def exists(self, spark: SparkSession) -> bool:
        return bool(self._names(spark, f"{self.path}-top"))
