"""Stored tables: whole snapshots for rewrites, numbered parts for appends.

A snapshot goes to ``<path>/v=N``; readers take the highest version whose write finished, so a path
being read is never overwritten and a failed write stays unseen.  Appends go to
``<path>/batch_id=N``; writing a batch again replaces only that part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType


def _list(spark: SparkSession, path: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    versions = sorted(int(name[2:]) for name in _list(spark, path) if name.startswith("v="))
    return [v for v in versions if "_SUCCESS" in _list(spark, f"{path}/v={v}")]


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    versions = complete_versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={versions[-1]}") if versions else None


def write_snapshot(df: DataFrame, path: str, version: int | None = None) -> int:
    """Writes the next version (or, for a replay, the given one) and returns its number."""
    if version is None:
        version = max(complete_versions(df.sparkSession, path), default=0) + 1
    in_id_order(df).write.mode("overwrite").parquet(f"{path}/v={version}")
    return version


def in_id_order(df: DataFrame) -> DataFrame:
    """Rows with an ``id`` in disjoint id ranges, so that a page's ids skip the other files."""
    return df.repartitionByRange("id").sortWithinPartitions("id") if "id" in df.columns else df


def write_part(df: DataFrame, path: str, batch_id: int, *, sort: bool = True) -> None:
    (in_id_order(df) if sort else df).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch_id={batch_id}")


def has_parts(spark: SparkSession, path: str) -> bool:
    return any(name.startswith("batch_id=") for name in _list(spark, path))


def read_parts(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """All parts, or those of earlier batches; the filter prunes folders."""
    if not has_parts(spark, path):
        return spark.createDataFrame([], schema)
    full = StructType(list(schema.fields)).add("batch_id", LongType())
    rows = spark.read.schema(full).parquet(path)
    return (rows if before is None else rows.where(F.col("batch_id") < before)).drop("batch_id")


def compact_parts(spark: SparkSession, path: str, schema: StructType, target: str) -> int:
    """Rewrites all parts as one part under ``target``, numbered as the last of them.

    Many small batches leave many small files; a stopped stream goes on under ``target`` and its next
    batch still follows the last one.
    """
    last = max(int(name.removeprefix("batch_id=")) for name in _list(spark, path) if name.startswith("batch_id="))
    write_part(read_parts(spark, path, schema), target, last)
    return last
