"""What the operators of this subpackage share: reading, row identity, Arrow text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import lorekeep
from lorekeep.session import ship_package

BATCH_BYTES = 4 << 20
"""Texts handed to Python at once; bounds a worker's memory when documents are long."""
NO_ID = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def use_python(spark: SparkSession) -> None:
    """Sends the package to the workers and bounds the Arrow batches of the session by bytes."""
    ship_package(spark, lorekeep)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """``(k1, k2)``: names a row by its content, so that repeated ids with other texts stay apart.

    Rows equal in both are repeats of one row.  Null ids are told apart by ``k2``, 64 bits of the text's digest.
    """
    return [F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text, doc_id.isNull()).alias("k2")]


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``size`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = np.array([len(v) for v in as_bytes(batch.column(column))], np.int64)
        part = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))
