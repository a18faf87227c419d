"""Running a stream through a batch sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state needs; the session's setting stays."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_available(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs all input that has arrived through ``sink``; run it again for what arrives later."""
    return (
        rows.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def claim(spark: SparkSession, root: str) -> None:
    """Keeps the id of the stream that writes under ``root`` there, and refuses any other stream.

    A stream with a new checkpoint counts its batches from 0 again and would replace the parts of the old one.
    A sink that is called outside a stream claims nothing.
    """
    own = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not own:
        return
    path = f"{root}/stream"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.range(1).selectExpr(f"'{own}' AS id").coalesce(1).write.mode("overwrite").parquet(path)
        return
    held = spark.read.schema("id string").parquet(path).first()["id"]
    if held != own:
        raise RuntimeError(f"{root} belongs to the stream {held}; give this one, {own}, a folder of its own")
