"""Continuous capture: exact deduplication against all history, with optional analysis and promotion.

The stored captures are the deduplication state, so no streaming state grows without bound.  A
micro-batch looks its hashes up in an index beside the captures (``sources.keys``), which opens only the buckets they fall
into, and takes the highest id from a one-row file: what it reads does not grow with history.  It
appends one part per table, named by the batch id and computed only from earlier parts: a replayed
batch writes the same parts again.  What a batch stages on the way is removed when its parts are written.  The root belongs to one stream; another one's batch is refused.  What became of each row, and of each analysis, is kept in parts too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lorekeep import schemas as S
from lorekeep.operators.captures import captured_rows, keyed_captures
from lorekeep.operators.first_wins import outcomes, resolve_keys
from lorekeep.operators.solutions import created_solutions, keyed_creates
from lorekeep.plans.enrich import analyze_captures
from lorekeep.plans.promote import promotion_requests
from lorekeep.session import scratch, stage
from lorekeep.sources.keys import KeyIndex
from lorekeep.sources.tables import read_parts, write_part
from lorekeep.streaming.runner import claim

OUTCOME = StructType([StructField("seq", LongType()), StructField("outcome", StringType()), StructField("id", LongType())])
REPORT = StructType([StructField("id", LongType()), StructField("status", StringType()), StructField("error", StringType())])


@dataclass(frozen=True)
class CaptureSink:
    """A ``foreachBatch`` sink for ``(seq, content[, source, captured_at])`` rows under ``root``."""

    root: str
    auto_analyze: bool = False
    extractor: Callable | None = None
    model: str = ""
    provider: str = "rules"
    as_of: str | None = None

    def captures(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return read_parts(spark, f"{self.root}/captures", S.CAPTURE, before)

    def insights(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return read_parts(spark, f"{self.root}/insights", S.INSIGHT, before)

    def solutions(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return read_parts(spark, f"{self.root}/solutions", S.SOLUTION, before)

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """``(seq, outcome, id)`` per row taken in: ``created``, ``duplicate`` or ``empty``."""
        return read_parts(spark, f"{self.root}/outcomes", OUTCOME)

    def analyses(self, spark: SparkSession) -> DataFrame:
        """``(id, status, error)`` per capture analysed."""
        return read_parts(spark, f"{self.root}/analyses", REPORT)

    def _index(self, spark: SparkSession, table: str, key: str, batch_id: int) -> KeyIndex:
        """The index of a table; one that is missing beside earlier parts is built from them."""
        index = KeyIndex(f"{self.root}/{table}-keys", key)
        if not index.exists(spark) and batch_id > 0:
            held = read_parts(spark, f"{self.root}/{table}", S.CAPTURE if table == "captures" else S.SOLUTION, batch_id)
            index.add(held.select(key, "id"), batch_id - 1, held.agg(F.max("id")).first()[0] or 0)
        return index

    def _resolved(self, keyed: DataFrame, table: str, key: str, batch_id: int) -> DataFrame:
        """The batch's keys with their ids, staged; new ones enter the index."""
        spark = keyed.sparkSession
        index = self._index(spark, table, key, batch_id)
        top = index.top(spark, batch_id)
        keys = stage(keyed.where(F.col("reject").isNull()).select(key).distinct(), "batch-keys")
        resolved = stage(resolve_keys(keyed, index.lookup(keys, batch_id), key, top), "resolved-keys")
        fresh = resolved.where("is_new").select(key, "id")
        index.add(fresh, batch_id, max(top, fresh.agg(F.max("id")).first()[0] or 0))
        return resolved

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, self.root)
        with scratch(spark):
            keyed = keyed_captures(batch)
            resolved = self._resolved(keyed, "captures", "content_hash", batch_id)
            told = S.conform(outcomes(keyed, resolved, "content_hash"), OUTCOME)
            write_part(told, f"{self.root}/outcomes", batch_id, sort=False)
            write_part(captured_rows(batch, resolved, self.as_of), f"{self.root}/captures", batch_id)
        if self.auto_analyze:
            with scratch(spark):
                self._analyze(spark, batch_id)
            with scratch(spark):
                self._promote(spark, batch_id)

    def _analyze(self, spark: SparkSession, batch_id: int) -> None:
        part = spark.read.schema(S.CAPTURE).parquet(f"{self.root}/captures/batch_id={batch_id}")
        fresh, report = analyze_captures(
            part, None, self.extractor, model=self.model, provider=self.provider, as_of=self.as_of
        )
        write_part(report, f"{self.root}/analyses", batch_id, sort=False)
        write_part(fresh, f"{self.root}/insights", batch_id)

    def _promote(self, spark: SparkSession, batch_id: int) -> None:
        part = spark.read.schema(S.CAPTURE).parquet(f"{self.root}/captures/batch_id={batch_id}")
        insights = spark.read.schema(S.INSIGHT).parquet(f"{self.root}/insights/batch_id={batch_id}")
        # read for the keys and for the new rows: captures and insights meet once
        requests = stage(promotion_requests(part, insights), "promotion-requests")
        keyed = keyed_creates(requests)
        resolved = self._resolved(keyed, "solutions", "dedup_key", batch_id)
        write_part(created_solutions(requests, resolved, self.as_of), f"{self.root}/solutions", batch_id)

