"""Keyed event rules on streams, with their state in Spark's own state store.

The state is one small row per key under the query's checkpoint; Spark versions it with the offsets, so a batch
that is run again starts from the state it started from before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

import lorekeep
from lorekeep import schemas as S
from lorekeep.operators.events import incomplete_events
from lorekeep.operators.recent_ring import BLOCK_BITS, decide_blocks, follow, open_cases, ring_blocks
from lorekeep.session import ship_package, stage
from lorekeep.sources.tables import has_parts, read_parts, write_part
from lorekeep.streaming.runner import keyed_state, run_available


def _fields(*pairs) -> StructType:
    return StructType([StructField(name, kind) for name, kind in pairs])


PRESS = _fields(("user_id", LongType()), ("at_us", LongType()), ("event_id", LongType()))
OUTCOME = _fields(*[(f.name, f.dataType) for f in PRESS], ("outcome", StringType()))
DECISION = _fields(("key", StringType()), ("seq", LongType()), ("hash", StringType()), ("accepted", BooleanType()))
CASES = _fields(
    ("key", StringType()), ("_block", LongType()), ("_cases", StringType()), ("batch_id", LongType())
)
NO_ID = -(1 << 63)
"""Stands for a null ``event_id`` inside the operator."""


def follow_presses(
    at: np.ndarray, last: int | None, waiting: bool, gap: int
) -> tuple[np.ndarray, np.ndarray, int | None, bool]:
    """``(late, fired, last, waiting)`` of one user's sorted press times.

    ``last`` is the time of the user's last press before, ``waiting`` tells that it has no partner yet.
    """
    late = np.zeros(len(at), bool) if last is None else at < last
    fresh = at[~late]
    fired = np.zeros(len(at), bool)
    if not len(fresh):
        return late, fired, last, waiting
    times = np.concatenate(([last], fresh)) if waiting else fresh
    place = np.arange(len(times))
    starts = np.diff(times, prepend=times[0]) > gap
    place -= np.maximum.accumulate(np.where(starts, place, 0))
    fired[~late] = place[len(times) - len(fresh) :] % 2 == 1
    return late, fired, int(times[-1]), bool(place[-1] % 2 == 0)


class _Presses(StatefulProcessor):
    """State of a user: time of the last press, and whether it waits for a partner."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.state = handle.getValueState("press", "last_us bigint, waiting boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        user = int(key[0])
        parts = [(p["at_us"].to_numpy(np.int64), p["event_id"].to_numpy(np.int64)) for p in rows]
        at, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        last, waiting = self.state.get() if self.state.exists() else (None, False)
        late, fired, last, waiting = follow_presses(at, last, waiting, self.gap)
        self.state.update((last, waiting))
        for outcome, chosen in (("late", late), ("fired", fired)):
            if chosen.any():
                yield pd.DataFrame({"user_id": user, "at_us": at[chosen], "event_id": ids[chosen], "outcome": outcome})

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class DoubleTriggerStream:
    """Double triggers of streamed ``(user_id, at_us, event_id)`` rows, under ``root`` with their checkpoint.

    A press older than the user's last one of an earlier batch is ``late``, one without user or time ``incomplete``;
    both are kept as refused with their reason.  A press that waits for its partner does so across batches.  The state,
    two values a user, stays, as any press may turn out late.

    A user's presses of one micro-batch are sorted in one task, at 16 bytes each: limit the batches at the source
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).  Without a limit the batch operator splits a user further.
    """

    root: str
    gap: int = S.DOUBLE_TRIGGER_GAP_MICROS

    def start(self, presses: DataFrame) -> StreamingQuery:
        """Runs all presses that have arrived; start it again for what arrives later."""
        ship_package(presses.sparkSession, lorekeep)
        narrow = presses.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PRESS])
        complete = narrow.where("user_id is not null and at_us is not null").fillna(NO_ID, ["event_id"])
        judged = complete.groupBy("user_id").transformWithStateInPandas(
            _Presses(self.gap), OUTCOME, "Append", "None"
        )
        judged = judged.withColumn("event_id", F.nullif("event_id", F.lit(NO_ID)))
        outcomes = judged.unionByName(incomplete_events(narrow).withColumn("outcome", F.lit("incomplete")))
        writer = (
            outcomes.writeStream.format("parquet")
            .option("path", f"{self.root}/outcomes")
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .partitionBy("outcome")
            .trigger(availableNow=True)
        )
        with keyed_state(presses.sparkSession):
            return writer.start()

    def _outcomes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(OUTCOME).parquet(f"{self.root}/outcomes")

    def firings(self, spark: SparkSession) -> DataFrame:
        return self._outcomes(spark).where("outcome = 'fired'").drop("outcome")

    def refused(self, spark: SparkSession) -> DataFrame:
        return self._outcomes(spark).where("outcome <> 'fired'").withColumnRenamed("outcome", "reason")


class _Ring(StatefulProcessor):
    """State of a key: its ring.  The rows are the case trees of the key's blocks."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("ring", "ring string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trees = pd.concat(list(rows)).sort_values(["batch_id", "block"])
        ring = json.loads(self.state.get()[0]) if self.state.exists() else []
        starts = []
        for cases in trees["cases"]:
            starts.append(ring)
            ring = follow(json.loads(cases), ring)
        self.state.update((json.dumps(ring),))
        yield trees[["key", "batch_id", "block"]].assign(start=starts)

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class RecentRingStream:
    """The recent-ring throttle over streamed ``(key, seq, hash)`` rows, under ``root`` with its checkpoints.

    The first query cuts each batch into blocks by key and ``seq`` and keeps the rows and one case tree for each key
    of a block.  The second one, with the rings as its keyed state, follows these trees: a key's task sees one row
    for each block of at most ``2 ** block_bits`` rows, and the rows are decided block by block, so a hot key spreads.
    """

    root: str
    block_bits: int = BLOCK_BITS

    def run(self, rows: DataFrame) -> None:
        """Decides all rows that have arrived; run it again for what arrives later."""
        spark = rows.sparkSession
        run_available(rows, self._cut, f"{self.root}/cut").awaitTermination()
        if not has_parts(spark, f"{self.root}/cases"):
            return
        trees = spark.readStream.schema(CASES).parquet(f"{self.root}/cases")
        # a null key is a key of its own
        of = F.coalesce(F.concat(F.lit("="), "key"), F.lit(""))
        # Spark hands columns with a leading underscore on under other names
        named = trees.select(of.alias("of"), "key", "batch_id", F.col("_block").alias("block"), F.col("_cases").alias("cases"))
        starts = named.groupBy("of").transformWithStateInPandas(
            _Ring(), "key string, batch_id bigint, block bigint, start array<string>", "Append", "None"
        )
        with keyed_state(spark):
            query = run_available(starts, self._decide, f"{self.root}/rings")
        query.awaitTermination()

    def _cut(self, batch: DataFrame, batch_id: int) -> None:
        path = f"{self.root}/blocks"
        write_part(ring_blocks(batch, self.block_bits), path, batch_id, sort=False)
        blocked = batch.sparkSession.read.parquet(f"{path}/batch_id={batch_id}")
        write_part(open_cases(blocked), f"{self.root}/cases", batch_id, sort=False)

    def _decide(self, starts: DataFrame, batch_id: int) -> None:
        states = stage(starts.withColumnsRenamed({"block": "_block", "start": "_start"}), "ring-starts")
        batches = [r["batch_id"] for r in states.select("batch_id").distinct().collect()]
        blocked = states.sparkSession.read.parquet(f"{self.root}/blocks")
        blocked = blocked.where(F.col("batch_id").isin(batches)).withColumn("batch_id", F.col("batch_id").cast("bigint"))
        decided = decide_blocks(blocked, states, ["batch_id", "_block"])
        write_part(S.conform(decided, DECISION), f"{self.root}/decisions", batch_id)

    def decisions(self, spark: SparkSession) -> DataFrame:
        return read_parts(spark, f"{self.root}/decisions", DECISION)
