"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in order of ``doc_id``, are cut into blocks of ``BLOCK_BYTES`` of text; a document belongs
to the block its first byte falls in.  A source with the share ``w`` of all weights has its block ``i`` released at
``floor(i / w)`` and due at ``ceil((i + 1) / w)``, in whole numbers without rounding ``w``; earliest deadline
first gives each block one slot between the two.  So before any slot, a source has had its weight's share
to within less than one block, however many slots there are.  When a source runs out, the others go on
with their weights scaled up: a new phase, at most one for each source.  No block is left out or repeated.

With a ``period``, weights are first rounded to whole slots of it, one at least, and only one period is worked out;
the deviation is then from the rounded weights.

The driver works the slots out and holds eight bytes for each block, 4 MB for 30 GB of text, and one period instead
where one is given; sources are taken to be few thousands at most.  No table of rows, and no join on the source, is
needed, so a source may hold any share.

Rows and edge cases: a null source is a source of its own, a null text has no bytes, repeated rows follow each
other.  Sources without a given weight, or with none above zero, weigh ``1 / NO_WEIGHT`` of the weights given.  Extra
columns pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lorekeep.llm.common import read, row_key, use_python
from lorekeep.operators.first_wins import with_dense_rank
from lorekeep.session import stage

BLOCK_BYTES = 1 << 16
NO_WEIGHT = 1000
TEMPERATURE = 0.5
ROWS = 1 << 16
"""Rows whose sizes one task sums in order."""
NO_SOURCE = "\u0000"


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of each source in a period: largest remainders, one slot at least."""
    period = max(period, 4 * len(weights))
    total = sum(max(w, 0.0) for w in weights.values()) or 1.0
    exact = {s: max(w, 0.0) / total * period for s, w in weights.items()}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    spare = period - sum(shares.values())
    by_rest = sorted(exact, key=lambda s: (shares[s] - exact[s], s))
    for k in range(max(0, spare)):
        shares[by_rest[k % len(by_rest)]] += 1
    while spare < 0:
        largest = max(shares, key=lambda s: (shares[s], s))
        take = min(-spare, shares[largest] - 1)
        shares[largest] -= take
        spare += take
    return shares


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(max(w, 0.0)) for s, w in weights.items()}
    least = (sum(exact.values()) or Fraction(1)) / NO_WEIGHT
    scale = lcm(*(w.denominator for w in [*exact.values(), least]))
    return {s: int((w or least) * scale) for s, w in exact.items()}


def edf_slots(shares: dict[str, int], most: dict[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source by release time and earliest deadline, until one has had ``most`` slots."""
    total = sum(shares.values())
    slots: dict[str, list[int]] = {s: [] for s in shares}
    waiting = [(0, s) for s in shares]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str]] = []
    now = 0
    while True:
        while waiting and waiting[0][0] <= now:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // shares[s]), -shares[s], s))
        _, _, s = heapq.heappop(ready)
        slots[s].append(now)
        now += 1
        if len(slots[s]) == most[s]:
            return {s: np.array(x, np.int64) for s, x in slots.items()}
        heapq.heappush(waiting, (len(slots[s]) * total // shares[s], s))


def edf_period(shares: dict[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source in one period, by release time and earliest deadline."""
    period = sum(shares.values())
    slots: dict[str, list[int]] = {s: [] for s in shares}
    waiting = [(0, s) for s in shares]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str]] = []
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * period // shares[s]), -shares[s], s))
        _, _, s = heapq.heappop(ready)
        slots[s].append(now)
        if len(slots[s]) < shares[s]:
            heapq.heappush(waiting, (len(slots[s]) * period // shares[s], s))
    return {s: np.array(x, np.int64) for s, x in slots.items()}


@dataclass
class Phase:
    first_block: int
    base_slot: int
    pattern: np.ndarray
    period: int


def schedule(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> dict[str, list[Phase]]:
    """For each source, the phases its blocks are placed by."""
    phases: dict[str, list[Phase]] = {s: [] for s in blocks}
    left = {s: n for s, n in blocks.items() if n}
    base = 0
    while left:
        own = {s: weights.get(s, 0.0) for s in left}
        patterns = edf_period(whole_shares(own, period)) if period else edf_slots(exact_shares(own), left)
        length = sum(map(len, patterns.values()))
        for s in left:
            phases[s].append(Phase(blocks[s] - left[s], base, patterns[s], length))
        if period:
            ends = {s: (n - 1) // len(patterns[s]) * length + int(patterns[s][(n - 1) % len(patterns[s])]) + 1 for s, n in left.items()}
            end = min(ends.values())
            used = {s: end // length * len(p) + int(np.searchsorted(p, end % length)) for s, p in patterns.items()}
        else:
            end, used = length, {s: len(p) for s, p in patterns.items()}
        left = {s: n - used[s] for s, n in left.items() if n > used[s]}
        base += end
    return phases


def slots_of(phases: list[Phase], block: np.ndarray) -> np.ndarray:
    """The slot of each block of one source."""
    if not phases:
        return np.zeros(len(block), np.int64)
    which = np.searchsorted([p.first_block for p in phases], block, "right") - 1
    out = np.empty(len(block), np.int64)
    for k in np.unique(which):
        p, mine = phases[k], which == k
        j = block[mine] - p.first_block
        out[mine] = p.base_slot + j // len(p.pattern) * p.period + p.pattern[j % len(p.pattern)]
    return out


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_bytes: int = BLOCK_BYTES,
    period: int | None = None,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """``(k1, k2, doc_id, source, n_bytes, block, slot, start)``, one row for each row of ``docs``.

    ``start`` is the document's first byte in its source; ``(slot, start, k1, k2)`` is the mixed order.  Without
    ``weights`` a source weighs its bytes to the power ``temperature``.
    """
    spark = docs.sparkSession
    use_python(spark)
    sizes = docs.select(
        *row_key(F.col("doc_id"), F.col("text")),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"),
    ).withColumn("part", F.coalesce("source", F.lit(NO_SOURCE)))
    ranked = with_dense_rank(sizes, "part", "k1", "k2", label="mix-order")
    group = (F.col("rank") / ROWS).cast("bigint")
    sums = ranked.groupBy(group.alias("group")).agg(F.sum("n_bytes").alias("all"))  # one row for each ROWS rows
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = stage(sums.select("group", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base")), "mix-sums")
    inside = Window.partitionBy("group").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("group", group).withColumn("start", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0)))
    placed = stage(placed.join(sums, "group").withColumn("start", F.col("start") + F.col("base")), "mix-starts")

    totals = placed.groupBy("part").agg(F.min("start").alias("first"), F.sum("n_bytes").alias("bytes")).collect()
    blocks = {r["part"]: max(1, -(-r["bytes"] // block_bytes)) for r in totals}
    firsts = {r["part"]: r["first"] for r in totals}
    wanted = weights or {r["part"]: float(max(1, r["bytes"])) ** temperature for r in totals}
    plan = spark.sparkContext.broadcast((schedule(blocks, wanted, period), blocks, firsts))

    @F.pandas_udf("block bigint, slot bigint, start bigint")
    def place(part: pd.Series, start: pd.Series) -> pd.DataFrame:
        phases, counts, begins = plan.value
        out = pd.DataFrame({"block": 0, "slot": 0, "start": start.to_numpy()}, index=part.index)
        for source, at in part.groupby(part).groups.items():
            own = start[at].to_numpy() - begins[source]
            block = np.minimum(own // block_bytes, counts[source] - 1)
            out.loc[at, "start"], out.loc[at, "block"] = own, block
            out.loc[at, "slot"] = slots_of(phases[source], block)
        return out

    found = placed.withColumn("p", place("part", "start"))
    return found.select("k1", "k2", "doc_id", "source", "n_bytes", "p.block", "p.slot", "p.start")


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in mixed order; written, its files follow each other by name in that order."""
    placed = mix(docs, **options).groupBy("k1", "k2").agg(F.min(F.struct("slot", "start")).alias("__at"))
    placed = placed.withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2}).join(placed, ["__k1", "__k2"])
    return keyed.orderBy("__at", "__k1", "__k2").drop("__at", "__k1", "__k2")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mix(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "source", "n_bytes", "block", "slot", "start")
