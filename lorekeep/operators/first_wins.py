"""First-wins deduplication with dense, insertion-ordered ids.

A batch of requests is read as if applied one by one in ``seq`` order: the first valid request with a
key is stored, later ones are duplicates of it, and a request whose key is already stored is a
duplicate of the stored row.  Nothing here gathers the rows of one key: the first ``seq`` per key is a
``min`` with map-side partial aggregation, payloads meet their winner on the unique ``seq``, and the
only join on a repeated key moves narrow rows and takes the largest keys through a small broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorekeep.session import stage

HOT_KEY_ROWS = 1_000_000
"""A key with this many rows is worth taking out of the shuffle."""
HOT_KEYS_MAX = 10_000
"""At most this many keys, the largest ones, are broadcast; all others meet in the shuffle."""


@dataclass(frozen=True)
class WriteResult:
    """The new table state and one outcome row ``(seq, outcome, id)`` per request."""

    table: DataFrame
    outcomes: DataFrame


def first_per_key(rows: DataFrame, key: str) -> DataFrame:
    """``(key, first_seq, n)``: one row per key."""
    return rows.groupBy(key).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))


def attach_per_key(
    rows: DataFrame, per_key: DataFrame, key: str, *, size: str = "n", hot_rows: int | None = None
) -> DataFrame:
    """Left join of ``rows`` (``key`` may repeat without limit) to ``per_key`` (``key`` unique).

    The largest keys travel as a broadcast of at most ``HOT_KEYS_MAX`` rows.  Their rows then shuffle
    under a key of their own (``seq``), so they spread evenly and match nothing; every other row meets
    its key in the shuffle.  ``rows`` needs a unique ``seq``; ``per_key`` is read twice, so a costly one
    should be staged.
    """
    hot_rows = HOT_KEY_ROWS if hot_rows is None else hot_rows
    values = [c for c in per_key.columns if c not in (key, size)]
    hot = (
        per_key.where(F.col(size) >= hot_rows)
        .orderBy(F.col(size).desc(), key)
        .limit(HOT_KEYS_MAX)
        .select(F.col(key), F.struct(*values).alias("_hot"))
    )
    cold = per_key.select(_tagged("key", F.col(key)).alias("_key"), F.struct(*values).alias("_cold"))
    own = _tagged("seq", F.col("seq"))
    spread = F.when(F.col("_hot").isNull(), _tagged("key", F.col(key)))
    joined = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_spread", F.coalesce(spread, own))
        .join(cold, F.col("_spread") == F.col("_key"), "left")
    )
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*[F.col(c) for c in rows.columns], *[found[v].alias(v) for v in values])


def _tagged(tag: str, value: Column) -> Column:
    return F.concat(F.lit(tag + " "), value.cast("string"))


def with_dense_rank(df: DataFrame, *order: str | Column, label: str = "ranked") -> DataFrame:
    """Adds ``rank`` = 0, 1, 2, ... in the given order.

    A range-partitioned sort numbers the rows inside each partition; the result is staged so that no
    recomputation can move a row, and the partition offsets (one row per shuffle partition), staged too,
    are broadcast.  No task sees more than its own range.
    """
    staged = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    counts = staged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    offsets = stage(offsets, f"{label}-offsets")
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("rank", F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_offset", "_at")
    )


def next_id(stored: DataFrame | None, id_col: str = "id") -> int:
    """One more than the largest stored id; one number comes to the driver."""
    top = stored.agg(F.max(id_col)).first()[0] if stored is not None else None
    return (top or 0) + 1


def resolve_keys(keyed: DataFrame, stored: DataFrame | None, key: str, top: int | None = None) -> DataFrame:
    """Per key of the valid requests: ``(key, first_seq, n, is_new, id)``.

    ``stored`` holds the stored keys and ids; if not all of them, but those of the batch at least, ``top`` is the
    highest stored id.  ``id`` is the stored id, or the next dense id in ``first_seq`` order.  The stored keys are first
    reduced to those of the batch: the size of ``keyed`` is known, so a small batch is broadcast and the
    stored table is not shuffled for it.
    """
    firsts = first_per_key(keyed.where(F.col("reject").isNull()), key)
    if stored is None:
        firsts = firsts.withColumn("stored_id", F.lit(None).cast("bigint"))
    else:
        held = stored.select(key, F.col("id").alias("stored_id"))
        firsts = firsts.join(held.join(firsts.select(key), key, "left_semi"), key, "left")
    first = next_id(stored) if top is None else top + 1
    ranked = with_dense_rank(firsts, F.col("stored_id").isNotNull(), "first_seq", label="keys")
    return ranked.select(
        key,
        "first_seq",
        "n",
        F.col("stored_id").isNull().alias("is_new"),
        F.coalesce(F.col("stored_id"), F.col("rank") + first).alias("id"),
    )


def new_rows(payload: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """The payload rows that win a new key, with ``id`` and the key; joined on the unique ``seq``."""
    winners = resolved.where("is_new").select(F.col("first_seq").alias("seq"), "id", key)
    return payload.join(winners, "seq")


def outcomes(keyed: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """``(seq, outcome, id)``; outcome is ``created``, ``duplicate`` or the reject reason."""
    per_key = resolved.select(key, "n", "first_seq", "is_new", "id")
    accepted = F.when(F.col("is_new") & (F.col("seq") == F.col("first_seq")), "created").otherwise("duplicate")
    valid_key = F.when(F.col("reject").isNull(), F.col(key))
    return attach_per_key(keyed.withColumn(key, valid_key), per_key, key).select(
        "seq",
        F.coalesce(F.col("reject"), accepted).alias("outcome"),
        "id",
    )


def outcome_counts(keyed: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row ``(created, duplicate, rejected)`` from per-key counts, without touching the payload."""
    per_key = resolved.select(
        F.col("is_new").cast("bigint").alias("created"),
        (F.col("n") - F.col("is_new").cast("bigint")).alias("duplicate"),
        F.lit(0).cast("bigint").alias("rejected"),
    )
    rejected = keyed.where(F.col("reject").isNotNull()).select(
        F.lit(0).cast("bigint").alias("created"),
        F.lit(0).cast("bigint").alias("duplicate"),
        F.lit(1).cast("bigint").alias("rejected"),
    )
    return per_key.unionByName(rejected).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("created", "duplicate", "rejected")]
    )
