"""Key-press rules over event tables ``(user_id, at_us, event_id[, key, action])``.

Both rules look back without a limit, yet no task holds all events of a user, however fast they come: the
rows, sorted by user and time over all tasks, are cut into blocks of at most ``2 ** block_bits`` rows.  Each
block is worked on by itself, and one summary row per user and block carries what the user's next block needs
to know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorekeep import schemas as S
from lorekeep.session import stage

BLOCK_BITS = 17


def _timed() -> Column:
    return F.col("user_id").isNotNull() & F.col("at_us").isNotNull()


def incomplete_events(events: DataFrame) -> DataFrame:
    """The rows no rule can place, as they have no user or no time; the rules leave them out."""
    return events.where(~_timed())


def _blocked(events: DataFrame, block_bits: int, *columns: str) -> DataFrame:
    """The complete rows with ``_block``; staged, as a second run of the sort could cut elsewhere."""
    rows = events.where(_timed()).select("user_id", "at_us", "event_id", *columns)
    numbered = rows.orderBy("user_id", "at_us", "event_id").withColumn("_row", F.monotonically_increasing_id())
    return stage(numbered.withColumn("_block", F.shiftright("_row", block_bits)).drop("_row"), "event-blocks")


def _in_block():
    return Window.partitionBy("user_id", "_block").orderBy("at_us", "event_id")


def _so_far(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def placed_presses(events: DataFrame, gap: int, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Each press with its ``place`` (1, 2, ...) in its run: presses at most ``gap`` apart."""
    return _placed(_blocked(events, block_bits), gap)


def _placed(blocked: DataFrame, gap: int) -> DataFrame:
    w = _in_block()
    rows = blocked.withColumn("_rn", F.row_number().over(w)).withColumn("_prev", F.lag("at_us").over(w))
    starts = F.col("_prev").isNull() | (F.col("at_us") - F.col("_prev") > gap)
    rows = rows.withColumn("_run_start", F.max(F.when(starts, F.col("_rn"))).over(_so_far(w)))

    per_block = (
        rows.withColumn("first_at", F.first("at_us").over(_so_far(w)))
        .withColumn("_next", F.lead("_rn").over(w))
        .where(F.col("_next").isNull())
        .select(
            "user_id",
            "_block",
            "first_at",
            F.col("at_us").alias("last_at"),
            (F.col("_rn") - F.col("_run_start") + 1).alias("tail"),
            (F.col("_run_start") == 1).alias("one_run"),
        )
    )
    by_user = Window.partitionBy("user_id").orderBy("_block")
    linked = F.coalesce(F.col("first_at") - F.lag("last_at").over(by_user) <= gap, F.lit(False))
    per_block = per_block.select(
        "user_id",
        "_block",
        F.when(linked, F.lag("tail").over(by_user)).otherwise(F.lit(0)).alias("_add"),
        F.when(linked & F.lag("one_run").over(by_user), 0).otherwise(1).alias("_restart"),
    ).withColumn("_chain", F.sum("_restart").over(_so_far(by_user)))
    by_chain = Window.partitionBy("user_id", "_chain").orderBy("_block")
    carried = per_block.select("user_id", "_block", F.sum("_add").over(_so_far(by_chain)).alias("_carry"))

    carry = F.when(F.col("_run_start") == 1, F.col("_carry")).otherwise(0)
    place = F.col("_rn") - F.col("_run_start") + 1 + carry
    return rows.join(carried, ["user_id", "_block"]).select("user_id", "at_us", "event_id", place.alias("place"))


def fired(placed: DataFrame) -> DataFrame:
    """A firing uses two presses up, so in a run every second press fires."""
    return placed.where(F.col("place") % 2 == 0).drop("place")


def double_trigger(
    events: DataFrame, gap: int = S.DOUBLE_TRIGGER_GAP_MICROS, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """The presses that complete a pair: at most ``gap`` after an unpaired press of the same user."""
    return fired(placed_presses(events, gap, block_bits))


def chord_held(events: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The ``c`` key-downs made while the control key is down (its last event was a key-down)."""
    return _held(_blocked(events, block_bits, "key", "action")).drop("_block")


def _held(blocked: DataFrame) -> DataFrame:
    w = _in_block()
    control = F.when(F.col("key") == "ctrl", F.col("action"))
    rows = blocked.withColumn("_state", F.last(control, ignorenulls=True).over(_so_far(w)))

    last_of_block = rows.withColumn("_next", F.lead(F.lit(1)).over(w)).where(F.col("_next").isNull())
    earlier = Window.partitionBy("user_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_block.select(
        "user_id", "_block", F.last("_state", ignorenulls=True).over(earlier).alias("_carry")
    )
    held = F.coalesce(F.col("_state"), F.col("_carry")) == "down"
    press = (F.col("key") == "c") & (F.col("action") == "down")
    return rows.join(carried, ["user_id", "_block"]).where(press & held).select("user_id", "at_us", "event_id", "_block")


def double_chord(
    events: DataFrame, gap: int = S.DOUBLE_TRIGGER_GAP_MICROS, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Double triggers of the held presses, which keep the blocks of the events they come from."""
    held = stage(_held(_blocked(events, block_bits, "key", "action")), "held")
    return fired(_placed(held, gap))


def at_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session time zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = (days * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
