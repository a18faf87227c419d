"""Throttle by a small ring of recently accepted hashes, exact and in a fixed number of jobs.

Rule: a row is rejected when its hash is among the last three accepted hashes of its key.  A rejected
row changes nothing; an accepted one is pushed at the front and the ring is cut to three.

The rule is sequential per key, so the rows, sorted by key and ``seq`` over all tasks, are cut into blocks
of at most ``2 ** block_bits`` rows, however large a key is.  Only the first key of a block can go on from
the block before.  What the block does to that key's ring is a small tree of cases: each of the three unknown hashes is
either met by a row or pushed out, which leaves at most 37 ends.  One pass yields the trees, one
pass over one row per key and block follows them, and one pass decides the rows.

A null key is a key of its own, and a null hash a hash of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

import lorekeep
from lorekeep import schemas as S
from lorekeep.session import ship_package, stage

BLOCK_BITS = 17
_CASES = "key string, _block bigint, _given array<string>, _cases string"
_STATES = "key string, _block bigint, _start array<string>, _end array<string>"


def push(ring: list[str], item: str, size: int = S.RECENT_RING_SIZE) -> tuple[bool, list[str]]:
    """(accepted, ring after it)."""
    return (False, ring) if item in ring else (True, [item, *ring][:size])


def run_ring(ring: Iterable[str], items: Iterable[str]) -> tuple[list[bool], list[str]]:
    state, flags = list(ring), []
    for item in items:
        accepted, state = push(state, item)
        flags.append(accepted)
    return flags, state


def case_tree(items: list[str], size: int = S.RECENT_RING_SIZE) -> dict | list:
    """The ring after ``items`` for any ring before them.

    A node ``{item, met, else}`` asks which hash of the first ring, by its place, equals ``item``.  A leaf is the ring
    at the end, in which a number stands for the hash at that place of the first ring.
    """
    items = [x for k, x in enumerate(items) if k == 0 or x != items[k - 1]]  # a repeat of the row before is rejected
    known: list[tuple[int, tuple, list]] = []

    def grow(at: int, ring: tuple) -> dict | list:
        places = [x for x in ring if isinstance(x, int)]
        while places and at < len(items) and items[at] in ring:
            at += 1
        if not places or at == len(items):
            leaf = list(ring)
            known.append((at, ring, leaf))
            return leaf
        item = items[at]
        met = {str(p): grow(at + 1, tuple(item if x == p else x for x in ring)) for p in places}
        return {"item": item, "met": met, "else": grow(at + 1, (item, *ring)[:size])}

    tree = grow(0, tuple(range(size)))
    # all known rings go on together; equal ones become one
    known.sort(key=lambda k: -k[0])
    rings: dict[tuple, list[list]] = {}
    for at in range(len(items) + 1):
        while known and known[-1][0] == at:
            _, ring, leaf = known.pop()
            rings.setdefault(ring, []).append(leaf)
        if at < len(items) and any(items[at] not in ring for ring in rings):
            moved: dict[tuple, list[list]] = {}
            for ring, leaves in rings.items():
                moved.setdefault(tuple(push(list(ring), items[at])[1]), []).extend(leaves)
            rings = moved
    for ring, leaves in rings.items():
        for leaf in leaves:
            leaf[:] = ring
    return tree


def follow(tree: dict | list, ring: list[str]) -> list[str]:
    """The ring at the end of a block that starts from ``ring``."""
    while isinstance(tree, dict):
        at = ring.index(tree["item"]) if tree["item"] in ring else -1
        tree = tree["met"].get(str(at), tree["else"])
    return [ring[x] if isinstance(x, int) else x for x in tree if not isinstance(x, int) or x < len(ring)]


def _by_key(block: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    """The rows of each key of a block in order, keys in the order of the sort."""
    block = block.sort_values("_row")
    key = block["key"].fillna("") + block["key"].isna().map({True: "0", False: "1"})
    for _, rows in block.groupby((key != key.shift()).cumsum(), sort=True):
        yield rows["key"].iloc[0], rows


def _rings(rows: pd.DataFrame, column: str) -> dict[str, list[str]]:
    return {k: list(r) for k, r in zip(rows["key"], rows[column], strict=True) if r is not None}


def _cases(block: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    rings = _rings(given, "ring")
    found = []
    for n, (key, rows) in enumerate(_by_key(block)):
        ring = rings.get(key, [])
        tree = run_ring(ring, rows["hash"])[1] if n else case_tree(rows["hash"].tolist())
        found.append((key, block["_block"].iloc[0], ring, json.dumps(tree)))
    return pd.DataFrame(found, columns=["key", "_block", "_given", "_cases"])


def _open_cases(block: pd.DataFrame) -> pd.DataFrame:
    at = block["_block"].iloc[0]
    found = [(key, at, json.dumps(case_tree(rows["hash"].tolist()))) for key, rows in _by_key(block)]
    return pd.DataFrame(found, columns=["key", "_block", "_cases"])


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follows the blocks of each key; the rows come sorted by key and block."""
    last, ring = object(), []
    for batch in batches:
        starts, ends = [], []
        for key, given, cases in zip(batch["key"], batch["_given"], batch["_cases"], strict=True):
            if key != last:
                last, ring = key, list(given)
            starts.append(ring)
            ring = follow(json.loads(cases), ring)
            ends.append(ring)
        yield batch[["key", "_block"]].assign(_start=starts, _end=ends)


def _flags(block: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    rings = _rings(states, "_start")
    parts = [rows.assign(accepted=run_ring(rings[key], rows["hash"])[0]) for key, rows in _by_key(block)]
    columns = ["key", "seq", "hash", "accepted"]
    return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)


@dataclass(frozen=True)
class RingResult:
    """``rows(key, seq, hash, accepted)`` and the ring ``rings(key, ring)`` each key ends with."""

    rows: DataFrame
    rings: DataFrame


def ring_blocks(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows by key and ``seq`` with ``_row`` and ``_block``; to be written once, as another run may cut elsewhere."""
    narrow = rows.select(F.col("key").cast("string").alias("key"), "seq", "hash").orderBy("key", "seq")
    numbered = narrow.withColumn("_row", F.monotonically_increasing_id())
    return numbered.withColumn("_block", F.shiftright("_row", block_bits))


def open_cases(blocked: DataFrame) -> DataFrame:
    """``(key, _block, _cases)``: the case tree of each key of each block, whatever ring the key comes with."""
    ship_package(blocked.sparkSession, lorekeep)
    return blocked.groupBy("_block").applyInPandas(_open_cases, "key string, _block bigint, _cases string")


def decide_blocks(blocked: DataFrame, states: DataFrame, by: list[str]) -> DataFrame:
    """The rows with ``accepted``, from the ring ``_start`` of each key of each block; ``by`` tells blocks apart."""
    seq_type = blocked.schema["seq"].dataType.simpleString()
    both = blocked.groupBy(*by).cogroup(states.groupBy(*by))
    return both.applyInPandas(_flags, f"key string, seq {seq_type}, hash string, accepted boolean")


def recent_ring(rows: DataFrame, block_bits: int = BLOCK_BITS, given: DataFrame | None = None) -> RingResult:
    """Decides every row of ``rows(key, seq, hash)``; ``seq`` is unique and ``given(key, ring)`` are the
    rings to start from (empty by default)."""
    spark = rows.sparkSession
    ship_package(spark, lorekeep)
    blocked = stage(ring_blocks(rows, block_bits), "ring-rows")
    if given is None:
        given = spark.createDataFrame([], "key string, ring array<string>")
    mine = blocked.select("key", "_block").distinct().alias("b").join(
        given.alias("g"), F.col("b.key").eqNullSafe(F.col("g.key"))
    ).select(F.col("b.key").alias("key"), F.col("b._block").alias("_block"), "g.ring")

    cases = blocked.groupBy("_block").cogroup(mine.groupBy("_block")).applyInPandas(_cases, _CASES)
    states = stage(
        cases.repartition("key").sortWithinPartitions("key", "_block").mapInPandas(_compose, _STATES), "ring"
    )
    return RingResult(decide_blocks(blocked, states, ["_block"]), states.groupBy("key").agg(F.max_by("_end", "_block").alias("ring")))
