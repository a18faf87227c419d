"""Connected components of an edge table by alternating large and small stars.

First each task reduces the edges it reads to a forest, which connects the same nodes by fewer edges than it has
nodes: a dense group enters the rounds with one edge for each node and task, not with all it was found by.  Every round is two joins and two aggregations, staged in the shared folder, so neither edges nor labels
reach the driver; only one checksum a round does.  The number of rounds grows with the logarithm of the
component size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorekeep.llm.bitslice import fold
from lorekeep.llm.common import use_python
from lorekeep.session import stage

HELD = 1 << 18
"""Edges a task holds before it reduces them."""


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its group, and that smallest one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    labels = np.arange(len(nodes))
    fold(labels, at[: len(a)], at[len(a) :])
    child = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[child], nodes[labels[child]]


def _forest_batches(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)
        parts, size = [], 0
        for batch in batches:
            parts.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += len(batch)
            if size >= held:
                a, b = forest(*(np.concatenate([old, *(p[k] for p in parts)]) for k, old in ((0, a), (1, b))))
                parts, size = [], 0
                if len(a) >= held:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a = b = np.empty(0, np.int64)
        a, b = forest(*(np.concatenate([old, *(p[k] for p in parts)]) for k, old in ((0, a), (1, b))))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """``(node, root)`` for every node with an edge other than to itself; ``root`` is the smallest node.

    ``edges`` has bigint columns ``a`` and ``b``; direction, repeats and loops do not matter.
    """
    use_python(edges.sparkSession)
    few = edges.where("a <> b").select("a", "b").mapInArrow(_forest_batches(held), "a bigint, b bigint")
    current = stage(few.distinct(), "edges")
    seen = _signature(current)
    while seen[0]:
        current = stage(_small_star(_large_star(current)), "stars")
        now = _signature(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(current.select("b", "b").distinct())
