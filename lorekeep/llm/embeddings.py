"""Embedding near duplicates: exact pairs at a cosine threshold by cover-tree dual traversal.

Only vectors of one label and length are compared.  Equal vectors are one node with a count.  The nodes
of a label are dealt to blocks of about ``BLOCK``; one task meets two blocks (or one with itself), builds a
cover tree of each and traverses both together.  On unit vectors a cosine of at least ``c`` is a distance of at
most ``sqrt(2 - 2 c)``; what the traversal leaves is decided by the cosine in double precision.  A task returns
link counts and a spanning set of links, never its pairs.

Rows and edge cases: a null label, a null or empty vector, one of zeros, and one with a null, infinite or NaN
component link with nothing.  Repeated rows count as vectors of their own and link with each other.  A null
``vec_id`` takes part in links but names a component only if all its ids are null.  Extra columns are ignored.

The distance work grows with the square of a label's different vectors where they are spread too evenly for
bounds to prune, as any exact search does in many dimensions; a block meets every other block of its label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep.llm.bitslice import fold
from lorekeep.llm.common import read, use_python
from lorekeep.llm.components import components
from lorekeep.llm.covertree import CoverTree, near_pairs
from lorekeep.operators.first_wins import attach_per_key
from lorekeep.session import stage

COSINE = 0.93
BLOCK = 4096
CLOSE_CALL = 1e-12


def unit(vectors: list[list[float]]) -> np.ndarray:
    raw = np.array(vectors, np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _at_least(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Whether row pairs reach the cosine; sums too close to it are taken exactly."""
    dots = np.einsum("ij,ij->i", a, b)
    result = dots >= cosine
    for k in np.flatnonzero(np.abs(dots - cosine) < CLOSE_CALL):
        dot = math.fsum((a[k] * b[k]).tolist())
        size = math.sqrt(math.fsum((a[k] ** 2).tolist()) * math.fsum((b[k] ** 2).tolist()))
        result[k] = dot / size >= cosine
    return result


def _links(cosine: float):
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        points = unit(rows.column("vector").to_pylist())
        node, copies, block = (rows.column(c).to_numpy() for c in ("node", "n", "block"))
        sides = [np.flatnonzero(block == k) for k in (i, j)]
        trees = [CoverTree(points[side]) for side in sides[: 1 if i == j else 2]]
        degree = np.zeros(len(node), np.int64)
        labels = np.arange(len(node))
        for a, b in near_pairs(trees[0], trees[-1], reach):
            if i == j:
                a, b = a[a < b], b[a < b]
            a, b = sides[0][a], sides[1][b]
            linked = _at_least(points[a], points[b], cosine)
            a, b = a[linked], b[linked]
            np.add.at(degree, a, copies[b])
            np.add.at(degree, b, copies[a])
            fold(labels, a, b)
        met = np.flatnonzero((degree > 0) | (labels != np.arange(len(node))))
        return pa.table({"node": node[met], "links": degree[met], "to": node[labels[met]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    use_python(spark)
    value = F.col("embedding").cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    text = F.concat_ws(",", F.col("label").cast("string"), F.size(value).cast("string"), value.cast("array<string>"))
    key = F.when(F.coalesce(sound & F.col("label").isNotNull(), F.lit(False)), F.sha2(text, 256))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("seq"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        value.alias("vector"),
        key.alias("key"),
    )
    rows = stage(rows, "vectors")
    nodes = rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    nodes = stage(nodes.withColumns({"node": F.monotonically_increasing_id(), "size": F.size("vector")}), "vector-nodes")
    blocks = nodes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = nodes.join(blocks, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = stage(
        dealt.select("label", "size", "i", "j", "block", "node", "n", "vector")
        .groupBy("label", "size", "i", "j")
        .applyInArrow(_links(cosine), "node bigint, links bigint, to bigint"),
        "vector-links",
    )
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    placed = nodes.select("key", "node", "rep", "n").join(roots, "node", "left").join(degree, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(
        placed.join(names, "root").select(
            "key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
        ),
        "vector-components",
    )
    # rows without a key take none of the join and stay alone
    joined = attach_per_key(rows.select("seq", "vec_id", "key"), named, "key")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
