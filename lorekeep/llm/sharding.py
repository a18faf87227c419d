"""Sharding by a k-d tree over metadata.

1.  Each row becomes a point: its metadata dimensions, its size and a digest of its text; texts are read once.
2.  One distributed sort per dimension ranks the points by coordinate, then text digest, then ``doc_id``.  So every
    split has a definite place even where all coordinates are equal, and copies of a text with equal metadata
    are adjacent: a split cuts through at most one such group, however large.
3.  Level by level, each cell that still holds several shards' bytes is split along the dimension that is widest
    in it, relative to the whole table, at the weighted median of that dimension's ranks (or the fraction that
    gives both sides their number of leaves).  The median is found exactly by histograms of ``BINS`` bins, each
    pass inside the bin found by the one before; a histogram is aggregated map-side and one row for each cell
    comes to the driver.
4.  A last sort by shard numbers the rows of all shards at once.

A split is off by half a row at most, so a shard is off its share by at most its largest row.  Every group
of rows is spread by rank ranges; nothing depends on how many rows share a value.

Rows and edge cases: a null text has size 1 and the crc32 of the empty text; a null, missing or not finite
coordinate comes first; null ids and repeated rows are rows like any other.  Rows equal in every respect may swap
places.  An empty table gives an empty result, fewer rows than shards leave some shards empty.  Extra columns are
ignored, unless named as dimensions.  A long text is only measured and hashed.
"""

from __future__ import annotations

import os.path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from lorekeep.llm.common import read, row_key
from lorekeep.operators.first_wins import with_dense_rank
from lorekeep.session import stage

SHARDS = 16
DIMENSIONS = ("lang", "source")
BINS = 1 << 12
_NARROW = ("k1", "k2", "doc_id", "size", "crc")


def _place(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Each dimension as a double: numbers as they are, texts by the characters after the prefix all of them share."""
    texts = [n for n in names if isinstance(df.schema[n].dataType, StringType)]
    columns = {n: F.coalesce(F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for n in names if n not in texts}
    if texts:
        ends = df.agg(*[f(f"`{n}`").alias(f"{k}{i}") for i, n in enumerate(texts) for k, f in (("a", F.min), ("b", F.max))]).first()
        for i, n in enumerate(texts):
            shared = len(os.path.commonprefix([(ends[f"{k}{i}"] or "").encode() for k in "ab"]))
            digits = F.hex(F.col(f"`{n}`").cast("binary").substr(shared + 1, 6))
            columns[n] = F.coalesce(F.conv(F.rpad(digits, 12, "0"), 16, 10).cast("double"), F.lit(0.0))
    return columns


def points(docs: DataFrame, dimensions: tuple[str, ...]) -> tuple[DataFrame, int]:
    """Staged ``(k1, k2, doc_id, size, crc, x0.., r0..)`` and the number of dimensions; the last one is the size."""
    names = [n for n in dimensions if n in docs.columns]
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    narrow = docs.select(
        k1.alias("k1"),
        k2.alias("k2"),
        F.col("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body).alias("digest"),
        *[F.col(f"`{n}`").alias(f"m{i}") for i, n in enumerate(names)],
    )
    narrow = stage(narrow, "kd-metadata")
    placed = _place(narrow, [f"m{i}" for i in range(len(names))])
    coordinates = [*placed.values(), F.log2(F.col("size").cast("double"))]
    table = narrow.select(*_NARROW, "digest", *[c.alias(f"x{i}") for i, c in enumerate(coordinates)])
    for i in range(len(coordinates)):
        table = with_dense_rank(table, f"x{i}", "digest", "doc_id", "k2", label="kd-rank").withColumnRenamed("rank", f"r{i}")
    return stage(table.drop("digest"), "kd-points"), len(coordinates)


def _bounds(cells: DataFrame, dims: int) -> dict[int, tuple]:
    """For each cell its bytes and its extent along every dimension; one row a cell."""
    extents = [(F.max(f"x{i}") - F.min(f"x{i}")).alias(f"w{i}") for i in range(dims)]
    rows = cells.groupBy("cell").agg(F.sum("size").alias("bytes"), *extents).collect()
    return {r["cell"]: (r["bytes"], [r[f"w{i}"] for i in range(dims)]) for r in rows}


def _medians(cells: DataFrame, dims: int, wanted: dict[int, tuple[int, int]], rows: int) -> dict[int, int]:
    """For each cell of ``wanted`` (cell -> dimension, bytes of the left side) the first rank of its right side."""
    spark = cells.sparkSession
    step = 1
    while step * BINS < rows:
        step *= BINS
    state = {cell: (0, 0) for cell in wanted}  # first rank of the bin, bytes before it
    while True:
        given = [(cell, dim, want, *state[cell]) for cell, (dim, want) in wanted.items()]
        given = F.broadcast(spark.createDataFrame(given, "cell int, dim int, want bigint, low bigint, base bigint"))
        rank = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"r{i}")) for i in range(dims)])
        inside = cells.join(given, "cell").withColumn("bin", F.floor((rank - F.col("low")) / step))
        inside = inside.where(f"bin >= 0 AND bin < {BINS}")
        bins = inside.groupBy("cell", "want", "base", "bin").agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("cell").orderBy("bin"))
        crossed = bins.select("cell", "want", "bin", "bytes", (F.col("base") + upto).alias("upto"))
        # the first bin that reaches the wanted bytes; it exists, as the cell holds at least as many
        found = crossed.where("upto >= want").groupBy("cell").agg(F.min_by(F.struct("bin", "bytes", "upto"), "bin").alias("f"))
        found = {r["cell"]: r["f"] for r in found.collect()}
        for cell, f in found.items():
            state[cell] = (state[cell][0] + f["bin"] * step, f["upto"] - f["bytes"])
        if step == 1:
            nearer = {c: 2 * (wanted[c][1] - f["upto"] + f["bytes"]) > f["bytes"] for c, f in found.items()}
            return {c: state[c][0] + nearer[c] for c in found}
        step //= BINS


def kd_shards(
    docs: DataFrame,
    shards: int | None = SHARDS,
    target_bytes: int | None = None,
    dimensions: tuple[str, ...] = DIMENSIONS,
) -> DataFrame:
    """``(k1, k2, doc_id, size, crc, shard, slot)``, one row for each row of ``docs``.

    With ``shards=None`` as many shards as ``target_bytes`` asks for.  ``k1, k2`` is the row's key.
    """
    table, dims = points(docs, dimensions)
    rows, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    leaves = shards if shards is not None else max(1, -(-total // target_bytes))
    cells = table.withColumn("cell", F.lit(0))
    held = {0: leaves}  # first shard of each cell -> its number of shards
    whole = None
    while rows and any(n > 1 for n in held.values()):
        bounds = _bounds(cells, dims)
        whole = whole or bounds[0][1]
        wanted = {}
        for cell, n in held.items():
            if n > 1 and cell in bounds:
                size, extent = bounds[cell]
                relative = [e / w if w else 0.0 for e, w in zip(extent, whole)]
                wanted[cell] = (relative.index(max(relative)), -(-size * (n // 2) // n))
        cut = _medians(cells, dims, wanted, rows)
        splits = [(cell, wanted[cell][0], cut[cell], held[cell] // 2) for cell in wanted]
        splits = F.broadcast(docs.sparkSession.createDataFrame(splits, "cell int, dim int, cut bigint, left int"))
        rank = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"r{i}")) for i in range(dims)])
        moved = F.when(rank >= F.col("cut"), F.col("cell") + F.col("left")).otherwise(F.col("cell"))
        cells = stage(cells.join(splits, "cell", "left").withColumn("cell", moved.cast("int")).drop("dim", "cut", "left"), "kd-cells")
        held = {c: m for cell, n in held.items() for c, m in (((cell, n // 2), (cell + n // 2, n - n // 2)) if n > 1 else ((cell, n),))}
    ranked = with_dense_rank(cells.select(*_NARROW, "cell", "r0"), "cell", "r0", label="kd-slots")
    first = ranked.groupBy("cell").agg(F.min("rank").alias("first"))  # at most one row a shard
    ranked = ranked.join(F.broadcast(first), "cell")
    return ranked.select(*_NARROW, F.col("cell").alias("shard"), (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes ``(doc_id, text, slot)`` in one folder per shard, files in slot order; returns the assignment.

    Repeated rows are equal in id and text, so one of them stands for all in the join.
    """
    assigned = stage(kd_shards(docs, **options), "kd-assigned")
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), "text").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    placed = assigned.join(texts, ["k1", "k2"]).select("doc_id", "text", "shard", "slot")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return assigned


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
