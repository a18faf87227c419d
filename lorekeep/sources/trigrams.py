"""A stored trigram index beside the texts of a table, so that a keyword search reads few of them.

``<path>/postings/part=N`` holds ``(gram, block, ids)``: the rows of part ``N`` whose texts contain three characters in
sequence, one row for each gram and 64 neighbouring ids, a bit an id.  A gram lies in one file, which is sorted by gram and
block, so a lookup reads one page of the other files at most; a gram that all texts share has one row for 64 of them.  The
number of files follows the length of all texts, so that a task's share does not grow with the table.
``<path>/counts/part=N`` holds ``(gram, n)``.

A search takes the rarest grams of its word's literal pieces, joins their blocks by ``and`` of the bits and hands the ids
to the table's scan as a filter; the exact pattern decides.  The index only ever names too many rows, so rows may be
changed by adding their new texts as a part, and rows that are gone need no change.  A word without
three literal characters in sequence, or whose grams still name more than ``POINT_IDS`` rows, is searched by the scan.

Grams are listed in Arrow batches by numpy, as three code points in one number: on 25 MB of texts a regular expression that
lists them in the JVM took 13.0 s in place of 7.0 (four tasks, index written).

A null text has no grams, a null id is never named (the scan would give such rows; stored tables have none).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

import lorekeep
from lorekeep.functions.text import alower, keyword
from lorekeep.session import ship_package

POINT_IDS = 1000
"""Up to this many candidate ids go into the scan as a filter; beyond, all texts are scanned."""
RAREST = 4
"""Grams of a word that are looked up."""
PIECE_CHARS = 1 << 20
"""Characters listed at once; a longer text is cut into pieces that overlap by two."""
HELD_ROWS = 1 << 21
"""Postings that a task combines before they go into the shuffle."""
FILE_CHARS = 1 << 23
"""Characters of text for each file of postings."""
STORED = "gram bigint, block bigint, ids bigint"


def word_grams(word: str) -> list[str]:
    """The grams every match of ``word`` contains: those of its pieces between wildcards."""
    return sorted({run[i : i + 3] for run in re.split("[%_]", word) for i in range(len(run) - 2)})


def _code(gram: str) -> int:
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


Postings = tuple[np.ndarray, np.ndarray, np.ndarray]


def _combined(gram: np.ndarray, block: np.ndarray, ids: np.ndarray) -> Postings:
    """One row for each gram and block, sorted."""
    order = np.lexsort((block, gram))
    gram, block, ids = gram[order], block[order], ids[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(fresh)
    return gram[first], block[first], np.bitwise_or.reduceat(ids, first) if len(first) else ids


def _postings(ids: list[int], texts: list[str]) -> Postings:
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.flatnonzero(row[:-2] == row[2:])
    gram = chars[at] << 42 | chars[at + 1] << 21 | chars[at + 2]
    own = np.array(ids, np.int64)[row[at]]
    return _combined(gram, own >> 6, np.left_shift(np.uint64(1), (own & 63).astype(np.uint64)).view(np.int64))


def _merged(held: list[Postings]) -> Postings:
    return _combined(*(np.concatenate(columns) for columns in zip(*held)))


def _batch(postings: Postings) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in postings], names=["gram", "block", "ids"])


def _list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of a task, combined as far as ``HELD_ROWS`` allow: rows need not come in id order."""
    ids: list[int] = []
    texts: list[str] = []
    held: list[Postings] = []
    size = rows = 0
    for batch in batches:
        for own, raw in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            text = raw.decode("utf-8", "replace")
            for at in range(0, len(text), PIECE_CHARS):
                ids.append(own)
                texts.append(text[at : at + PIECE_CHARS + 2])
                size += len(texts[-1])
                if size >= PIECE_CHARS:
                    held.append(_postings(ids, texts))
                    ids, texts, size = [], [], 0
                    rows += len(held[-1][0])
                    if rows >= HELD_ROWS:
                        held = [_merged(held)]
                        rows = len(held[0][0])
                        if rows >= HELD_ROWS // 2:
                            yield _batch(held.pop())
                            rows = 0
    if texts:
        held.append(_postings(ids, texts))
    if held:
        yield _batch(_merged(held))


@dataclass(frozen=True)
class TrigramIndex:
    """An index of the columns ``texts`` (strings or arrays of strings) under ``path``."""

    path: str
    texts: tuple[str, ...]
    id: str = "id"

    def add(self, rows: DataFrame, part: int = 0) -> None:
        """Stores the grams of ``rows`` as part ``part``; a part written again replaces itself."""
        spark = rows.sparkSession
        ship_package(spark, lorekeep)
        text = alower(F.concat_ws("\n", *self.texts))
        key = rows.where(F.col(self.id).isNotNull()).select(F.col(self.id).cast("bigint").alias("id"), text.alias("text"))
        files = (key.agg(F.sum(F.char_length("text").cast("bigint"))).first()[0] or 0) // FILE_CHARS + 1
        # a task adds the rows of a block up before the one shuffle
        found = key.mapInArrow(_list_grams, STORED).repartition(files, "gram")
        found = found.groupBy("gram", "block").agg(F.bit_or("ids").alias("ids"))
        found.sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{self.path}/postings/part={part}")
        stored = spark.read.schema(STORED).parquet(f"{self.path}/postings/part={part}")
        counts = stored.groupBy("gram").agg(F.sum(F.bit_count("ids")).alias("n"))
        counts.orderBy("gram").write.mode("overwrite").parquet(f"{self.path}/counts/part={part}")

    def ids(self, spark: SparkSession, query: str) -> list[int] | None:
        """At most ``POINT_IDS`` ids that hold all matches of ``query``; None where the texts must be scanned."""
        grams = [_code(g) for g in word_grams(keyword(query))]
        if not grams:
            return None
        counts = spark.read.schema("gram bigint, n bigint").parquet(f"{self.path}/counts").where(F.col("gram").isin(grams))
        sizes = {r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(sizes) < len(grams):
            return []
        chosen = sorted(grams, key=lambda g: (sizes[g], g))[:RAREST]
        postings = spark.read.schema(STORED).parquet(f"{self.path}/postings")
        postings = postings.where(F.col("gram").isin(chosen)).groupBy("gram", "block").agg(F.bit_or("ids").alias("ids"))
        both = postings.groupBy("block").agg(F.count(F.lit(1)).alias("grams"), F.bit_and("ids").alias("ids"))
        both = both.where((F.col("grams") == len(chosen)) & (F.col("ids") != 0))
        set_bits = F.expr("filter(sequence(0, 63), i -> getbit(ids, i) = 1)")
        named = both.select("block", F.explode(set_bits).alias("at")).select((F.col("block") * 64 + F.col("at")).alias("id"))
        few = [r["id"] for r in named.limit(POINT_IDS + 1).collect()]
        return sorted(few) if len(few) <= POINT_IDS else None

    def narrowed(self, stored: DataFrame, query: str) -> DataFrame:
        """``stored`` without rows that cannot match ``query``; the caller's pattern decides on the others."""
        few = self.ids(stored.sparkSession, query)
        return stored if few is None else stored.where(F.col(self.id).isin(few))
