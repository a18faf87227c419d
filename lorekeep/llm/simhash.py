"""SimHash near duplicates: exact search within a Hamming radius by bit-sliced comparison.

Each distinct fingerprint is filed under every choice of ``radius`` of its ``blocks`` bit blocks left
out; two fingerprints within the radius agree on at least one such key (pigeonhole), so no link is lost.
``blocks`` follows from the number of fingerprints so that a key is about as rare as one fingerprint; it
changes the cost, never the result.  Inside a key, distances are counted bit-sliced (``bitslice``) and
only a spanning set of links leaves the task, so a dense group never becomes all its pairs.  A key with
more than ``CHUNK`` fingerprints is spread over tasks, one for each two chunks of it.

Rows and edge cases: null and empty texts, and texts of white space only, have fingerprint zero and link
like any other.  Equal texts share a fingerprint, so any number of copies costs one row in the search.
Repeated rows give repeated result rows.  A null ``doc_id`` takes part in links but never names a component;
a component of null ids alone has a null ``component_id``.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep.llm.bitslice import link_across, link_buckets
from lorekeep.llm.common import as_bytes, read, signed, slices, use_python
from lorekeep.llm.components import components
from lorekeep.operators.first_wins import attach_per_key
from lorekeep.session import stage

RADIUS = 4
SHINGLE_WORDS = 4
CHUNK = 1 << 14
"""Fingerprints of one key that one task compares with each other."""

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 0x20
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def normal_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of all texts, each followed by one space; their starts and ends; words per text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    space = _SPACE[data]
    after_word = space.copy()
    after_word[0] = False
    after_word[1:] &= ~space[:-1]
    in_text = np.diff(np.cumsum(after_word)[ends - 1], prepend=0)
    normal = _LOWER[data[~space | after_word]]
    stops = np.flatnonzero(normal == 0x20)
    starts = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    return normal.tobytes(), starts, stops, in_text


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every shingle of ``width`` words, repeats included; its text; and the shingles of each text."""
    data, starts, stops, words = normal_words(texts)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(texts)), shingles)
    first_word = np.cumsum(words) - words
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    begin = first_word[owner] + nth
    last = begin + np.minimum(words, width)[owner] - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(data)
    hashes = np.fromiter(
        (digest(view[a:b], 42) for a, b in zip(starts[begin].tolist(), stops[last].tolist())), "<u8", len(owner)
    )
    return hashes, owner, shingles


def majority_bits(hashes: np.ndarray, owner: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """For each text, the bits set in more than half of its hashes."""
    result = np.zeros(len(shingles), np.uint64)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(shingles), 2048):  # keeps the histograms small
        a, b = np.searchsorted(owner, [at, at + 2048])
        docs = min(2048, len(shingles) - at)
        base = (owner[a:b] - at) * 256
        for k in range(8):
            counts = np.bincount(base + columns[a:b, k], minlength=docs * 256).reshape(docs, 256)
            ones = counts @ _BYTE_BITS
            over = (2 * ones > shingles[at : at + docs, None]).astype(np.uint64)
            result[at : at + docs] |= (over << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return result


def fingerprints(texts: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit SimHash of each text over its shingles of ``width`` words, repeats included."""
    return majority_bits(*shingle_hashes(texts, width))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        prints = fingerprints(as_bytes(batch.column("text")))
        others = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*others, signed(prints)], names=[*names, "fp"])


def with_fingerprint(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced by its fingerprint ``fp`` (a bigint with the same 64 bits)."""
    use_python(rows.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_fingerprint_batches, f"{kept}, fp bigint")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of the bits that stay when ``radius`` of the blocks are left out."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(block[k] for k in kept) for kept in combinations(range(blocks), blocks - radius)]


def choose_blocks(count: int, radius: int) -> int:
    """The fewest blocks whose keys are long enough to be about as many as the fingerprints."""
    blocks = radius + 1
    while blocks < 64 and 64 * (blocks - radius) // blocks < count.bit_length():
        blocks += 1
    return blocks


def _search(radius: int, masks: list[int], chunk: int):
    """Scans keys in sorted order: links inside small keys, rows of long keys handed on in chunks."""
    orders = [[p for p in range(64) if not mask >> p & 1] for mask in masks]

    def links(table: int, key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        labels = link_buckets(value, key, radius, orders[table])
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return _rows(value[moved], value[labels[moved]], -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        long_key, part = None, 0
        for batch in batches:
            table = batch.column("t").to_numpy().astype(np.int64)
            value = batch.column("fp").to_numpy().view(np.uint64)
            key = batch.column("key").to_numpy().view(np.uint64)
            table, key, value = (np.concatenate(x) for x in zip(held, (table, key, value)))
            starts = np.flatnonzero(np.concatenate(([True], (table[1:] != table[:-1]) | (key[1:] != key[:-1]))))
            cut = starts[-1]
            yield from done(table[:cut], key[:cut], value[:cut], long_key, part)
            if cut:
                long_key, part = None, 0
            held = table[cut:], key[cut:], value[cut:]
            while len(held[0]) > chunk:
                long_key = (int(held[0][0]), int(held[1][0]))
                yield _rows(held[2][:chunk], held[1][:chunk], long_key[0], part)
                part += 1
                held = tuple(x[chunk:] for x in held)
        yield from done(*held, long_key, part)

    def done(table, key, value, long_key, part):
        if long_key is not None and len(table):
            own = int(np.searchsorted((table != long_key[0]) | (key != np.uint64(long_key[1])), True))
            yield _rows(value[:own], key[:own], long_key[0], part)
            table, key, value = table[own:], key[own:], value[own:]
        for t in np.unique(table).tolist():
            mine = table == t
            yield links(t, key[mine], value[mine])

    return run


def _rows(a: np.ndarray, b: np.ndarray, table: int, part: int = 0) -> pa.RecordBatch:
    """Links have table -1; rows of a long key carry the fingerprint, the key, the table and the chunk."""
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [signed(a), signed(b), pa.array(np.full(n, table, np.int32)), pa.array(np.full(n, part, np.int32))],
        names=["a", "b", "t", "part"],
    )


def _across(radius: int, masks: list[int]):
    orders = [[p for p in range(64) if not mask >> p & 1] for mask in masks]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        table, _, i, j = (x.as_py() for x in key)
        part = rows.column("part").to_numpy()
        value = rows.column("a").to_numpy().view(np.uint64)
        left, right = value[part == i], value[part == j]
        if i == j:
            labels = link_buckets(left, np.zeros(len(left), np.int64), radius, orders[table])
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            a, b = left[moved], left[labels[moved]]
        else:
            pairs = np.array(link_across(left, right, radius, orders[table]), np.int64).reshape(-1, 2)
            a, b = left[pairs[:, 0]], right[pairs[:, 1]]
        return pa.table({"a": signed(a), "b": signed(b)})

    return run


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` that connect the same fingerprints as all pairs within ``radius`` would.

    ``prints`` holds distinct fingerprints in ``fp``; stage it, as it is counted and then read.
    """
    spark = prints.sparkSession
    use_python(spark)
    masks = block_masks(blocks or choose_blocks(prints.count(), radius), radius)
    as_long = lambda m: m - (1 << 64) if m >> 63 else m
    tables = F.array(
        *[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(as_long(m))).alias("key")) for t, m in enumerate(masks)]
    )
    filed = prints.select("fp", F.explode(tables).alias("e")).select("e.t", "e.key", "fp")
    found = stage(
        filed.repartition("t", "key")
        .sortWithinPartitions("t", "key", "fp")
        .mapInArrow(_search(radius, masks, chunk), "a bigint, b bigint, t int, part int"),
        "simhash-links",
    )
    links = found.where("t < 0").select("a", "b")
    long_keys = found.where("t >= 0")
    parts = long_keys.groupBy("t", "b").agg((F.max("part") + 1).alias("parts"))
    # chunk i meets every chunk j >= i of its key
    paired = long_keys.join(parts, ["t", "b"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    across = paired.groupBy("t", "b", "i", "j").applyInArrow(_across(radius, masks), "a bigint, b bigint")
    return links.union(across)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, k2, fp, root, component_id)``, one row for each row of ``docs``.

    ``k2`` is the row's text hash.  ``root`` names the component by a fingerprint, also where ids repeat or are null.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text").alias("k2"), "text")
    prints = stage(with_fingerprint(narrow).withColumn("seq", F.monotonically_increasing_id()), "fingerprints")
    groups = stage(
        prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "fingerprint-groups"
    )
    roots = components(fingerprint_links(groups.select("fp"), radius))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "rep", "n", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(rooted.join(names, "root").select("fp", "n", "root", "component_id"), "fingerprint-components")
    return attach_per_key(prints, named, "fp").drop("seq")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
