"""Document fingerprints by one-permutation MinHash.

Words are lower-cased (A-Z) runs of anything but ASCII white space; shingles are five consecutive words,
or all words of a shorter text.  Each shingle is hashed once: the top bits choose one of ``BINS`` bins, which
keeps the least hash.  Empty bins take the value of another bin by optimal densification: bin ``i`` probes
bins in an order that depends on ``i`` alone until one is filled.  The low ``BITS`` bits of each bin, mixed
with the bin's number, are kept as one hex digit.  The share ``m`` of equal digits is corrected for chance: ``(m - c) / (1 - c)``, ``c = 2**-BITS``.

Rows and edge cases: a null text is empty; a text without words has all digits zero; equal texts have equal
fingerprints, and likeness 1.  Documents follow each other by ``doc_id`` (null first), repeated ids by text
hash; a single document follows itself.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorekeep.llm.common import NO_ID, read, slices, use_python
from lorekeep.llm.simhash import normal_words
from lorekeep.llm.substrings import _BYTE, _mixed, _power_tables

BINS = 256
BITS = 4
WORDS = 5
RANGE_BYTES = 32 << 20
"""Text in one range of ids."""
POINT_RANGES = 10_000
"""Up to this many ranges their first ids go into the scan as a filter; more are joined, 16 bytes a range."""
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHINGLE = _mixed(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(text index, 64-bit hash)`` of every shingle of every text."""
    data, starts, stops, words = normal_words(texts)
    buffer = np.frombuffer(data, np.uint8)
    power, inverse = _power_tables(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * power[:-1], out=sums[1:])
    word = _mixed((sums[stops] - sums[starts]) * inverse[starts])
    shingles = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(texts)), shingles)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    begin = (np.cumsum(words) - words)[owner] + nth
    held = words[owner]
    total = np.zeros(len(owner), np.uint64)
    for k in range(WORDS):
        at = np.minimum(begin + k, max(0, len(word) - 1))
        total += np.where(k < held, word[at] * _SHINGLE[k], np.uint64(0)) if len(word) else np.uint64(0)
    return owner, _mixed(total)


def digits(texts: list[bytes]) -> np.ndarray:
    """(texts, BINS) of the low bits of each densified bin."""
    owner, hashes = shingle_hashes(texts)
    bins = np.full(len(texts) * BINS, EMPTY, np.uint64)
    slot = owner * BINS + (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    np.minimum.at(bins, slot, hashes)
    bins = bins.reshape(len(texts), BINS)
    filled = bins != EMPTY
    row, column = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        if attempt <= 4 * BINS:
            probe = _mixed(column.astype(np.uint64) * np.uint64(0x10001) + np.uint64(attempt << 32))
            donor = (probe % np.uint64(BINS)).astype(np.int64)
        else:  # practically never reached; ends the search for certain
            donor = (column + attempt) % BINS
        hit = filled[row, donor]
        bins[row[hit], column[hit]] = bins[row[hit], donor[hit]]
        row, column = row[~hit], column[~hit]
    # a value lent to many bins is mixed with the bin, so two different ones do not agree in all of them by chance
    low = _mixed(bins ^ _mixed(np.arange(BINS, dtype=np.uint64))) & np.uint64((1 << BITS) - 1)
    low[~filled.any(axis=1)] = 0
    return low.astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bias-corrected estimate of the Jaccard likeness of fingerprints, row by row."""
    chance = 2.0**-BITS
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_hex(found: np.ndarray) -> list[str]:
    return [row.tobytes().decode() for row in _HEX[found]]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(as_hex(digits(texts)), pa.string())],
            names=[*names, "fingerprint"],
        )


def fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced by its ``fingerprint`` of ``BINS`` hex digits."""
    use_python(rows.sparkSession)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(_fingerprint_batches, ", ".join([*kept, "fingerprint string"]))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    part = len(text) // 4
    return text[: len(text) - part] + following[:part] if part else text


_COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, range by range; the last row of a range is the first of the next and only lends its text."""
    held = None
    for batch in slices(batches, "text", 2 << 20):
        place = batch.column("place").to_pylist()
        ids = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        lends = batch.column("lends").to_pylist()
        if held:
            place, ids, texts, lends = ([h, *x] for h, x in zip(held, (place, ids, texts, lends)))
        held = place[-1], ids[-1], texts[-1], lends[-1]
        own = [k for k in range(len(ids) - 1) if not lends[k] and place[k] == place[k + 1]]
        if not own:
            continue
        changed = [edited(texts[k], texts[k + 1]).encode() for k in own]
        plain = digits([t.encode() for t in texts])
        other = digits(changed)
        own = np.array(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[k] for k in own], pa.int64()),
                pa.array([len(texts[k]) for k in own], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                pa.array(as_hex(plain[own]), pa.string()),
                pa.array(as_hex(other), pa.string()),
                pa.array(likeness(plain[own], other)),
                pa.array(likeness(plain[own], plain[own + 1])),
            ],
            names=[x.split()[0] for x in _COMPARED.split(", ")],
        )


def compare_with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The ids are cut into ranges of about ``range_bytes`` of text.  Each text is shuffled once, to its range; the
    first document of a range is also sent to the range before, and that of the first range to the last.
    """
    spark = docs.sparkSession
    use_python(spark)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("at"),
        F.col("text").cast("string").alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    cuts = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        cuts = sorted({int(c) for c in rows.approxQuantile("at", shares, 1 / (4 * ranges))})
    place = _place(cuts)
    placed = rows.withColumn("place", place(F.col("at")))
    firsts = rows.select("at").withColumn("place", place(F.col("at"))).groupBy("place").agg(F.min("at").alias("at"))
    firsts = firsts.orderBy("place").collect()  # one row a range
    before = {r["at"]: firsts[k - 1]["place"] for k, r in enumerate(firsts)}
    lent = rows.limit(0).withColumn("place", F.lit(0).cast("bigint"))
    if len(before) > POINT_RANGES:
        pairs = spark.createDataFrame(list(before.items()), "at bigint, lent_to bigint")
        lent = rows.join(F.broadcast(pairs), "at").select(*rows.columns, F.col("lent_to").alias("place"))
    elif before:
        # the first document of a repeated id is the least in the same order as below
        least = rows.where(_in(F.col("at"), F.col("doc_id"), list(before)))
        to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        lent = least.withColumn("place", F.element_at(to, F.col("at")).cast("bigint"))
    both = placed.withColumn("lends", F.lit(False)).unionByName(lent.withColumn("lends", F.lit(True)))
    ordered = both.repartition(ranges, "place").sortWithinPartitions("place", "lends", "at", F.xxhash64("text"))
    return ordered.drop("at").mapInArrow(_compare, _COMPARED)


def _in(at: Column, doc_id: Column, values: list[int]) -> Column:
    """Membership that reaches the scan as a filter on ``doc_id``."""
    known = [v for v in values if v != NO_ID]
    found = doc_id.isin(known) if known else F.lit(False)
    return found | doc_id.isNull() if NO_ID in values else found


def _place(cuts: list[int]):
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("bigint")
    def place(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy(), "right"))

    return place if cuts else lambda at: F.lit(0).cast("bigint")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read(spark, sf_dir, "documents"))
