"""Exact substring removal: every byte covered by a string of ``window`` bytes that starts elsewhere too.

1.  Every window of a text has a smallest k-gram by hash (its minimiser).  Consecutive windows with one
    minimiser form a segment.  Equal windows have equal minimisers, so a window can only repeat inside its
    minimiser's group; groups met once are left out without reading their text again.
2.  Segments that are equal as a whole are one row with a count: all their windows repeat.  This is what
    keeps a passage or text with any number of copies from piling up in a task.
3.  The distinct segments of the other groups are packed into shards of about ``SHARD_BYTES``.  A shard
    gets a suffix array by Larsson-Sadakane refinement and Kasai's common prefixes; a common prefix of
    ``window`` bytes with a neighbour marks the start as repeated.
4.  A group too large for one shard is dealt to several.  Each then hands on one digest for each distinct
    window, and the shards' sorted digests are merged by binary search.
5.  Marked starts become byte runs of each document and are cut from its text.

The filter in 1 and 2 loses nothing: it only skips windows that occur once or are known to repeat.

Rows and edge cases: a null text is empty; texts shorter than the window keep every byte; a null
``doc_id`` is an id of its own; repeated rows count as two documents, so their texts of ``window`` bytes or
more go whole.  A text may be as long as Spark's strings.  Extra columns pass through unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep.llm.common import as_bytes, read, row_key, signed, slices, use_python
from lorekeep.llm.suffixes import Shard, common_prefixes, suffix_order
from lorekeep.operators.first_wins import attach_per_key
from lorekeep.session import stage

WINDOW = 400
GRAM = 128
SHARD_BYTES = 1 << 20
PIECE = 1 << 20
"""Window starts handled at once inside one long text."""

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:size], _powers[1][:size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at each position, from prefix sums of a polynomial modulo 2**64."""
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=sums[1:])
    return _mixed((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all texts: ``(text index, first start, starts, minimiser hash, digest of the segment's bytes)``."""
    owners, offsets, parts = [], [], []
    for k, text in enumerate(texts):
        for at in range(0, len(text) - window + 1, PIECE):
            owners.append(k)
            offsets.append(at)
            parts.append(text[at : at + PIECE + window - 1])
    if not parts:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    joined = b"".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.cumsum(sizes) - sizes
    hashes = gram_hashes(np.frombuffer(joined, np.uint8), gram)
    bits = max(1, len(hashes).bit_length())
    low = np.uint64((1 << bits) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
    where = (sliding_least(packed, window - gram + 1) & low).astype(np.int64)
    valid = np.zeros(len(where) + 1, bool)
    inside = np.zeros(len(where) + 2, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, first + sizes - window + 1, -1)
    valid[:-1] = np.cumsum(inside)[: len(where)] > 0
    change = np.ones(len(where), bool)
    change[1:] = (where[1:] != where[:-1]) | ~valid[:-2]
    begin = np.flatnonzero(valid[:-1] & change)
    after_last = np.flatnonzero(valid[:-1] & ~valid[1:]) + 1
    stop = np.minimum(np.concatenate((begin[1:], [len(where)])), after_last[np.searchsorted(after_last, begin, "right")])
    part = np.searchsorted(first, begin, "right") - 1
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    digests = np.fromiter(
        (digest(view[a:b]) for a, b in zip(begin.tolist(), (stop + window - 1).tolist())), np.uint64, len(begin)
    )
    start = begin - first[part] + np.array(offsets)[part]
    return np.array(owners)[part], start, stop - begin, hashes[where[begin]], digests


def _segment_batches(window: int, gram: int, encode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 * PIECE):
            texts = as_bytes(batch.column("text"))
            owner, start, starts, minimiser, digest = segments(encode(texts) if encode else texts, window, gram)
            k1 = batch.column("k1").to_numpy()[owner]
            k2 = batch.column("k2").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(k1),
                    pa.array(k2),
                    pa.array(start.astype(np.int32)),
                    pa.array(starts.astype(np.int32)),
                    signed(minimiser),
                    signed(digest),
                ],
                names=["k1", "k2", "start", "starts", "mini", "dig"],
            )

    return run


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each maximal run of true flags."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


_MARKS = (
    "k1 bigint, k2 bigint, a int, b int, mini bigint, range int, "
    "windows array<binary>, k1s array<bigint>, k2s array<bigint>, places array<int>"
)
_KINDS = [
    pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(),
    pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()),
]


def _marks(*columns) -> pa.Table:
    """Missing trailing columns are null."""
    names = [x.split()[0] for x in _MARKS.split(", ")]
    rows = len(columns[0])
    full = [*columns, *[[None] * rows] * (len(names) - len(columns))]
    return pa.table([pa.array(v, k) for v, k in zip(full, _KINDS)], names=names)


def _shard_marks(window: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Repeated starts of the shard as runs; of a dealt group also the sorted digests of its distinct windows."""
        part = key[1].as_py()
        shard = Shard(rows.column("bytes").to_pylist())
        order = suffix_order(shard, window)
        order = order[shard.rest[order] >= window]
        prefix = common_prefixes(shard, order, window)
        joined = prefix >= window  # the same window as the one before
        repeated = joined.copy()
        repeated[:-1] |= joined[1:]
        flags = np.zeros(shard.size, bool)
        flags[order[repeated]] = True
        unknown = rows.column("n").to_numpy() == 1
        flags &= unknown[shard.owner]
        # segments end in window - 1 positions that are no starts, so runs stay inside a segment
        first, last = runs_of(flags)
        owner = shard.owner[first]
        k1, k2 = rows.column("k1").to_numpy(), rows.column("k2").to_numpy()
        start = rows.column("start").to_numpy() - shard.first
        marks = _marks(k1[owner], k2[owner], first + start[owner], last + start[owner])
        if part < 0:
            return marks
        heads = order[~joined]
        single = ~repeated[~joined] & unknown[shard.owner[heads]]
        owner = shard.owner[heads]
        segment, offset = rows.column("bytes").to_pylist(), heads - shard.first[owner]
        digests = [
            xxhash.xxh3_128_digest(segment[o][x : x + window]) for o, x in zip(owner.tolist(), offset.tolist())
        ]
        # one row for each range of digests that the group's shards exchange
        digests = np.array(digests, "S16")
        into = np.array([int.from_bytes(d[:4], "little") for d in digests.tolist()]) % rows.column("parts")[0].as_py()
        at = np.where(single, heads + start[owner], -1)
        runs = []
        for k in np.unique(into).tolist():
            own = np.flatnonzero(into == k)
            own = own[np.argsort(digests[own])]
            windows = [d.ljust(16, b"\0") for d in digests[own].tolist()]
            runs.append((key[0].as_py(), k, windows, k1[owner[own]], k2[owner[own]], at[own]))
        none = [None] * len(runs)
        return pa.concat_tables([marks, _marks(none, none, none, none, *zip(*runs))])

    return run


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    """Starts whose window another shard of the group holds: binary search in the merged sorted digests."""
    flat = {c: rows.column(c).combine_chunks().flatten() for c in ("windows", "k1s", "k2s", "places")}
    digests = np.array(flat["windows"].to_pylist(), "S16")
    merged = np.sort(digests)
    found = np.searchsorted(merged, digests, "right") - np.searchsorted(merged, digests, "left") > 1
    place = flat["places"].to_numpy()
    hit = np.flatnonzero(found & (place >= 0))
    at = pa.array(place[hit])
    return pa.table({"k1": flat["k1s"].take(pa.array(hit)), "k2": flat["k2s"].take(pa.array(hit)), "a": at, "b": at})


def repeated_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(k1, k2, runs)``: for each row key with repeated windows, the runs ``(a, b)`` of their start bytes."""
    texts = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text"))
    return keyed_runs(texts, texts, window, gram, shard_bytes)


def keyed_runs(
    texts: DataFrame, bodies: DataFrame, window: int, gram: int, shard_bytes: int = SHARD_BYTES, encode=None
) -> DataFrame:
    """As ``repeated_runs``, for ``(k1, k2, text)``.

    With ``encode``, which turns a list of texts' bytes into other bytes, runs are those of the encoded texts, and
    ``bodies`` holds these under the same keys; else it is ``texts``.
    """
    spark = texts.sparkSession
    use_python(spark)
    found = stage(
        texts.mapInArrow(
            _segment_batches(window, gram, encode), "k1 bigint, k2 bigint, start int, starts int, mini bigint, dig bigint"
        ),
        "segments",
    )
    several = found.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mini")
    several = stage(several, "repeated-grams")  # a join with shuffles of its own lets Spark split frequent ones
    found = found.join(several, "mini").select("*", F.struct("mini", "dig").alias("segment"), F.monotonically_increasing_id().alias("seq"))
    found = stage(found, "shared-segments")
    place = F.min(F.struct("k1", "k2", "start", "starts")).alias("o")
    distinct = stage(found.groupBy("mini", "dig").agg(F.count(F.lit(1)).alias("n"), place), "distinct-segments")
    # a very common segment is a hot key
    repeats = distinct.where("n > 1").select(F.struct("mini", "dig").alias("segment"), "n", F.lit(True).alias("again"))
    whole = attach_per_key(found, repeats, "segment").where("again")
    whole = whole.select("k1", "k2", F.col("start").alias("a"), (F.col("start") + F.col("starts") - 1).alias("b"))

    groups = distinct.groupBy("mini").agg(
        F.count(F.lit(1)).alias("variants"), F.min("n").alias("least"), F.sum(F.expr("o.starts")).alias("positions")
    )
    groups = groups.where("variants > 1 and least = 1").withColumn(
        "parts", F.ceil((F.col("positions") + F.col("variants") * (window - 1)) / shard_bytes).cast("int")
    )
    wanted = stage(distinct.join(groups.select("mini", "parts"), "mini").select("mini", "dig", "n", "parts", "o.*"), "variants")
    total = wanted.agg(F.sum(F.col("starts") + window - 1)).first()[0] or 0
    bins = -(-total // shard_bytes) or 1

    lists = wanted.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("mini", "dig", "n", "parts", "start", "starts")).alias("wanted")
    )
    body = F.col("text").cast("binary")
    cut = F.transform(
        "wanted", lambda x: F.struct(x.alias("s"), body.substr(x["start"] + 1, x["starts"] + (window - 1)).alias("bytes"))
    )
    parts = bodies.join(lists, ["k1", "k2"]).select("k1", "k2", F.explode(cut).alias("e"))
    # repeated rows give the same segments; one of each goes on
    parts = parts.select("k1", "k2", "e.s.*", "e.bytes").dropDuplicates(["mini", "dig"])
    dealt = F.col("parts") > 1
    parts = parts.withColumns(
        {
            "shard": F.when(dealt, F.col("mini")).otherwise(F.pmod(F.xxhash64("mini"), F.lit(bins))),
            "part": F.when(dealt, F.pmod("dig", "parts")).otherwise(-1).cast("int"),
        }
    )
    marks = stage(parts.groupBy("shard", "part").applyInArrow(_shard_marks(window), _MARKS), "suffix-marks")
    inside = marks.where("windows is null").select("k1", "k2", "a", "b")
    dealt_runs = marks.where("windows is not null").select("mini", "range", "windows", "k1s", "k2s", "places")
    across = dealt_runs.groupBy("mini", "range").applyInArrow(_merge, "k1 bigint, k2 bigint, a int, b int")
    runs = whole.union(inside).union(across).distinct()
    return runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def cut_runs(text: bytes, runs: list, window: int) -> tuple[list[bytes], int, int]:
    """What stays of ``text``, how many bytes go, and in how many maximal runs."""
    if not runs:
        return [text], 0, 0
    spans = np.array([(r["a"], r["b"] + window) for r in runs], np.int64)
    spans = spans[np.argsort(spans[:, 0])]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    begin = spans[head, 0].tolist()
    end = reach[np.concatenate((np.flatnonzero(head)[1:] - 1, [len(spans) - 1]))].tolist()
    kept = [text[a:b] for a, b in zip([0, *end], [*begin, len(text)])]
    return kept, sum(end) - sum(begin), len(begin)


def _cut_batches(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lost, spans, digests, lengths, rest = [], [], [], [], []
            for text, runs in zip(as_bytes(batch.column("text")), batch.column("__runs").to_pylist()):
                kept, gone, count = cut_runs(text, runs, window)
                left = b"".join(kept)
                lengths.append(len(text))
                lost.append(gone)
                spans.append(count)
                digests.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    # a cut may fall inside a character: its remaining bytes go too
                    rest.append("".join(part.decode(errors="ignore") for part in kept))
            names = [n for n in batch.schema.names if n not in ("__runs", "text")]
            columns = [batch.column(n) for n in names]
            if keep_text:
                names, columns = [*names, "text"], [*columns, pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lengths, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)],
                names=[*names, "__bytes", "__removed", "__spans", "__sha"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True, **options) -> DataFrame:
    """The rows of ``docs`` with repeated windows cut from ``text``.

    Adds ``__bytes``, ``__removed``, ``__spans`` and ``__sha``: length of the whole text in bytes, bytes and
    maximal runs removed, SHA-256 of the remaining bytes.  ``text`` is left out unless ``keep_text``.
    """
    runs = repeated_runs(docs, window, **options).select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("runs").alias("__runs")
    )
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2}).join(runs, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    fields += ["text string"] * keep_text
    schema = ", ".join([*fields, "__bytes bigint, __removed bigint, __spans bigint, __sha string"])
    return keyed.mapInArrow(_cut_batches(window, keep_text), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select(
        "doc_id",
        F.col("__bytes").alias("n_bytes"),
        F.col("__removed").alias("n_removed"),
        F.col("__spans").alias("n_spans"),
        F.col("__sha").alias("kept_sha256"),
    )
