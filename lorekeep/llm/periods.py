"""Periodic runs of words: maximal stretches that repeat with a period, found as maximal pairs.

The words of all texts of a batch become numbers, different ones in each text, so that nothing matches across
texts.  Suffixes are sorted by prefix doubling; suffixes that are alone in their group drop out, and the ranks of
each round give the common prefixes by binary lifting.  The tree of LCP intervals is then walked bottom-up.
Each interval keeps the positions of its suffixes in order, classed by the word to their left.  When a child
joins, each position of the smaller side meets the nearest positions of the other side: two positions from different
children and of different left words, ``q`` apart with a common prefix ``l``, are a maximal pair, and where ``l`` is
at least ``(exponent - 1) * q`` the words from the first position to the end of the second prefix are a run with
period ``q``, no extension needed.

Only nearest positions need to meet: those of an interval closer than half its common prefix follow each other at
the smallest period.  Pairs at a multiple of it span the same words and are dropped for the smallest.  A position
takes part only if its common prefix with a neighbour in suffix order is long enough for the distance to the
nearest equal start, so texts without runs build no tree; this loses nothing.

Rows and edge cases: a null or blank text has no words and no runs; repeated rows and null ids are rows like any
other; an empty table gives an empty result; extra columns pass through, also ``runs`` or ``words``, as the
results have names of their own (``__runs``).  A text is held whole by one task, with about 100 bytes a word and one
4-byte rank a word for each doubling that its longest repeat needs.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorekeep.llm.common import as_bytes, read, slices, use_python

MIN_LENGTH = 6
MIN_EXPONENT = 4
TEXT_BYTES = 2 << 20
"""Texts handled at once; a longer text is handled alone."""

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' words: a number, equal for equal words; first byte; byte behind; and the words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    edge = np.diff(np.concatenate(([1], _SPACE[data].view(np.int8))))
    begin, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    stop = stop[: len(begin)]
    offsets = np.concatenate(([0], np.cumsum(stop - begin))).astype(np.int64)
    letters = np.ascontiguousarray(data[~_SPACE[data]])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    numbers = words.dictionary_encode().indices.to_numpy() if len(begin) else np.empty(0, np.int64)
    return numbers.astype(np.int64), begin, stop, np.diff(np.searchsorted(begin, ends), prepend=0)


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, where a new one begins in it, and each key's first place in the order."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
    return order, head, rank


def suffixes(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, and for each doubling the ranks by the first 1, 2, 4, ... tokens.

    Equal ranks mean equal prefixes; the last list entry ranks every suffix apart.
    """
    n = len(tokens)
    order, head, rank = _dense(tokens)
    levels = [rank.astype(np.int32)]
    width = 1
    slots = np.arange(n)
    while True:
        group = rank[order[slots]]
        alone = np.ones(len(group), bool)
        alone[1:] = group[1:] != group[:-1]
        alone[:-1] &= group[1:] != group[:-1]
        slots = slots[~alone]
        if not len(slots):
            return order, levels
        suffix = order[slots]
        onward = suffix + width
        second = np.where(onward < n, rank[np.minimum(onward, n - 1)] + 1, 0)
        by = np.argsort((rank[suffix] << 32) | second)
        suffix, first, second = suffix[by], rank[suffix][by], second[by]
        head = np.ones(len(suffix), bool)
        head[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        order[slots] = suffix
        rank[suffix] = np.maximum.accumulate(np.where(head, slots, 0))
        levels.append(rank.astype(np.int32))
        width *= 2


def common_prefix(left: np.ndarray, right: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Tokens that the suffixes at ``left`` and ``right`` share, by binary lifting over the doubling ranks."""
    n = len(levels[0])
    a, b = left.copy(), right.copy()
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        shared[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return shared


def _candidates(tokens: np.ndarray, order: np.ndarray, levels: list, length: int, exponent: int):
    """Positions, in suffix order, that may start one side of a pair; and their common prefix with the one before."""
    least = max(1, -(-length * (exponent - 1) // exponent))  # the shortest prefix of a pair that reaches both limits
    shared = np.zeros(len(order) + 1, np.int64)
    # suffixes that differ in their first tokens share less than ``least``
    level = min(len(levels) - 1, least.bit_length() - 1)
    close = np.flatnonzero(levels[level][order[1:]] == levels[level][order[:-1]]) + 1
    shared[close] = common_prefix(order[close - 1], order[close], levels)
    most = np.maximum(shared[:-1], shared[1:])
    held = np.flatnonzero(most >= least)
    if not len(held):
        return held, held
    # groups of equal prefixes of ``least`` tokens; distance to the nearest position of the same group
    group = np.cumsum(shared[held] < least)
    by = np.lexsort((order[held], group))
    gap = np.diff(order[held][by])
    gap[np.diff(group[by]) != 0] = len(tokens)
    gap = np.concatenate(([len(tokens)], gap, [len(tokens)]))
    nearest = np.empty(len(held), np.int64)
    nearest[by] = np.minimum(gap[:-1], gap[1:])
    kept = np.flatnonzero(most[held] >= (exponent - 1) * nearest)
    if not len(kept):
        return kept, kept
    # the common prefix of two kept neighbours is the least one between them
    between = np.minimum.reduceat(shared[: held[kept[-1]] + 1], np.concatenate(([0], held[kept][:-1] + 1)))
    between[between < least] = 0
    between[0] = 0
    return order[held[kept]], between


def _pairs(positions: list[int], shared: list[int], left: list[int], length: int, exponent: int) -> list[tuple[int, int, int]]:
    """``(first position, common prefix + distance, distance)`` of the maximal pairs in the LCP-interval trees.

    ``shared`` is each suffix's common prefix with the one before it, 0 where a new tree begins.
    """
    found = []

    def join(one: list[int], other: list[int], common: int) -> list[int]:
        """Positions of both children of an interval; pairs between them go to ``found``."""
        small, large = (one, other) if len(one) < len(other) else (other, one)
        for at in small:
            k = bisect_left(large, at)
            for near in large[max(k - 1, 0) : k + 1]:
                gap = abs(near - at)
                if common >= (exponent - 1) * gap and common + gap >= length and left[near] != left[at]:
                    found.append((min(near, at), common + gap, gap))
        if len(small) * 8 > len(large):
            return sorted(large + small)
        for at in small:
            insort(large, at)
        return large

    stack: list[tuple[int, list[int]]] = []  # common prefix with the entry below, positions in order
    for at, common in zip([*positions, -1], [*shared, 0]):
        # intervals deeper than the prefix shared with this suffix are complete
        while len(stack) > 1 and stack[-1][0] > common:
            joint, top = stack.pop()
            stack[-1] = (stack[-1][0], join(stack[-1][1], top, joint))
        if not common:
            stack.clear()
        stack.append((common, [at]))
    return found


def find_runs(tokens: np.ndarray, length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> np.ndarray:
    """``(start, length, period)`` rows, sorted, of all runs in ``tokens``."""
    none = np.empty((0, 3), np.int64)
    if len(tokens) < length:
        return none
    order, levels = suffixes(tokens)
    positions, shared = _candidates(tokens, order, levels, length, exponent)
    if not len(positions):
        return none
    left = np.concatenate(([-1], tokens[:-1])).tolist()
    pairs = _pairs(positions.tolist(), shared.tolist(), left, length, exponent)
    runs = np.array(pairs, np.int64).reshape(-1, 3)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)  # the smallest of the periods of one stretch
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _run_batches(length: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            texts = as_bytes(batch.column("text"))
            numbers, begin, stop, counts = word_numbers(texts)
            owner = np.repeat(np.arange(len(texts)), counts)
            tokens = owner * (numbers.max(initial=0) + 1) + numbers
            runs = find_runs(tokens, length, exponent)
            ends = np.cumsum(counts)
            in_text = np.searchsorted(ends, runs[:, 0], "right")
            # words behind the first period of a run go
            steps = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
            np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(steps)[:-1] == 0
            names = [n for n in batch.schema.names if n != "text"]
            fields = [pa.array(x) for x in (runs[:, 0] - (ends - counts)[in_text], runs[:, 1], runs[:, 2])]
            bounds = np.searchsorted(in_text, np.arange(len(texts) + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(
                pa.array(bounds), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(counts, pa.int64()), listed, _joined(texts, begin, stop, counts, kept)],
                names=[*names, "__words", "__runs", "__collapsed"],
            )

    return run


def _joined(texts: list[bytes], begin: np.ndarray, stop: np.ndarray, counts: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    behind = np.zeros(len(data), bool)
    behind[stop] = True
    normal = np.where(space, np.uint8(0x20), data)[~space | behind]
    sizes = (stop - begin + 1) * kept
    last = np.cumsum(counts) - 1
    flags = np.repeat(kept, stop - begin + 1)
    ends = np.cumsum(stop - begin + 1)
    # the last kept word of a text has no space behind it
    nth = np.maximum.accumulate(np.where(kept, np.arange(len(kept)), -1))
    final = nth[last[counts > 0]] if len(kept) else last[:0]
    flags[ends[final] - 1] = False
    total = np.concatenate(([0], np.cumsum(sizes)))
    lengths = np.where(counts > 0, total[last + 1] - total[last + 1 - counts] - 1, 0) if len(kept) else 0 * counts
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    body = np.ascontiguousarray(normal[flags])
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def with_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """The rows of ``docs`` with ``text`` replaced by ``__words``, ``__runs`` and ``__collapsed``.

    The number of words; ``(start, length, period)`` of each run of at least ``min_length`` words and
    ``min_exponent`` periods, by start, then period; and the words, joined by one space, that stay if of each run only
    the first period does.
    """
    use_python(docs.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    run = "struct<start: bigint, length: bigint, period: bigint>"
    schema = ", ".join([*fields, f"__words bigint, __runs array<{run}>, __collapsed string"])
    text = F.col("text").cast("string").alias("text")
    kept = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text"]
    return docs.select(*kept, text).mapInArrow(_run_batches(min_length, min_exponent), schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail of words in each text whose id's crc32 ends in 0; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # lambda variables hold what would otherwise be worked out anew for every word
    at = F.transform(
        F.array(words),
        lambda w: F.struct(w.alias("w"), F.size(w).alias("n")),
    )
    g = F.floor(h / 10)
    placed = F.transform(at, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), F.when(s["n"] > 0, g % s["n"]).alias("a")))
    placed = F.transform(
        placed,
        lambda s: F.struct(
            s["w"].alias("w"), s["n"].alias("n"), s["a"].alias("a"), (F.floor((s["n"] - s["a"]) / (g % 8 + 3)) + 1).alias("p")
        ),
    )

    def rewritten(s: Column) -> Column:
        word = lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))
        return F.when(s["n"] > 0, F.array_join(F.transform(F.sequence(F.lit(0), s["n"] - 1), word), " ")).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, F.transform(placed, rewritten)[0]).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_runs(with_planted_runs(docs))
    # runs come by start, then period, so the first of equal exponents stays
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("__runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.concat_ws("", F.transform("__runs", lambda r: F.concat(line(r), F.lit("\n"))))
    found = found.select("doc_id", "__runs", "__collapsed", best.alias("best"), listed.alias("listed"))
    return found.select(
        "doc_id",
        F.size("__runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("__collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
