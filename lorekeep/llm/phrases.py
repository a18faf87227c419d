"""Phrase collocations: word sequences that are much more frequent than their parts suggest.

1.  Texts are lower-cased and cut into pieces at punctuation and line ends.  Prefix sums of a polynomial over the bytes
    give each word's value, and such sums over these values the Rabin-Karp fingerprint of every ``k`` words at once.
2.  Length by length, each batch of texts counts its fingerprints and the shuffle adds them up, ``COUNTED`` bits of
    them, as these counts only sift.  Fingerprints of ``least`` or more occurrences set a bit in a table of fixed
    size (``BITS``); a sequence is counted only where both sequences of one word less have their bits set.  Bits
    shared by chance, and fingerprints shared by different words, let more through and lose nothing.
3.  Verification: in each batch a fingerprint that passes points to its first occurrence; every other occurrence is
    compared with it word by word, and those that differ get a pointer of their own.  The words at the pointer, not
    the fingerprint, are what the second shuffle adds up, so counts are exact.  Text is written out only here,
    once for each pointer, and a task adds up its batches before the shuffle; when it holds too many, the rarer half goes on.
    There are ``TASKS`` tasks for each core, however large the table, so a frequent phrase is handed on about as often.
4.  Frequent sequences meet their parts, the lowest-scoring cut counts, and phrases that lie in a longer one with
    (nearly) the same count go.  It is enough to look one word longer: what lies between the two is no rarer than the longer.
5.  Each language's best are ranked in two steps, first in slices of it.

Hot words and phrases cost one row a batch before any shuffle.  The tables of bits, 8 MB for each length, are the only
broadcast; they do not grow.

Rows and edge cases: a null text has no words, a null language is ``und``, also beside texts marked so; ids are
not used, repeated rows count again; an empty table or one without frequent phrases gives an empty result;
extra columns are ignored.  A long text is handled alone in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lorekeep.llm.common import as_bytes, read, signed, slices, use_python
from lorekeep.session import stage

LEAST = 100
LONGEST = 5
TOP = 2000
BITS = 1 << 26
"""Bits of one length's table; more fingerprints than this only let more sequences be counted."""
COUNTED = 40
BATCH = 2 << 20
HELD = 400_000
"""Different phrases a task adds up before it hands some of them on."""
TASKS = 2
"""Tasks of the verification for each core."""
SLICES = 256
"""Parts a language is ranked in before its best are ranked together."""

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
# fixed values: the signs that end a piece, and those that part words
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_END = np.isin(np.arange(256), list(_ENDS))
_IS_GAP = np.isin(np.arange(256), list(_ENDS + _BLANKS))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``size`` of each."""
    if len(_powers[0]) < size:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _prefix_sums(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_tables(len(values))[0][: len(values)], out=sums[1:])
    return sums


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial over the bytes."""
    return _prefix_sums(_BYTE[data])


def between(sums: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of what lies between each ``begin`` and ``stop``."""
    return _mixed((sums[stop] - sums[begin]) * _power_tables(len(sums))[1][begin])


class Words:
    """The words of a batch of texts: their language, words left in the piece, and fingerprints of their sequences."""

    def __init__(self, texts: list[bytes], langs: list[str | None]):
        self._data = data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        gap = _IS_GAP[data]
        edge = np.diff(np.concatenate((np.ones(1, np.int8), gap.view(np.int8))))
        self._begin, self._stop = begin, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = len(begin)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        names = pa.array(["und" if x is None else x for x in langs], pa.string()).dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        words = np.diff(np.searchsorted(begin, text_ends), prepend=0)
        self.lang = np.repeat(names.indices.to_numpy(), words)
        ended = np.searchsorted(np.flatnonzero(_IS_END[data]), begin)
        lasts = np.flatnonzero(np.concatenate((ended[1:] != ended[:-1], [True]))) if n else begin
        self.left = np.repeat(lasts, np.diff(lasts, prepend=-1)) - np.arange(n) + 1
        self._sums = _prefix_sums(between(byte_sums(data), begin, stop))
        seeds = np.fromiter((xxhash.xxh64_intdigest(x.encode(), 12) for x in self.langs), np.uint64, len(self.langs))
        self._seed = seeds[self.lang]

    def number_words(self) -> None:
        """Sets ``different``, the batch's different words, and ``number``, the place in it of each word."""
        gap = _IS_GAP[self._data]
        offsets = np.concatenate(([0], np.cumsum(self._stop - self._begin)))
        letters = np.ascontiguousarray(self._data[~gap])
        every = pa.Array.from_buffers(
            pa.large_binary(), len(self._begin), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
        )
        coded = every.dictionary_encode()
        self.different = coded.dictionary.to_pylist()
        self.number = coded.indices.to_numpy()

    def fingerprints(self, k: int) -> np.ndarray:
        """Of the ``k`` words from each position, whether or not the piece holds as many."""
        n = len(self.left) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return _mixed((self._sums[k:] - self._sums[:n]) * _power_tables(n)[1][:n] + self._seed[:n])

    def frequent(self, k: int, shorter) -> np.ndarray:
        """Positions of sequences of ``k`` words inside a piece whose parts of ``k - 1`` words may be frequent.

        ``shorter`` is the broadcast table of bits of these parts, None for single words.
        """
        n = max(0, len(self.left) - k + 1)
        inside = self.left[:n] >= k
        if k > 1:
            part = has_bit(shorter.value, self.fingerprints(k - 1))
            inside &= part[:n] & part[1 : n + 1]
        return np.flatnonzero(inside)


def has_bit(table: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints & np.uint64(len(table) * 8 - 1)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in slices(batches, "text", BATCH):
        yield Words(as_bytes(batch.column("text")), batch.column("lang").to_pylist())


def _count_batches(k: int, shorter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _each(batches):
            at = words.frequent(k, shorter)
            prints = words.fingerprints(k)[at] & np.uint64((1 << COUNTED) - 1)
            prints, counts = np.unique(prints, return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(prints), pa.array(counts, pa.int64())], names=["fp", "n"])

    return run


def pointers(words: Words, at: np.ndarray, prints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first position of each different sequence among those at ``at``, and its count.

    Occurrences of one fingerprint are compared word by word; those unlike their pointer go another round.
    """
    heads, counts = [], []
    while len(at):
        _, first, which = np.unique(prints, return_index=True, return_inverse=True)
        pointer = at[first][which]
        same = words.lang[at] == words.lang[pointer]
        for j in range(k):
            same &= words.number[at + j] == words.number[pointer + j]
        heads.append(at[first])
        counts.append(np.bincount(which[same], minlength=len(first)))
        at, prints = at[~same], prints[~same]
    if not heads:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(heads), np.concatenate(counts)


def _phrase_rows(counts: dict[tuple[str, int, bytes], int]) -> pa.RecordBatch:
    lang, size, phrase = zip(*counts) if counts else ((), (), ())
    columns = [pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], names=["lang", "size", "phrase", "n"])


def _phrase_batches(longest: int, tables, held: int = HELD):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, bytes], int] = {}

        def add(key: tuple[str, int, bytes], n: int) -> None:
            counts[key] = counts.get(key, 0) + n

        for words in _each(batches):
            words.number_words()
            for x, n in enumerate(np.bincount(words.lang, minlength=len(words.langs)).tolist()):
                add((words.langs[x], 0, b""), n)
            for k in range(1, longest + 1):
                at = words.frequent(k, tables[k - 2] if k > 1 else None)
                prints = words.fingerprints(k)[at]
                passed = has_bit(tables[k - 1].value, prints)
                head, count = pointers(words, at[passed], prints[passed], k)
                if not len(head):
                    break
                parts = np.stack([words.number[head + j] for j in range(k)], axis=1).tolist()
                for x, row, n in zip(words.lang[head].tolist(), parts, count.tolist()):
                    add((words.langs[x], k, b" ".join([words.different[p] for p in row])), n)
            if len(counts) > held:
                rare = int(np.median(np.fromiter(counts.values(), np.int64, len(counts))))
                yield _phrase_rows({p: n for p, n in counts.items() if n <= rare})
                counts = {p: n for p, n in counts.items() if n > rare}
        yield _phrase_rows(counts)

    return run


def verified(texts: DataFrame, longest: int, tables) -> DataFrame:
    """``(lang, size, phrase, n)``: the counts of each task, those of one phrase still apart."""
    few = texts.coalesce(TASKS * texts.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(_phrase_batches(longest, tables), "lang string, size int, phrase string, n bigint")


def _bit_table(prints: DataFrame, bits: int) -> np.ndarray:
    """The table of bits of ``fp``; it comes to the driver in blocks, ``bits / 8`` bytes at most."""
    at = (F.col("fp").bitwiseAND(F.lit(bits - 1)) + 1).alias("at")  # positions count from 1
    blocks = prints.select(at).groupBy(F.bitmap_bucket_number("at").alias("block"))
    blocks = blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    table = np.zeros(bits // 8, np.uint8)
    for b in blocks:
        part = np.frombuffer(b["bits"], np.uint8)
        start = (b["block"] - 1) * len(part)
        table[start : start + len(part)] |= part[: max(0, len(table) - start)]
    return table


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """Staged ``(lang, size, phrase, n)``: exact counts of all sequences of 1 to ``longest`` words with ``least`` or more.

    Rows of size 0 and an empty phrase hold the number of words of each language.
    """
    spark = docs.sparkSession
    use_python(spark)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    tables: list = []  # each table is sent once
    for k in range(1, longest + 1):
        counted = texts.mapInArrow(_count_batches(k, tables[-1] if tables else None), "fp bigint, n bigint")
        counted = counted.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        tables.append(spark.sparkContext.broadcast(_bit_table(counted, bits)))
    found = verified(texts, longest, tables).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    found = stage(found.where((F.col("size") == 0) | (F.col("n") >= least)), "phrases")
    for table in tables:
        table.destroy()
    return found


def _exact(column: str) -> "F.Column":
    return F.col(column).cast("decimal(19,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = 100, bits: int = BITS
) -> DataFrame:
    """``(lang, phrase, size, a, l, r, n, score)`` of all collocations of 2 to ``longest`` words.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its lowest-scoring cut, ``n`` the words
    of the language, ``score`` the whole part of ``1000 * a * n / (l * r)``.  A phrase inside a longer one
    that has ``share`` percent of its count, or more, is left out.
    """
    counts = frequent_phrases(docs, least, longest, bits)
    words = counts.where("size = 0").select("lang", F.col("n").alias("words"))
    parts = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    phrases = counts.where("size > 1").withColumn("w", F.split("phrase", " "))

    cuts = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "size", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"),
    )
    heads = parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l"))
    tails = parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(words, "lang")
    # the products have at most 38 digits; the quotient is below 1000 * words / a
    above = (_exact("a") * F.lit(1000).cast("decimal(19,0)")).cast("decimal(19,0)") * _exact("words")
    cuts = cuts.withColumns({"above": above.cast("decimal(38,0)"), "below": (_exact("l") * _exact("r")).cast("decimal(38,0)")})
    lowest = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r", F.col("words").alias("n"), "a")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "size").agg(lowest).select("lang", "phrase", "size", "c.*")

    ends = F.array(
        F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " ")
    )
    inner = phrases.where("size > 2").select("lang", F.explode(ends).alias("phrase"), "n")
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("a")))
    return kept.select("lang", "phrase", "size", "a", "l", "r", "n", "score")


def best_collocations(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score, count and phrase, with their ``rank`` from 1."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best_collocations(collocations(read(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
