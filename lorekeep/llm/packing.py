"""Packing into optimal length buckets.

A document's tokens are its UTF-8 bytes and one end token (a byte vocabulary); longer documents are cut into
pieces of ``MAX_TOKENS``.  The histogram of piece lengths, one number for each length up to ``MAX_TOKENS``,
goes to the driver, where dynamic programming chooses the ``BUCKETS`` bucket lengths with the least padding.
Inside a bucket, pieces fill batches of as many rows as the token budget holds, in the given order.

The order within a bucket is a distributed sort with an offset for each task, so a bucket may hold any share of
the pieces.

Rows and edge cases: null and empty texts are one piece of one token.  Repeated rows are packed each.  Extra
columns are ignored.  An empty table gives an empty result.  With fewer lengths than buckets there is no padding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorekeep.llm.common import read, row_key
from lorekeep.operators.first_wins import with_dense_rank

MAX_TOKENS = 8192
BUCKETS = 12
BATCH_TOKENS = 1 << 16


def bucket_lengths(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` lengths that pad the pieces least; the last one is the longest piece's.

    ``best[j]`` is the least padding of the ``j`` shortest lengths.  Ending the last bucket at length ``j`` after
    ``i`` costs ``best[i] + x (C[j] - C[i]) - (S[j] - S[i])`` with ``x`` the length, ``C`` and ``S`` the counts and
    tokens so far: a lower envelope of lines in ``x``, walked once for each bucket.
    """
    lengths = sorted(histogram)
    n = len(lengths)
    if not n:
        return []
    count, tokens = [0], [0]
    for x in lengths:
        count.append(count[-1] + histogram[x])
        tokens.append(tokens[-1] + x * histogram[x])
    best: list[int | None] = [0] + [None] * n
    choices = []
    for _ in range(min(buckets, n)):
        lines: list[tuple[int, int, int]] = []  # slope, intercept, i; slopes fall
        head = 0
        new: list[int | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-count[i], best[i] + tokens[i], i)
                while len(lines) - head >= 2 and _useless(lines[-2], lines[-1], line):
                    lines.pop()
                lines.append(line)
            if not lines:
                continue
            x = lengths[j - 1]
            while len(lines) - head >= 2 and lines[head + 1][0] * x + lines[head + 1][1] <= lines[head][0] * x + lines[head][1]:
                head += 1
            slope, rest, i = lines[head]
            new[j], back[j] = slope * x + rest + x * count[j] - tokens[j], i
        choices.append((new[n], back))
        best = new
    used = min(range(len(choices)), key=lambda k: (choices[k][0] is None, choices[k][0], k))
    chosen, j = [], n
    for k in range(used, -1, -1):
        chosen.append(lengths[j - 1])
        j = choices[k][1][j]
    return chosen[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether the middle one of three lines with falling slopes is nowhere below the others."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pieces(docs: DataFrame, max_tokens: int, order: list[Column]) -> DataFrame:
    """``(doc_id, piece, first_token, length, __order)``: every document's pieces."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint") + 1
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("__order"),
        size.alias("size"),
    )
    last = F.floor((F.col("size") - 1) / max_tokens)
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("piece") * max_tokens
    return rows.select(
        "doc_id", "piece", first.alias("first_token"), F.least(F.col("size") - first, F.lit(max_tokens)).alias("length"), "__order"
    )


def pack(
    docs: DataFrame,
    order: list[Column] | None = None,
    max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """``(doc_id, piece, first_token, length, bucket, batch, place)``, one row for each piece.

    ``bucket`` is the padded length, ``batch`` counts from 0 in each bucket, ``place`` in each batch.
    """
    order = order or row_key(F.col("doc_id"), F.col("text"))
    found = pieces(docs, max_tokens, order)
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    lengths = bucket_lengths(histogram, buckets) or [1]
    fits = F.array(*[F.lit(x).cast("bigint") for x in lengths])
    bucketed = found.withColumn("bucket", F.get(F.filter(fits, lambda b: b >= F.col("length")), F.lit(0)))
    ranked = with_dense_rank(bucketed, "bucket", "__order", "doc_id", "piece", label="packing")
    # a bucket's first rank is the number of pieces in shorter buckets
    before, first = {}, 0
    for low, high in zip([0, *lengths], lengths):
        before[high] = first
        first += sum(n for x, n in histogram.items() if low < x <= high)
    starts = F.create_map(*[F.lit(v).cast("bigint") for pair in before.items() for v in pair])
    nth = F.col("rank") - F.element_at(starts, F.col("bucket"))
    rows = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bucket"))).cast("bigint")
    return ranked.select(
        "doc_id", "piece", "first_token", "length", "bucket",
        F.floor(nth / rows).cast("bigint").alias("batch"), F.pmod(nth, rows).alias("place"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
