from __future__ import annotations

import random
from itertools import combinations

import pytest

from lorekeep.llm import packing
from lorekeep.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def padding(histogram: dict[int, int], lengths: list[int]) -> int:
    return sum(n * (min(b for b in lengths if b >= x) - x) for x, n in histogram.items())


@pytest.mark.parametrize("seed", range(12))
def test_buckets_are_optimal(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 60): rng.randrange(1, 30) for _ in range(rng.randrange(1, 11))}
    for buckets in (1, 2, 3, 5, 20):
        found = packing.bucket_lengths(histogram, buckets)
        assert len(found) <= buckets and found == sorted(set(found)) and found[-1] == max(histogram)
        k = min(buckets, len(histogram))
        best = min(padding(histogram, [*c, max(histogram)]) for c in combinations(sorted(histogram)[:-1], k - 1))
        assert padding(histogram, found) == best


def check(rows: list, got: list, max_tokens: int, buckets: int, batch_tokens: int) -> None:
    cut = []
    for doc, text in rows:
        size = len((text or "").encode()) + 1
        cut += [(doc, k, k * max_tokens, min(max_tokens, size - k * max_tokens)) for k in range(-(-size // max_tokens))]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r["doc_id"], r["piece"], r["first_token"], r["length"]) for r in got), key=key) == sorted(cut, key=key)
    histogram = {}
    for *_, n in cut:
        histogram[n] = histogram.get(n, 0) + 1
    lengths = packing.bucket_lengths(histogram, buckets)
    filled = {}
    for r in got:
        assert r["bucket"] == min(b for b in lengths if b >= r["length"])
        filled.setdefault(r["bucket"], []).append((r["batch"], r["place"]))
    for bucket, places in filled.items():
        rows = max(1, batch_tokens // bucket)
        assert sorted(places) == [(k // rows, k % rows) for k in range(len(places))]


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op5_packing"](spark, SF).collect()
    check(docs, got, packing.MAX_TOKENS, packing.BUCKETS, packing.BATCH_TOKENS)
    inside = sorted((r["bucket"], r["batch"], r["place"], r["doc_id"]) for r in got)
    assert all(a[3] <= b[3] for a, b in zip(inside, inside[1:]) if a[0] == b[0])


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "ab"), (3, "ab"), (None, "é" * 40), (4, "x" * 5000), (5, "y" * 63), (6, "z" * 64)]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, length int")
    check(docs, packing.pack(df, max_tokens=64, buckets=3, batch_tokens=200).collect(), 64, 3, 200)
    assert packing.pack(df.limit(0)).collect() == []
