from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from lorekeep.llm import bitslice, simhash
from lorekeep.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, component_id string"


def fingerprint(text: str | None) -> int:
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows: list[tuple]) -> list[tuple]:
    prints = [fingerprint(text) for _, text in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[top(i)] = top(j)
    ids: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        known = ids.get(top(i))
        ids[top(i)] = doc if known is None else known if doc is None else min(known, doc)
    return [(doc, f"{prints[i]:016x}", ids[top(i)]) for i, (doc, _) in enumerate(rows)]


def order(row):
    return tuple((v is None, v) for v in row)


def result(df):
    found = simhash.near_duplicates(df).selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0')", "component_id")
    return sorted(map(tuple, found.collect()), key=order)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op9_simhash"](spark, SF).collect()), key=order)
    assert got == sorted(expected(rows), key=order)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [
        (3, None), (1, ""), (2, " \t\n"), (None, "\x0b"), (None, "only null"), (7, "A b"), (5, "a\tB"),
        (9, long), (8, long + " end"), (4, "x y z w v"), (4, "x y z w v"), (4, "other words here to see"), (6, "ÄÖ ü ÉÀ"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert result(df) == sorted(expected(rows), key=order)
    assert result(df.limit(0)) == []


def near_values(n: int) -> np.ndarray:
    rng = random.Random(n)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(n)}
    return np.array(sorted(near | {rng.getrandbits(64) for _ in range(n)}), np.uint64)


def brute(values: np.ndarray) -> np.ndarray:
    labels = np.arange(len(values))
    bitslice.fold(labels, *np.nonzero(np.bitwise_count(values[:, None] ^ values) <= 4))
    return labels


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_links_lose_no_connection_even_in_long_keys(spark, blocks):
    values = near_values(150)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    links = simhash.fingerprint_links(df, blocks=blocks, chunk=16).collect()
    position = {int(v): i for i, v in enumerate(values.view(np.int64))}
    labels = np.arange(len(values))
    bitslice.fold(labels, np.array([position[a] for a, _ in links]), np.array([position[b] for _, b in links]))
    assert (labels == brute(values)).all()


def test_bit_slices_equal_popcounts():
    values = near_values(200)
    assert (bitslice.link_buckets(values, np.zeros(len(values), np.int64), 4, range(64)) == brute(values)).all()
