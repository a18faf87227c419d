from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lorekeep.llm import substrings
from lorekeep.llm.queries import QUERIES
from lorekeep.llm.suffixes import Shard, common_prefixes, suffix_order

SF = "/root/testdata/sf0.001"


def expected(texts: list[str | None], window: int) -> list[tuple]:
    bodies = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for body in bodies:
        for i in range(len(body) - window + 1):
            seen[body[i : i + window]] = seen.get(body[i : i + window], 0) + 1
    rows = []
    for body in bodies:
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - window + 1):
            if seen[body[i : i + window]] > 1:
                gone[i : i + window] = True
        first, _ = substrings.runs_of(gone)
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        rows.append((len(body), int(gone.sum()), len(first), hashlib.sha256(kept).hexdigest()))
    return rows


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r[0], *e) for r, e in zip(rows, expected([r[1] for r in rows], 400)))
    assert sorted(map(tuple, QUERIES["op2_suffix_dedup"](spark, SF).collect())) == want
    assert any(row[2] for row in want)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_edge_rows_and_dealt_groups(spark, shard_bytes):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", "short", "a" * 300, "ab" * 90, passage, passage, passage + "x", "y" + passage]
    for _ in range(30):
        cut = rng.randrange(len(passage))
        texts.append(word() * 3 + passage[:cut] + word() + passage[cut:] + " ".join(word() for _ in range(20)))
    texts.append(" ".join(word() for _ in range(20000)) + passage + "z" + passage)
    ids = [None if k % 7 == 0 else k // 2 for k in range(len(texts))]
    df = spark.createDataFrame(
        [(i, t, 1, "k") for i, t in zip(ids, texts)], "doc_id bigint, text string, k1 int, runs string"
    )
    out = substrings.remove_repeats(df, 40, gram=12, shard_bytes=shard_bytes)
    got = [(r["doc_id"], r["__bytes"], r["__removed"], r["__spans"], r["__sha"]) for r in out.collect()]
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=order) == sorted([(i, *e) for i, e in zip(ids, expected(texts, 40))], key=order)
    assert out.columns[:4] == ["doc_id", "k1", "runs", "text"]
    assert substrings.remove_repeats(df.limit(0), 40, gram=12).count() == 0


def test_repeated_rows_go_whole(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    df = spark.createDataFrame([(1, text), (1, text), (2, text[:399])], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["text"]) for r in substrings.remove_repeats(df).collect())
    assert got == [(1, ""), (1, ""), (2, text[:399])]


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 200))) for _ in range(40)] + [b"a" * 300]
    shard = Shard(parts)
    suffixes = [p[i:] for p in parts for i in range(len(p))]
    order = suffix_order(shard, 64)
    assert [suffixes[i][:64] for i in order] == sorted(s[:64] for s in suffixes)
    chosen = order[shard.rest[order] >= 20]
    got = common_prefixes(shard, chosen, 50)
    for k in range(1, len(chosen)):
        a, b = suffixes[chosen[k - 1]][:50], suffixes[chosen[k]][:50]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[k] == same
