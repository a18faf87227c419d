from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from lorekeep.llm import minhash
from lorekeep.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text: str) -> set:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(rows: list[tuple], got: list, slack: float) -> None:
    """Lengths and hashes equal; likeness close to the exact one, and closer still on average."""
    errors = []
    assert len(got) == len(rows)
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        part = len(text) // 4
        new = text[: len(text) - part] + after[:part]
        hits = [r for r in got if r["doc_id"] == doc and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()]
        assert hits and hits[0]["n_chars"] == len(text)
        assert len(hits[0]["fingerprint"]) == minhash.BINS
        for name, other in (("near_edited", new), ("near_next", after)):
            assert 0 <= hits[0][name] <= 1
            errors.append(hits[0][name] - jaccard(text, other))
            if text == other:
                assert hits[0][name] == 1
    assert np.abs(errors).max() < slack and np.abs(errors).mean() < 0.05


def test_query_against_exact_likeness(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()]
    check(rows, QUERIES["op7_minhash"](spark, SF).collect(), 0.3)


@pytest.mark.parametrize("range_bytes, points", [(1 << 20, 10_000), (2000, 10_000), (2000, 1)])
def test_edge_rows_across_ranges(spark, monkeypatch, range_bytes, points):
    monkeypatch.setattr(minhash, "POINT_RANGES", points)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["alpha", "Über", "x", "omega", "𝛼β"]) + str(rng.randrange(50)) for _ in range(n))
    rows = [(None, text(30)), (-5, None), (0, ""), (1, "  \n"), (2, "ab"), (3, "abc d"), (4, text(4))]
    rows += [(10 + k, text(60)) for k in range(40)] + [(60, "same words as before here"), (61, "same words as before here")]
    rows += [(62, text(20000))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, place string")
    got = minhash.compare_with_next(df.repartition(3), range_bytes).collect()
    check(rows, got, 0.9)
    same = [r["fingerprint"] for r in got if r["doc_id"] in (60, 61)]
    assert same[0] == same[1]
    assert minhash.compare_with_next(df.limit(0), range_bytes).collect() == []


def test_single_and_repeated_documents(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")] * 3, "doc_id bigint, text string")
    got = minhash.compare_with_next(df).collect()
    assert len(got) == 3 and {r["near_next"] for r in got} == {1.0}
    one = minhash.compare_with_next(df.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    plain = minhash.fingerprints(df.withColumn("k", df.doc_id)).collect()
    assert {r["fingerprint"] for r in plain} == {one[0]["fingerprint"]}
