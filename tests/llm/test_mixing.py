from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest

from lorekeep.llm import mixing
from lorekeep.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
def test_pfair_deviates_by_less_than_one_block(seed):
    rng = random.Random(seed)
    blocks = {f"s{k}": rng.randrange(1, 400) for k in range(rng.randrange(1, 9))}
    weights = {s: rng.random() ** 3 + 1e-4 for s in blocks}
    phases = mixing.schedule(blocks, weights, 50)
    slots = {s: mixing.slots_of(phases[s], np.arange(n)) for s, n in blocks.items()}
    assert sorted(x for v in slots.values() for x in v.tolist()) == list(range(sum(blocks.values())))
    starts = sorted({p.base_slot for v in phases.values() for p in v})
    for s, found in slots.items():
        assert (np.diff(found) > 0).all()
        for p in phases[s]:
            end = next((x for x in starts if x > p.base_slot), sum(blocks.values()))
            inside = found[(found >= p.base_slot) & (found < end)] - p.base_slot
            for t in range(end - p.base_slot + 1):
                assert abs(Fraction(int((inside < t).sum())) - Fraction(len(p.pattern) * t, p.period)) < 1


def test_query_keeps_rows_and_blocks(spark):
    got = QUERIES["op6_mixing"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    by_source = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        by_source.setdefault(d["source"], []).append((d["doc_id"], len(d["text"].encode())))
    want, counts = {}, {}
    for source, rows in by_source.items():
        at = 0
        total = sum(n for _, n in rows)
        counts[source] = -(-total // mixing.BLOCK_BYTES)
        for doc, n in rows:
            want[doc] = (source, n, at // mixing.BLOCK_BYTES, at)
            at += n
    assert {r["doc_id"]: (r["source"], r["n_bytes"], r["block"], r["start"]) for r in got} == want
    sizes = {s: sum(n for _, n in rows) for s, rows in by_source.items()}
    phases = mixing.schedule(counts, {s: n**0.5 for s, n in sizes.items()})
    assert all(r["slot"] == mixing.slots_of(phases[r["source"]], np.array([r["block"]]))[0] for r in got)


def test_edge_rows_and_order(spark):
    rows = [(k, "x" * (10 + k % 5), "hot") for k in range(200)] + [(1000 + k, "y" * 10, "cold") for k in range(40)]
    rows += [(None, "z" * 30, None), (None, None, None), (5000, "", "cold"), (5000, "", "cold"), (6000, "w" * 200000, "long")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, source string, slot int, part string")
    options = {"weights": {"hot": 0.5, "cold": 0.5}, "block_bytes": 100, "period": 20}
    placed = mixing.mix(df, **options).collect()
    assert len(placed) == len(rows)
    ordered = mixing.in_mixed_order(df, **options)
    assert ordered.columns == df.columns
    got = [(r["doc_id"], r["source"]) for r in ordered.collect()]
    assert sorted(got, key=str) == sorted(((r[0], r[2]) for r in rows), key=str)
    early = [s for _, s in got[:60]]
    assert 20 <= early.count("cold") <= 40
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.in_mixed_order(df.limit(0)).collect() == []


def test_many_slots_stay_within_one_block_of_the_given_weights():
    sizes = [3e9, 1.7e9, 4e8, 5e7, 3e4, 7e3, 11.0]
    weights = {f"s{k}": n / 3.3e9 for k, n in enumerate(sizes)}  # the last ones far below 1/1000
    total = sum(Fraction(w) for w in weights.values())
    blocks = dict.fromkeys(weights, 60_000)
    phases = mixing.schedule(blocks, weights)
    slots = {s: mixing.slots_of(phases[s], np.arange(n)) for s, n in blocks.items()}
    assert sorted(np.concatenate(list(slots.values())).tolist()) == list(range(sum(blocks.values())))
    end = min(p.base_slot for v in phases.values() for p in v if p.base_slot)
    assert end > 90_000
    for s, found in slots.items():
        share = Fraction(weights[s]) / total
        inside = found[found < end].tolist()
        for k, slot in enumerate(inside):  # before and after each of its slots
            assert abs(k - share * slot) < 1 and abs(k + 1 - share * (slot + 1)) < 1
        assert abs(len(inside) - share * end) < 1
    assert len(mixing.schedule({"a": 5, "b": 5}, {"a": 1.0})["b"]) == 2  # no weight: still placed
