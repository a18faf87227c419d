from __future__ import annotations

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import sharding

SF = "/root/testdata/sf0.001"


def check(rows, given, shards, spread=None):
    """One row per document, right sizes, gapless slots, bytes near equal."""
    size = lambda text: len((text or "").encode()) + 1
    assert sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t in given) == sorted(
        (str(r["doc_id"]), r["size"], r["crc"]) for r in rows
    )
    slots, total = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(0 <= s < shards for s in slots)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    share = sum(total.values()) / shards
    largest = max((r["size"] for r in rows), default=0)
    assert all(abs(total[s] - share) <= (largest if spread is None else spread) for s in range(shards))


@pytest.mark.parametrize("shards", [5, 16])
def test_given_documents(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(sharding.kd_shards(docs, shards).collect(), given, shards)


def test_hot_text_and_one_source(spark):
    rows = [(k if k % 7 else None, "the same text" if k % 3 == 0 else f"text {k} " * (k % 11), "en", "s") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = sharding.kd_shards(docs).collect()
    check(got, [r[:2] for r in rows], 16)
    # equal texts with equal metadata are cut apart by splits only
    assert len({r["shard"] for r in got if r["crc"] == zlib.crc32(b"the same text")}) < 16


def test_medians_by_small_bins(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BINS", 7)
    rows = [(k, "x" * (k * k % 101), f"l{k % 3}", f"s{k % 5}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    check(sharding.kd_shards(docs, 6).collect(), [r[:2] for r in rows], 6, spread=101)


def test_splits_follow_the_widest_dimension(spark):
    """Two languages of equal size: the first split separates them."""
    rows = [(k, "word " * 20, "de" if k % 2 else "en", "s") for k in range(64)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = sharding.kd_shards(docs, 2).collect()
    assert {(r["doc_id"] % 2, r["shard"]) for r in got} == {(0, 1), (1, 0)}


def test_target_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = sharding.kd_shards(docs, 1).agg(F.sum("size")).first()[0]
    got = sharding.kd_shards(docs, None, target_bytes=total // 4 + 1).collect()
    assert {r["shard"] for r in got} == {0, 1, 2, 3}


def test_edge_rows(spark):
    long = "z" * 2_000_000
    rows = [(1, None, None, None, 3.0), (1, None, None, None, 3.0), (None, "", "en", "", float("nan")), (2, "é", "en", None, None),
            (2, "é", "en", None, None), (None, long, "x", "y", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, shard string, slot double")
    got = sharding.kd_shards(docs, 4, dimensions=("lang", "slot", "shard", "missing")).collect()
    check(got, [r[:2] for r in rows], 4, spread=len(long) + 1)
    empty = sharding.kd_shards(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["k1", "k2", "doc_id", "size", "crc", "shard", "slot"]


def test_written_shards(spark, folder):
    rows = [(k // 2, f"text {k // 2}", "en", "s") for k in range(60)] + [(None, None, "en", "s")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    sharding.write_shards(docs, f"{folder}/shards", shards=4)
    back = spark.read.parquet(f"{folder}/shards").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in back) == sorted((str(d), str(t)) for d, t, *_ in rows)
    by = defaultdict(list)
    for r in back:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_query(spark):
    got = sharding.op13_kd_shards(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"),
                          ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    assert got.where("grown_shard is not null or law <> 'bytes'").count() == 0
