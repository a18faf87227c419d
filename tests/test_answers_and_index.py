"""What one pass over the answers and one batch of keys cost."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.plans import enrich
from lorekeep.sources.keys import KeyIndex


def test_answers_are_parsed_once_for_insights_and_report(spark):
    rows = [(k, f"text {k}", "note", "clipboard", datetime(2024, 1, 1)) for k in range(1, 6)]
    captures = spark.createDataFrame(rows, "id bigint, content string, content_type string, source string, captured_at timestamp")
    fresh, report = enrich.analyze_captures(captures, spark.createDataFrame([], S.INSIGHT), as_of="2024-01-05 00:00:00")
    for df in (fresh, report):
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["status"] for r in report.collect()} == {k: "ok" for k in range(1, 6)}
    assert sorted((r["capture_id"], r["title"]) for r in fresh.collect()) == [(k, f"text {k}") for k in range(1, 6)]


def test_key_index_is_as_small_as_its_keys(spark, folder):
    keys = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.col("id"))
    index = KeyIndex(f"{folder}/keys", "content_hash")
    index.add(keys, 0, 1999)
    assert sum(f.stat().st_size for f in Path(f"{folder}/keys").rglob("*.parquet")) < 4 << 20
    for some in (700, 20):
        asked = keys.where(F.col("id") < some).select("content_hash").union(spark.createDataFrame([("f" * 64,)], "content_hash string"))
        assert sorted(r["id"] for r in index.lookup(asked, 1).collect()) == list(range(some))
