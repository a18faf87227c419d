"""What a capture stream's batch leaves on disk: its parts, and nothing it has staged or shuffled on the way."""

from __future__ import annotations

import time
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.plans import enrich
from lorekeep.plans.promote import promotion_requests
from lorekeep.session import scratch, stage, staging_root
from lorekeep.streaming.captures import CaptureSink

ROWS = [(1, "a"), (2, " a "), (3, "func x"), (4, ""), (5, "https://d"), (6, "long " * 2000)]


def staged(spark) -> set[str]:
    return {p.name for p in Path(urlparse(staging_root(spark)).path).iterdir()}


def shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(k).getName() for k in range(found.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_a_batch_leaves_nothing_staged(spark, folder):
    rows = spark.createDataFrame(ROWS, "seq bigint, content string")
    before = staged(spark)
    sink = CaptureSink(f"{folder}/out", auto_analyze=True, as_of="2024-01-01")
    for k in range(2):
        sink(rows.withColumn("seq", F.col("seq") + 10 * k), k)
    assert staged(spark) == before
    assert sink.captures(spark).count() == sink.insights(spark).count() == sink.solutions(spark).count() == 4
    raw = {r["id"]: r["raw_content"] for r in sink.solutions(spark).collect()}
    assert raw == {1: "a", 2: "func x", 3: "https://d", 4: ""}


def test_scratch_removes_what_is_staged_inside_alone(spark):
    before = staged(spark)
    kept = stage(spark.range(3), "kept")
    with pytest.raises(ValueError), scratch(spark):
        with scratch(spark):
            stage(spark.range(2), "inner")
        assert stage(spark.range(1), "outer").count() == 1
        raise ValueError
    (left,) = staged(spark) - before
    assert left.startswith("kept-") and kept.count() == 3


def test_a_staged_result_gives_its_shuffles_back(spark):
    before = shuffle_files(spark)
    stage(spark.range(1000).repartition(3, "id"), "shuffled")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not [n for n in shuffle_files(spark) - before if n.endswith(".data")]


def test_without_insights_all_captures_are_asked_and_answers_are_stored_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(enrich, "stage", lambda df, label: written.append(df.columns) or stage(df, label))
    rows = [(k, f"text {k}", "note", "clipboard", None) for k in range(1, 4)]
    captures = spark.createDataFrame(rows, "id bigint, content string, content_type string, source string, captured_at timestamp")
    fresh, report = enrich.analyze_captures(captures, None, as_of="2024-01-05 00:00:00")
    assert sum("body" in columns for columns in written) == 1
    assert sorted(r["capture_id"] for r in fresh.collect()) == [1, 2, 3] and fresh.columns == S.INSIGHT.names
    assert {r["id"]: r["status"] for r in report.collect()} == {1: "ok", 2: "ok", 3: "ok"}
    made = sorted(tuple(r) for r in promotion_requests(captures, fresh).select("seq", "title", "raw_content").collect())
    assert made == [(k, f"text {k}", f"text {k}") for k in range(1, 4)]
