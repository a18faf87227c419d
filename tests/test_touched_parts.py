"""Batches and changes that read and write only what they touch."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.operators import captures as C, solutions as D
from lorekeep.plans import enrich
from lorekeep.sources.ranges import Change, RangeTables
from lorekeep.sources.tables import write_part
from lorekeep.streaming.captures import CaptureSink
from lorekeep.streaming.runner import run_available

AT = "2024-01-01"


def rows_of(df):
    return sorted(map(str, df.collect()))


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet") if "_changes" not in str(p)}


@pytest.fixture
def stored(spark):
    requests = [(k, f"title {k}", f"solution {k}", "manual", "draft", ["t"]) for k in range(100)]
    columns = "seq bigint, title string, solution_text string, efficacy_source string, status string, tags array<string>"
    table = D.create_solutions(None, spark.createDataFrame(requests, columns), AT).table
    assert table.count() == 100
    return table


def opened(spark, folder):
    return RangeTables(spark, folder, {"solutions": "id"}, {"solutions": S.SOLUTION}, rows_per_range=10)


def test_updates_tags_and_deletes_leave_other_ranges_alone(spark, folder, stored):
    tables = opened(spark, folder)
    tables.create("solutions", stored)
    before = files_of(folder)
    columns = "seq bigint, id bigint, title string, problem string, solution_text string, status string, tags array<string>"
    updates = [(k, 30 + k, f"new {k}", "", f"new solution {k % 3}", "draft", ["u"]) for k in range(8)]
    updates = spark.createDataFrame(updates + [(20, 500, "x", "", "y", "draft", [])], columns)
    accepted, report = D.planned_updates(tables.read("solutions"), updates)
    want = D.update_solutions(stored, updates, AT)
    assert rows_of(report) == rows_of(want.outcomes)
    tables.apply(Change("solutions", accepted.select("id"), lambda part: D.apply_updates(part, accepted, AT)))
    assert rows_of(tables.read("solutions")) == rows_of(want.table)
    after = files_of(folder)
    touched = {f.split("/")[1] for f in before.keys() ^ after.keys()}
    assert touched == {"range=3"} and all(after[f] == before[f] for f in before if "range=3" not in f)

    state = spark.createDataFrame(tables.read("solutions").collect(), S.SOLUTION)
    changes = spark.createDataFrame([(5, ["b", "a"]), (77, [])], "id bigint, tags array<string>")
    tables.apply(Change("solutions", changes, lambda part: D.replace_tags(part, changes)))
    assert rows_of(tables.read("solutions")) == rows_of(D.replace_tags(state, changes))

    state = spark.createDataFrame(tables.read("solutions").collect(), S.SOLUTION)
    gone = spark.createDataFrame([(k, i) for k, i in enumerate([*range(50, 60), 12, 999])], "seq bigint, id bigint")
    done = D.delete_solutions(state, gone)
    tables.apply(Change("solutions", gone, lambda part: D.delete_solutions(part, gone).table))
    assert rows_of(opened(spark, folder).read("solutions")) == rows_of(done.table)
    assert not os.path.exists(f"{folder}/solutions/range=5")  # a range without rows goes


@pytest.mark.parametrize("fails", ["before the record", "between both tables"])
def test_two_tables_change_together(spark, folder, fails, monkeypatch):
    captures = C.insert_captures(None, spark.createDataFrame([(k, f"text {k}") for k in range(40)], "seq bigint, content string"), AT).table
    insights, _ = enrich.analyze_captures(captures, spark.createDataFrame([], S.INSIGHT), as_of=AT)
    names = {"captures": "id", "insights": "capture_id"}, {"captures": S.CAPTURE, "insights": S.INSIGHT}
    tables = RangeTables(spark, folder, *names, rows_per_range=8)
    tables.create("captures", captures)
    tables.create("insights", insights)
    gone = spark.createDataFrame([(3,), (17,), (18,), (4000,)], "id bigint")
    want = C.delete_captures(captures, insights, gone)
    real = RangeTables._write

    def failing(self, rows, table, path):
        if table == "insights" and ("_changes" in path) == (fails == "before the record"):
            raise OSError("lost")
        real(self, rows, table, path)

    changes = [
        Change("captures", gone, lambda part: part.join(gone, "id", "left_anti")),
        Change("insights", gone, lambda part: part.join(gone.withColumnRenamed("id", "capture_id"), "capture_id", "left_anti")),
    ]
    with monkeypatch.context() as m:
        m.setattr(RangeTables, "_write", failing)
        with pytest.raises(OSError):
            tables.apply(*changes)
    again = RangeTables(spark, folder, *names, rows_per_range=8)
    if fails == "before the record":
        assert rows_of(again.read("captures")) == rows_of(captures) and rows_of(again.read("insights")) == rows_of(insights)
        again.apply(*changes)
    assert rows_of(again.read("captures")) == rows_of(want[0])
    assert rows_of(again.read("insights")) == rows_of(want[1].select(S.INSIGHT.names))
    # an upsert adds insights in ranges that had none and replaces others
    fresh = spark.createDataFrame([(0, 3, "again", ["t"]), (1, 900, "far", []), (2, 5, "five", None)], "seq bigint, capture_id bigint, summary string, tags array<string>")
    whole = C.upsert_insights(spark.createDataFrame(again.read("insights").collect(), S.INSIGHT), fresh, AT)
    ids = fresh.select(F.col("capture_id").alias("id"))
    again.apply(Change("insights", ids, lambda part: C.upsert_insights(part, fresh, AT)))
    assert rows_of(again.read("insights")) == rows_of(whole.select(S.INSIGHT.names))


def test_a_batch_reads_as_much_late_as_early(spark, folder):
    """Twenty batches of five texts, two of them stored before: the index files a lookup opens do not pile up."""
    sink = CaptureSink(f"{folder}/out", as_of=AT)
    stored, opened_files = None, []
    for batch in range(20):
        texts = [f"batch {batch} text {k}" for k in range(3)] + ["always the same", f"batch {batch - 1} text 0"]
        rows = spark.createDataFrame([(10 * batch + k, t) for k, t in enumerate(texts)], "seq bigint, content string")
        if batch in (0, 1, 18, 19):
            keys = C.keyed_captures(rows).select("content_hash").distinct()
            index = sink._index(spark, "captures", "content_hash", batch)
            found = index.lookup(keys, batch)
            opened_files.append(len(found.inputFiles()))
        sink(rows, batch)
    assert sink.captures(spark).count() == 62 and sink.captures(spark).agg(F.max("id")).first()[0] == 62
    told = [r["outcome"] for r in sink.outcomes(spark).collect()]
    assert told.count("created") == 62 and told.count("duplicate") == 38
    # of some 60 files with a key each, a lookup of five keys opens those of at most five buckets
    assert max(opened_files) <= 10


def test_an_index_is_built_for_parts_written_before_it(spark, folder):
    sink = CaptureSink(f"{folder}/out", as_of=AT)
    batch = lambda k, *texts: spark.createDataFrame([(10 * k + j, t) for j, t in enumerate(texts)], "seq bigint, content string")
    write_part(C.insert_captures(None, batch(0, "a", "b"), AT).table, f"{folder}/out/captures", 0)
    sink(batch(1, "b", "c"), 1)
    assert sorted((r["id"], r["content"]) for r in sink.captures(spark).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_many_keys_are_joined(spark, folder, monkeypatch):
    from lorekeep.sources import keys

    monkeypatch.setattr(keys, "POINT_KEYS", 2)
    sink = CaptureSink(f"{folder}/out", as_of=AT)
    batch = lambda k, texts: spark.createDataFrame([(100 * k + j, t) for j, t in enumerate(texts)], "seq bigint, content string")
    sink(batch(0, [f"t{j}" for j in range(30)]), 0)
    sink(batch(1, [f"t{j}" for j in range(20, 50)]), 1)
    assert sink.captures(spark).count() == 50


def test_another_stream_is_refused(spark, folder):
    rows = spark.createDataFrame([(1, "a")], "seq bigint, content string")
    rows.write.parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema("seq bigint, content string").parquet(f"{folder}/in")
    sink = CaptureSink(f"{folder}/out", as_of=AT)
    run_available(stream(), sink, f"{folder}/one").awaitTermination()
    with pytest.raises(Exception, match="belongs to the stream"):
        run_available(stream(), sink, f"{folder}/two").awaitTermination()


def test_a_change_lists_its_folders_equally_often_for_any_number_of_ranges(spark, folder, stored, monkeypatch):
    tables = opened(spark, folder)
    tables.create("solutions", stored)
    listed = []
    names = RangeTables._names
    monkeypatch.setattr(RangeTables, "_names", lambda self, path: listed.append(path) or names(self, path))

    def listings(*ids):
        listed.clear()
        gone = spark.createDataFrame([(i,) for i in ids], "id bigint")
        tables.apply(Change("solutions", gone, lambda part: part.join(gone, "id", "left_anti")))
        return len(listed)

    one = listings(3)
    assert listings(4, 15, 26, 37, 48, 59, 61, 72) == one
    assert tables.read("solutions").count() == 91
