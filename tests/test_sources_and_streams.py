from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.operators.captures import insert_captures
from lorekeep.session import staging_root
from lorekeep.sources import candidates as src, tables
from lorekeep.streaming.captures import CaptureSink
from lorekeep.streaming.runner import run_available


def put(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def titles(df):
    return [r["title"] for r in df.collect()]


def test_json_array(spark, folder):
    path = put(folder, "a.json", ' \n[{"title": "x", "tags": ["t"], "extra": 1},\n {"problem": "p"}] trailing')
    rows = src.DEFAULT_SOURCES.read(spark, "Local_JSON ", f" {path} ").collect()
    assert [(r["title"], r["problem"], r["tags"]) for r in rows] == [("x", "", ["t"]), ("", "p", [])]
    nulls = put(folder, "n.json", '[null, {"title": "x"}]')
    assert titles(src.read_json(spark, nulls, "array_with_nulls")) == [None, "x"]


def test_json_lines(spark, folder):
    path = put(folder, "a.jsonl", '{"title": "x"}\n\n  \nnull\n {"title": "y", "status": "draft"} \n')
    assert titles(src.DEFAULT_SOURCES.read(spark, "local_json", path)) == ["x", "", "y"]
    seqs = [r["seq"] for r in src.numbered(src.read_json(spark, path)).collect()]
    assert seqs == sorted(set(seqs))


def test_bad_json_fails_the_read(spark, folder):
    for name, text in (("l", '{"title": "x"}\n{bad\n'), ("t", '{"title": "x", "tags": 5}\n'), ("a", '[{"title": "x"}, {bad]')):
        with pytest.raises(Exception, match="(?i)malformed"):
            src.read_json(spark, put(folder, name, text)).collect()


def test_empty_file(spark, folder):
    assert src.read_json(spark, put(folder, "e", "")).count() == 0


def test_registry_errors(spark):
    with pytest.raises(ValueError, match="no import source .* 'nope'"):
        src.DEFAULT_SOURCES.read(spark, "nope", "x")
    with pytest.raises(ValueError, match="path is blank"):
        src.DEFAULT_SOURCES.read(spark, "local_json", " \t")
    own = src.SourceRegistry()
    own.register(" Mine", lambda s, p: s.createDataFrame([("x",)], "title string"))
    assert titles(own.read(spark, "MINE", "p")) == ["x"]


def test_snapshots(spark, folder):
    path, schema = f"{folder}/t", spark.range(1).schema
    assert tables.read_snapshot(spark, path, schema) is None
    assert tables.write_snapshot(spark.range(3), path) == 1
    assert tables.write_snapshot(spark.range(5), path) == 2
    unfinished = f"{path}/v=3"
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(unfinished)
    assert tables.complete_versions(spark, path) == [1, 2]
    assert tables.read_snapshot(spark, path, schema).count() == 5


def test_parts_and_compaction(spark, folder):
    path, schema = f"{folder}/p", spark.range(1).schema
    assert tables.read_parts(spark, path, schema).count() == 0
    for batch in (0, 1, 10, 10):
        tables.write_part(spark.range(batch, batch + 2), path, batch)
    ids = lambda root, before=None: sorted(r["id"] for r in tables.read_parts(spark, root, schema, before).collect())
    assert ids(path) == [0, 1, 1, 2, 10, 11] and ids(path, 10) == [0, 1, 1, 2]
    assert tables.compact_parts(spark, path, schema, f"{folder}/q") == 10
    assert ids(f"{folder}/q", 11) == ids(path) and ids(f"{folder}/q", 10) == []


def test_staging_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert staging_root(spark) == (named or spark.sparkContext.getCheckpointDir())


LOADS = (["b", " a ", "func a", ""], ["a", "c", "B", "c", "https://d"])


def test_capture_stream_is_the_batch_result(spark, folder):
    frames = [
        spark.createDataFrame([(10 * i + j, t) for j, t in enumerate(load)], "seq bigint, content string")
        for i, load in enumerate(LOADS)
    ]
    stored = None
    for rows in frames:
        stored = insert_captures(stored, rows, "2024-01-01").table
    sink = CaptureSink(f"{folder}/out", auto_analyze=True, model="m", as_of="2024-01-01")
    for rows in frames:
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("seq bigint, content string").parquet(f"{folder}/in")
        run_available(stream, sink, f"{folder}/checkpoint").awaitTermination()
    order = lambda df: sorted(map(tuple, df.select("id", "content", "content_type").collect()))
    assert order(sink.captures(spark)) == order(stored)
    assert sink.insights(spark).count() == stored.count()
    made = {r["source_ref"]: r["id"] for r in sink.solutions(spark).collect()}
    assert made == {f"capture://{i}": i for i in range(1, stored.count() + 1)}

    sink(frames[-1], 1)  # a replay of the last batch rewrites the same rows
    assert order(sink.captures(spark)) == order(stored)


def test_conform_and_defaults(spark):
    df = S.fill_defaults(S.conform(spark.createDataFrame([(None,)], "title string"), S.CANDIDATE))
    assert df.columns == S.CANDIDATE.names
    assert df.select("title", "tags").first() == ("", [])
    assert df.select(F.count_if(F.col("status").isNull())).first()[0] == 0


def test_each_file_has_its_own_layout(spark, folder):
    (Path(folder) / "mixed dir").mkdir()
    item = lambda name: json.dumps({"title": name})
    for size in (1, 200):  # whichever file Spark takes first
        (Path(folder) / "mixed dir/a.json").write_text("\n [" + ",".join(item(f"a{k}") for k in range(5 * size)) + "]")
        (Path(folder) / "mixed dir/b.jsonl").write_text("\n".join(item(f"b{k}") for k in range(300)))
        (Path(folder) / "mixed dir/c.jsonl").write_text(" \n")
        got = [r["title"] for r in src.read_json(spark, f"{folder}/mixed dir").collect()]
        assert sorted(got) == sorted([f"a{k}" for k in range(5 * size)] + [f"b{k}" for k in range(300)])


@pytest.mark.parametrize("line", ['{"title":"a"} {"title":"b"}', '{"title":"c"} junk', '{"title":"d"},{"title":"e"}', '{"title":'])
def test_a_line_holds_one_value(spark, folder, line):
    (Path(folder) / "x.jsonl").write_text('{"title":"ok"}\n' + line + "\n")
    with pytest.raises(Exception):
        src.read_json(spark, folder).collect()


def test_snapshots_keep_ids_in_disjoint_files(spark, folder):
    rows = spark.range(0, 1000).repartition(4).withColumn("text", F.lit("x"))
    tables.write_snapshot(rows, folder)
    spans = spark.read.parquet(f"{folder}/v=1").groupBy("_metadata.file_name").agg(F.min("id"), F.max("id")).collect()
    spans = sorted(tuple(r)[1:] for r in spans)
    assert sum(b - a + 1 for a, b in spans) == 1000 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
