from __future__ import annotations

import json

from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.operators import captures as C
from lorekeep.operators.search import CaptureFilter, parse_analyzed
from lorekeep.plans import enrich, promote


def inserted(spark, texts, stored=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "seq bigint, content string")
    return C.insert_captures(stored, rows, "2024-01-01 10:00:00.9")


def outcomes(df):
    return {r["seq"]: (r["outcome"], r["id"]) for r in df.collect()}


def insights(spark, rows):
    full = [{"seq": i, "tags": [], "confidence": 0.0} | r for i, r in enumerate(rows)]
    texts = [n for n in S.INSIGHT.names if n not in ("capture_id", "confidence", "tags", "analyzed_at")]
    df = spark.createDataFrame(
        [(r["seq"], r["capture_id"], r["confidence"], r["tags"], *[r.get(t) for t in texts]) for r in full],
        "seq bigint, capture_id bigint, confidence double, tags array<string>, " + ", ".join(f"{t} string" for t in texts),
    )
    return C.upsert_insights(None, df, "2024-01-02")


def test_insert_is_first_wins(spark):
    one = inserted(spark, ["b", " a ", "a", "  ", None, "A"])
    assert outcomes(one.outcomes) == {
        0: ("created", 1), 1: ("created", 2), 2: ("duplicate", 2), 3: ("empty", None), 4: ("empty", None), 5: ("created", 3),
    }
    two = inserted(spark, ["c", "a\n", "c"], one.table)
    assert outcomes(two.outcomes) == {0: ("created", 4), 1: ("duplicate", 2), 2: ("duplicate", 4)}
    rows = {r["id"]: r for r in two.table.collect()}
    assert rows[2]["content"] == "a" and rows[2]["source"] == "clipboard"
    assert str(rows[4]["captured_at"]) == "2024-01-01 10:00:00"


def test_upsert_overwrites_and_keeps_the_last(spark):
    first = insights(spark, [{"capture_id": 1, "title": "x", "tags": ["b", "A", "a"]}, {"capture_id": 2}])
    rows = spark.createDataFrame([(1, 1, "y"), (2, 1, "z"), (3, 3, "n")], "seq bigint, capture_id bigint, title string")
    got = {r["capture_id"]: r for r in C.upsert_insights(first, rows.withColumn("tags", F.array()), "2024-03-01").collect()}
    assert {i: r["title"] for i, r in got.items()} == {1: "z", 2: "", 3: "n"}
    assert got[2]["tags"] == [] and got[1]["analyzed_at"] > got[2]["analyzed_at"]
    assert first.where("capture_id = 1").first()["tags"] == ["b", "a"]


def test_analyzed_filter_and_search(spark):
    table = inserted(spark, ["alpha", "beta func x", "gamma"]).table
    told = insights(spark, [{"capture_id": 3, "summary": "ALPHA too", "title": "g", "raw_json": "{}"}])
    found = lambda **f: [r["id"] for r in C.list_captures(table, told, CaptureFilter(**f)).collect()]
    assert found() == [3, 2, 1]
    assert found(query="Alpha") == [3, 1]
    assert found(query="alpha", analyzed=True) == [3]
    assert found(query="alpha", analyzed=False) == [1]
    assert found(query="CODE") == [2]
    assert found(limit=1, offset=1) == [2]
    assert [parse_analyzed(x) for x in (None, " ", "TRUE", "1", "yes")] == [None, None, True, True, False]
    page = C.list_captures(table, told, CaptureFilter(limit=1)).first()
    assert page["insight"]["title"] == "g" and "raw_json" not in page["insight"].asDict()
    looked = C.lookup_captures(table, told, spark.createDataFrame([(1,), (3,), (9,)], "id bigint"))
    got = {r["id"]: (r["found"], r["insight"] is not None) for r in looked.collect()}
    assert got == {1: (True, False), 3: (True, True), 9: (False, False)}


def test_deletes(spark):
    table = inserted(spark, ["a", "b", "c"]).table
    told = insights(spark, [{"capture_id": 1}, {"capture_id": 3}])
    left, kept = C.delete_captures(table, told, spark.createDataFrame([(1,), (77,)], "id bigint"))
    assert sorted(r["id"] for r in left.collect()) == [2, 3]
    assert [r["capture_id"] for r in kept.collect()] == [3]
    keep, deleted = C.clear_unanalyzed(table, told)
    assert sorted(r["id"] for r in keep.collect()) == [1, 3] and deleted.first()[0] == 1


def parsed(spark, *bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "id bigint, body string")
    return {r["id"]: r for r in enrich.normalize_analysis(enrich.parse_responses(df)).collect()}


def test_response_parsing(spark):
    text = json.dumps({"title": " T ", "category": " SQL", "confidence": 1.7, "tags": [" A", "a", "", "B"]})
    part = lambda t, kind="output_text": {"type": kind, "text": t}
    bodies = [
        {"output": [{"content": [part("no", "refusal"), part(text[:20])]}, {}, {"content": [part(text[20:], "text")]}]},
        {"output": [{"content": [part(" ")]}]},
        {"output": []},
        {"output": [{"content": [part("{broken")]}]},
    ]
    got = parsed(spark, *map(json.dumps, bodies), "<html>", json.dumps({"output": [{"content": [part('{"confidence": -1}')]}]}))
    assert [got[i]["parse_error"] for i in range(6)] == [None, "empty_output", "empty_output", "bad_json", "bad_envelope", None]
    assert (got[0]["title"], got[0]["category"], got[0]["confidence"], got[0]["tags"]) == ("T", "sql", 1.0, ["a", "b"])
    assert (got[5]["title"], got[5]["confidence"], got[5]["tags"]) == ("", 0.0, [])


def test_answers_with_more_than_one_value_or_other_kinds_are_rejected(spark):
    envelope = lambda text: json.dumps({"output": [{"content": [{"type": "output_text", "text": text}]}]})
    bad = [
        '{"title":"x"} junk', '{"title":"x"} {"title":"y"}', '{"title":"x"},{"title":"y"}', '{"title":5}', '{"tags":"t"}',
        '{"tags":["t",5]}', '{"confidence":"high"}', '{"title":{"a":1}}',
    ]
    good = ['{"title":"x"}', ' {"title":null,"tags":null,"confidence":null}\n', '{"tags":["a",null],"confidence":-0.5,"other":[1]}']
    got = parsed(spark, *map(envelope, bad + good), envelope('{"title":"x"}') + "<html>")
    kinds = [got[i]["parse_error"] for i in range(len(bad) + len(good) + 1)]
    assert kinds == ["bad_json"] * len(bad) + [None] * len(good) + ["bad_envelope"]


def test_report_of_one_hot_id_and_rejects_gets_its_time(spark):
    done = inserted(spark, ["same"] * 50 + [" "] * 50 + ["other"])
    report = C.with_capture_time(done.outcomes, done.table).collect()
    assert len(report) == 101
    assert all((r["captured_at"] is None) == (r["id"] is None) for r in report)


def test_request_is_json_with_the_whole_text(spark):
    text = 'say "hi"\n\tÉ😀\\ ' + "x" * 9000 + "."
    table = inserted(spark, [text]).table
    body = json.loads(table.select(enrich.request_json("m", "do it")).first()[0])
    assert body["model"] == "m" and body["input"][0]["content"][0]["text"] == "do it"
    assert body["input"][1]["content"][0]["text"] == f"Captured at: 2024-01-01T10:00:00Z\nContent type: text\nCaptured content:\n{text}"
    schema = body["text"]["format"]["schema"]
    assert schema["required"] == S.ANALYSIS.names and not schema["additionalProperties"]
    assert schema["properties"]["suggested_status"]["enum"] == list(S.STATUSES)


def answer(row):
    if row["content"].startswith("key"):
        raise enrich.MissingKey
    if row["content"].startswith("slow"):
        raise TimeoutError
    if row["content"].startswith("bad"):
        raise ValueError("status 500")
    return enrich.rule_answer(row)


def test_analyze_keeps_failures_apart_and_promotes(spark):
    table = inserted(spark, ["key", "slow", "bad", "fine\nmore", "known"]).table
    told = insights(spark, [{"capture_id": 5, "title": "", "summary": "s", "suggested_status": "odd"}])
    fresh, report = enrich.analyze_captures(table, told, enrich.calls(answer), model="m", as_of="2024-01-03")
    assert {r["id"]: r["status"] for r in report.collect()} == {1: "unavailable", 2: "timeout", 3: "error", 4: "ok", 5: "cached"}
    rows = {r["capture_id"]: r for r in fresh.collect()}
    assert set(rows) == {4, 5}
    assert (rows[4]["title"], rows[4]["source_name"], rows[4]["suggested_status"]) == ("fine", "clipboard", "draft")

    asked = spark.createDataFrame([(1, 4), (2, 5), (3, 1), (4, 99), (5, 4)], "seq bigint, id bigint")
    done = promote.promote_captures(table, fresh, None, asked, "2024-01-04")
    assert outcomes(done.outcomes) == {
        1: ("created", 1), 2: ("invalid", None), 3: ("unanalyzed", None), 4: ("not_found", None), 5: ("duplicate", 1),
    }
    made = done.table.first()
    assert (made["source_ref"], made["raw_content"], made["tags"]) == ("capture://4", "fine\nmore", ["auto", "text"])
    again = promote.promote_captures(table, fresh, done.table, asked.where("seq = 5"))
    assert outcomes(again.outcomes) == {5: ("duplicate", 1)}


def test_throttle_refuses_recent_texts(spark):
    rows = [(i, f"t{i}", f"h{i}", "text", 1, 1, "src") for i in range(1, 4)]
    table = spark.createDataFrame(rows, "id bigint, content string, content_hash string, content_type string, char_count int, line_count int, source string")
    table = table.withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    twice = table.unionByName(table.where("id = 1").withColumn("id", F.lit(4).cast("bigint")))
    none = spark.createDataFrame([], S.INSIGHT)
    _, report = enrich.analyze_captures(twice, none, throttle_by="source")
    assert {r["id"]: r["status"] for r in report.collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "throttled"}


def test_analysis_by_request(spark):
    table = inserted(spark, ["key", "one", "two", "three", "four", "known"]).table
    told = insights(spark, [{"capture_id": 6, "title": "", "summary": "s", "suggested_status": "draft"}])
    ask = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "seq bigint, id bigint")
    statuses = lambda done: [r["status"] for r in sorted(done.report.collect(), key=lambda r: r["seq"])]
    how = {"extractor": enrich.calls(answer), "as_of": "2024-01-03"}

    done = enrich.analyze_requests(table, told, ask(1, 1, 2, 99, 6, 3, None, 4, 1, 2), **how)
    assert statuses(done) == [
        "unavailable", "throttled", "ok", "not_found", "cached", "ok", "not_found", "ok", "unavailable", "cached",
    ]
    assert {r["capture_id"] for r in done.table.collect()} == {2, 3, 4, 6}
    after = enrich.analyze_requests(table, told, ask(2, 3, 5), rings=done.rings, **how)
    assert statuses(after) == ["throttled", "ok", "ok"]
    empty = enrich.analyze_requests(table, told, ask(5).where("false"), rings=after.rings, **how)
    assert empty.report.count() == 0 and empty.table.count() == 1
    assert empty.rings.collect() == after.rings.collect()


def test_requests_for_one_hot_id(spark, monkeypatch):
    monkeypatch.setattr("lorekeep.operators.first_wins.HOT_KEY_ROWS", 10)
    table = inserted(spark, ["one", "two"]).table
    asked = spark.createDataFrame([(i, 1 if i < 60 else 2) for i in range(80)], "seq bigint, id bigint")
    none = spark.createDataFrame([], S.INSIGHT)
    report = enrich.analyze_requests(table, none, asked, as_of="2024-01-03").report
    counts = {tuple(r)[:2]: r["count"] for r in report.groupBy("id", "status").count().collect()}
    assert counts == {(1, "ok"): 1, (1, "throttled"): 59, (2, "ok"): 1, (2, "throttled"): 19}


def test_contract_check(spark):
    good = ("t", "s", "c", "p", "x", "", "", "", "draft", 0.5, [])
    rows = [good, (None, *good[1:]), (*good[:8], "odd", 0.5, []), (*good[:10], None)]
    df = enrich.check_analysis(spark.createDataFrame(rows, S.ANALYSIS))
    assert [r["contract_error"] for r in df.collect()] == [None, "missing title", "unknown suggested_status", "missing tags"]
