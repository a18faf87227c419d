"""The stored inputs of the queries are computed once, and queries read only the columns they show."""

from __future__ import annotations

from lorekeep.operators import captures as C
from workload import base, queries

TABLES = {
    "documents": ("doc_id bigint, text string, lang string, source string, n_chars bigint", [(i, f"text {i % 4}", "en", "s", 6) for i in range(6)]),
    "labels": ("doc_id bigint, quality int, toxic int", [(1, 1, 0), (3, 0, 1), (5, 1, 0)]),
    "pages": ("page_id bigint, url string, html string", [(0, "http://a/", "<p>")]),
    "conversations": ("conv_id bigint, turn bigint, role string, text string", [(0, 0, "user", "hi")]),
    "benchmark": ("item_id bigint, text string", [(0, "x")]),
    "region": ("r_regionkey int", [(0,)]),
}


def given(spark, folder):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_captures_are_keyed_once_for_their_table_and_their_insights(spark, folder, monkeypatch):
    labels = []
    stage = C.stage
    monkeypatch.setattr(C, "stage", lambda df, label: labels.append(label) or stage(df, label))
    given(spark, folder)
    assert base.captures(spark, folder).count() == 7
    assert sorted(r[0] for r in base.insights(spark, folder).select("capture_id").collect()) == [5, 7]
    assert labels.count("capture-keys") == 1


def test_insights_write_their_texts_once(spark, folder, monkeypatch):
    written = {}
    stage = base.stage
    monkeypatch.setattr(base, "stage", lambda df, label: written.update({label: df.columns}) or stage(df, label))
    assert base.insights(spark, given(spark, folder)).where("summary = 'text 3'").count() == 1
    assert [label for label, columns in written.items() if "summary" in columns] == ["insights"]


def test_captures_with_insight_moves_only_the_columns_it_shows(spark, folder):
    rows = queries.captures_with_insight(spark, given(spark, folder))
    found = sorted((r["id"], r["analyzed"], r["summary"]) for r in rows.collect())
    read = rows._jdf.queryExecution().executedPlan().toString()
    assert "raw_json" not in read and "solution_text" not in read
    assert found == [(i, i in (5, 7), {5: "text 1", 7: "text 3"}.get(i)) for i in range(1, 8)]
