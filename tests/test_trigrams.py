"""The trigram index, totals counted by the page's pass, and numbering by file name."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import captures as C, search as Q
from lorekeep.sources import candidates as src, trigrams
from lorekeep.sources.trigrams import TrigramIndex, word_grams
from lorekeep.plans.importing import import_path

TEXTS = ("title", "problem", "solution_text", "tags")
WORDS = ("needle", "NEE_le", "ab", "", "%", "n%edle", "ba%cd_e", "𝛼β𝛾", "ÉT", "zzz", "a\nb c", "tagged x", "dle pr")


def table(spark, n=400):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeÉé𝛼β𝛾 ") for _ in range(rng.randrange(1, 9)))
    rows = [(i, word(), None if i % 9 == 0 else word() + "\n" + word(), " ".join(word() for _ in range(8)), [word()]) for i in range(n)]
    rows += [(n, "x Needle", "p", "", None), (n + 1, "", None, "", ["tagged x", "two"]), (n + 2, None, None, None, [])]
    rows += [(n + 3, "t", "p", "abcd" * 262_143 + " nEEdle" + " x" * 300_000, []), (10**12 + 63, "needles", "", "", [])]
    return spark.createDataFrame(rows, "id bigint, title string, problem string, solution_text string, tags array<string>")


def found(rows, word):
    return sorted(r["id"] for r in Q.filter_solutions(rows, Q.SolutionFilter(query=word)).select("id").collect())


def test_same_rows_as_the_scan(spark, folder):
    rows = table(spark)
    index = TrigramIndex(folder, TEXTS)
    index.add(rows.repartition(3))
    for word in WORDS:
        assert found(index.narrowed(rows, word), word) == found(rows, word), word
    assert index.ids(spark, "Needle") == [400, 403, 10**12 + 63]
    assert index.ids(spark, "zzz") == [] and index.ids(spark, "ab") is None and index.ids(spark, "a_b%c") is None


def test_beyond_the_limit_the_texts_are_scanned(spark, folder, monkeypatch):
    rows = table(spark)
    index = TrigramIndex(folder, TEXTS)
    index.add(rows)
    monkeypatch.setattr(trigrams, "POINT_IDS", 2)
    assert index.ids(spark, "needle") is None
    assert found(index.narrowed(rows, "needle"), "needle") == [400, 403, 10**12 + 63]


def test_pieces_of_long_texts_overlap(spark, folder):
    rows = table(spark, 100)
    index = TrigramIndex(folder, TEXTS)
    index.add(rows)
    for word in WORDS:
        assert found(index.narrowed(rows, word), word) == found(rows, word), word


def test_parts_are_added_and_replayed(spark, folder):
    rows = table(spark, 70)
    index = TrigramIndex(folder, TEXTS)
    index.add(rows.where("id < 40"), 0)
    index.add(rows.where("id >= 40"), 1)
    index.add(rows.where("id >= 40"), 1)
    changed = rows.where("id = 7").withColumn("title", F.lit("a fresh needle"))
    index.add(changed, 2)
    now = rows.where("id <> 7").union(changed)
    for word in WORDS:
        assert found(index.narrowed(now, word), word) == found(now, word), word
    assert 7 in index.ids(spark, "needle")


def test_empty_table(spark, folder):
    rows = table(spark).limit(0)
    index = TrigramIndex(folder, TEXTS)
    index.add(rows)
    assert index.ids(spark, "needle") == [] and found(index.narrowed(rows, "needle"), "needle") == []


def test_few_texts_are_read_for_a_rare_word(spark, folder):
    table(spark, 4000).coalesce(1).write.option("parquet.block.size", 20_000).parquet(f"{folder}/t")
    stored = spark.read.parquet(f"{folder}/t")
    index = TrigramIndex(f"{folder}/i", TEXTS)
    index.add(stored)
    near = index.narrowed(stored, "needle")
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [" in text and index.ids(spark, "needle") == [4000, 4003, 10**12 + 63]
    assert near.count() == 3


def test_word_grams():
    assert word_grams("abcd") == ["abc", "bcd"] and word_grams("ab%cd_efg") == ["efg"] and word_grams("ab") == []


def test_captures_by_index(spark, folder):
    captures = spark.createDataFrame(
        [(i, f"body {i} text", "text", i) for i in range(50)], "id bigint, content string, content_type string, at bigint"
    ).withColumn("captured_at", F.timestamp_seconds("at"))
    told = spark.createDataFrame([(3, "Rare sum", "x"), (60, "rare", None)], "capture_id bigint, summary string, category string")
    own, other = TrigramIndex(f"{folder}/a", C.CAPTURE_TEXTS), TrigramIndex(f"{folder}/b", C.INSIGHT_TEXTS, "capture_id")
    own.add(captures)
    other.add(told)
    for word in ("rare", "y 4", "body 33", "none of it", "t"):
        f = Q.CaptureFilter(query=word)
        plain = sorted(r["id"] for r in C.matching_captures(captures, told, f).collect())
        assert plain == sorted(r["id"] for r in C.matching_captures(captures, told, f, own, other).collect()), word


@pytest.mark.parametrize("deep", [False, True])
def test_page_and_total_in_one_pass(spark, monkeypatch, deep):
    if deep:
        monkeypatch.setattr(Q, "DEEP_OFFSET", -1)
    rows = table(spark, 90).withColumn("updated_at", F.timestamp_seconds(F.lit(1)))
    for word, offset in (("needle", 0), ("needle", 1), ("", 80), ("", 500), ("zzz", 0)):
        page, totals = Q.page_with_total(rows, Q.SolutionFilter(query=word, limit=10, offset=offset))
        expected = found(rows, word)[::-1]
        assert [r["id"] for r in page.collect()] == expected[offset : offset + 10]
        assert tuple(totals.first()) == (len(expected[offset : offset + 10]), len(expected))
    assert tuple(Q.page_with_total(rows.limit(0), Q.SolutionFilter())[1].first()) == (0, 0)
    assert tuple(Q.page_with_total(rows.where(F.col("id").isin([])), Q.SolutionFilter())[1].first()) == (0, 0)


def test_numbers_follow_file_names(spark, folder):
    def put(name, text):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)

    lines = lambda name, n: "\n\n".join(f'{{"title": "{name}{i}"}}' for i in range(n))
    put("b.jsonl", lines("b", 300))
    put("d.json", '[{"title": "d0"},\n {"title": "d1"}]')
    put("a.jsonl", lines("a", 40))
    expected = [f"a{i}" for i in range(40)] + [f"b{i}" for i in range(300)] + ["d0", "d1"]
    for size in ("128m", "500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = src.DEFAULT_SOURCES.read_numbered(spark, "local_json", folder).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r["seq"], r["title"]) for r in sorted(got, key=lambda r: r["seq"])] == list(enumerate(expected))
    # a new, larger file does not move the rows of files with lesser names
    put("c.jsonl", lines("c", 5000))
    got = sorted(src.DEFAULT_SOURCES.read_numbered(spark, "local_json", folder).collect(), key=lambda r: r["seq"])
    assert [r["title"] for r in got][:340] == expected[:340] and got[-1]["title"] == "d1"
    assert "_at" not in src.DEFAULT_SOURCES.read(spark, "local_json", folder).columns


def test_numbers_of_other_sources(spark, folder):
    spark.range(50).selectExpr("concat('t', id) as title", "'x' as _at", "array('a') as tags").repartition(3).write.parquet(f"{folder}/p")
    got = src.DEFAULT_SOURCES.read_numbered(spark, "parquet", f"{folder}/p").collect()
    assert sorted(r["seq"] for r in got) == list(range(50)) and len({r["title"] for r in got}) == 50
    own = src.SourceRegistry(mine=lambda s, p: s.createDataFrame([("x",), ("y",)], "title string").coalesce(1))
    assert [(r["seq"], r["title"]) for r in own.read_numbered(spark, "mine", "p").collect()] == [(0, "x"), (1, "y")]
    with open(f"{folder}/empty.json", "w") as f:
        f.write(" \n")
    assert import_path(spark, f"{folder}/empty.json").summary.first()[0] == 0


def test_files_of_postings_follow_the_texts_and_a_gram_lies_in_one(spark, folder, monkeypatch):
    monkeypatch.setattr(trigrams, "FILE_CHARS", 1000, raising=False)
    rows = table(spark, 100).where("length(solution_text) < 1000")
    index = TrigramIndex(folder, TEXTS)
    index.add(rows.repartition(3))
    stored = spark.read.parquet(f"{folder}/postings").select("gram", F.input_file_name().alias("file"))
    chars = rows.select(F.sum(F.char_length(F.concat_ws("\n", *TEXTS)))).first()[0]
    assert chars // 2000 < stored.select("file").distinct().count() <= chars // 1000 + 1
    assert stored.groupBy("gram").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0
