from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import keys, tags, text
from tests import model

NL = "\n"


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


SPACED = [f"{ch}a{ch}b{ch}" for ch in model.WS] + ["", model.WS, "\v\fx\f", " x​ "]


def test_trim_takes_all_unicode_white_space(spark):
    assert values(spark, text.utrim, *SPACED, None) == [s.strip(model.WS) for s in SPACED] + [None]


def test_lower_is_per_code_point(spark):
    assert values(spark, text.ulower, "İΣ ΟΔΟΣ É", "ABC") == ["iσ οδοσ é", "abc"]
    assert values(spark, text.alower, "İΣ É ABC") == ["İΣ É abc"]


def test_normalize_collapses_white_space_runs(spark):
    assert values(spark, text.normalize_text, *SPACED, "A\n\n\tB ") == [model.norm(s) for s in [*SPACED, "A\n\n\tB "]]


@pytest.mark.parametrize(
    ("content", "kind"),
    [
        ("https://x func ", "url"),
        ("HTTP://x", "url"),
        ("see http://x", "text"),
        ("a ``` b", "code"),
        ("Package main", "code"),
        ("user: class x", "code"),
        ("USER: hi", "chat_transcript"),
        ("system:", "chat_transcript"),
        (NL * 8, "text"),
        (NL * 9, "long_text"),
    ],
)
def test_content_type_rules_in_order(spark, content, kind):
    assert values(spark, text.content_type, content) == [kind]


def test_counts(spark):
    assert values(spark, text.char_count, "a😀b", "") == [3, 0]
    assert values(spark, text.line_count, "", "a", "a\n", "\n\n") == [0, 1, 2, 3]


def test_fallbacks(spark):
    assert values(spark, text.fallback_title, "x" * 24, "x" * 25, "😀" * 25, " \n") == ["x" * 24, "x" * 24, "😀" * 24, "未命名抓取"]
    assert values(spark, text.keep_raw_if_short, "x" * 4096, "x" * 4097, " 😀 ") == ["x" * 4096, "", "😀"]
    assert values(spark, lambda c: text.first_non_blank(c, F.lit(" b ")), " a ", " ", None) == ["a", "b", "b"]
    assert values(spark, lambda c: text.fallback_untrimmed(c, F.lit("d")), " a ", " ", None) == [" a ", "d", "d"]
    assert values(spark, lambda c: text.fallback_status(c, " "), "x", "") == ["x", "probable_success"]
    assert values(spark, lambda c: text.fallback_status(c, "failed"), "x", "") == ["x", "failed"]


def test_clamp_and_time(spark):
    assert values(spark, lambda c: text.clamp_confidence(c.cast("double")), "-1", "1.7", "0.25") == [0.0, 1.0, 0.25]
    assert values(spark, lambda c: text.rfc3339(c.cast("timestamp")), "2024-01-02 03:04:05") == ["2024-01-02T03:04:05Z"]
    parsed = values(spark, lambda c: text.parse_ts(c).cast("string"), "2024-01-02 03:04:05", "soon")
    assert parsed == ["2024-01-02 03:04:05", None]


@pytest.mark.parametrize(
    ("word", "hits"),
    [
        ("B", ["a\\b", "AB", "b\nc", "a😀b", "a.b"]),
        ("a_b", ["a\\b", "a😀b", "a.b"]),
        ("a\\b", ["a\\b"]),
        ("b%C", ["b\nc"]),
        ("a%_%B", ["a\\b", "a😀b", "a.b"]),
        ("b%a", []),
        (".", ["a.b"]),
        ("é", ["é"]),
        ("É", ["é"]),
        (" ", ["a\\b", "AB", "b\nc", "a😀b", "a.b", "é", "É"]),
        ("%", ["a\\b", "AB", "b\nc", "a😀b", "a.b", "é", "É"]),
    ],
)
def test_keyword_search(spark, word, hits):
    rows = ["a\\b", "AB", "b\nc", "a😀b", "a.b", "é", "É"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    found = df.where(text.contains_keyword(F.col("v"), text.keyword(word)))
    assert [r[0] for r in found.collect()] == hits


def test_keyword_search_stays_linear(spark):
    df = spark.createDataFrame([("ab" * 200_000,)], "v string")
    start = time.monotonic()
    assert df.where(text.contains_keyword(F.col("v"), "a%b%a%c")).count() == 0
    assert time.monotonic() - start < 20


def arrays(spark, column, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v array<string>")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_tag_rules(spark):
    assert arrays(spark, tags.tags_sorted_set, [" A", "a", "", "B"], None, ["ﾮ", "😀"]) == [["a", "b"], [], ["ﾮ", "😀"]]
    assert arrays(spark, tags.tags_ordered_distinct, ["b", "A", "a"], [None, "x"]) == [["b", "a"], ["x"]]
    assert values(spark, tags.split_tags_csv, "a, b,,", " ", None) == [["a", "b"], [], []]
    assert arrays(spark, lambda c: tags.append_category(c, F.lit(" ")), ["a"]) == [["a"]]
    assert arrays(spark, lambda c: tags.append_category(c, F.lit("c")), ["a"], None) == [["a", "c"], ["c"]]
    assert arrays(spark, lambda c: tags.concat_tags(c, ["x"]), ["a"], None) == [["a", "x"], ["x"]]
    assert arrays(spark, lambda c: tags.decode_tags(tags.encode_tags(c)), ['a"b', "c,d"], []) == [['a"b', "c,d"], []]
    assert values(spark, tags.decode_tags, "no json", None) == [[], []]


def test_fingerprint(spark):
    base = {
        "title": "A  Title", "problem": "p", "solution_text": "İ\tΣ", "source_type": "chat", "source_name": "n",
        "source_ref": "", "tags": ["b", "A"], "status": "draft",
    }
    same = [{**base, "title": " a title "}, {**base, "status": "failed"}, {**base, "tags": ["a", "B ", "b"]}]
    other = [{**base, "source_ref": "r"}, {**base, "tags": []}, {**base, "tags": ["a|b"]}]
    rows = [base, *same, *other, {**base, "tags": None, "problem": None}, {**base, "problem": ""}]
    df = spark.createDataFrame(
        [(i, *[r[c] for c in keys.KEY_FIELDS], r["tags"]) for i, r in enumerate(rows)],
        "i int, " + ", ".join(f"{c} string" for c in keys.KEY_FIELDS) + ", tags array<string>",
    )
    got = [r[0] for r in df.orderBy("i").select(keys.dedup_key()).collect()]
    assert got[0] == model.fingerprint(base)
    assert got[1:4] == [got[0]] * 3
    # A bar inside a tag joins to the same line as two tags.
    assert got[4] != got[0] and got[5] != got[0] and got[6] == got[0]
    assert got[7] == model.fingerprint({**base, "tags": [], "problem": ""})


def test_content_hash_keeps_case(spark):
    expected = [hashlib.sha256(s.encode()).hexdigest() for s in ("Ab", "ab")]
    assert values(spark, keys.content_hash, " Ab ", "ab") == expected
