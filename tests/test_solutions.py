from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.operators import first_wins, search as Q, solutions as D
from lorekeep.plans import importing
from tests import model

FIELDS = ("title", "problem", "solution_text", "efficacy_source", "status", "source_type", "source_name", "source_ref")


def make_requests(rng, n, hot=False):
    rows = []
    for seq in rng.sample(range(n * 5), n):
        text = "hot" if hot and rng.random() < 0.4 else rng.choice(["a b", "A  b ", "c", " ", "d\ne", "D E", "f"])
        rows.append(
            {
                "seq": seq,
                "title": rng.choice(["T", " t", "U", ""]) if not hot else "T",
                "problem": rng.choice(["", "p"]) if not hot else "",
                "solution_text": text,
                "efficacy_source": "auto",
                "status": rng.choice(["draft", " Failed", "bogus"]) if not hot else "draft",
                "source_type": "x",
                "source_name": "",
                "source_ref": "",
                "tags": rng.choice([["a", "b"], ["B", " a"], []]) if not hot else [],
            }
        )
    return rows


def frame(spark, rows):
    schema = "seq bigint, " + ", ".join(f"{f} string" for f in FIELDS) + ", tags array<string>"
    return spark.createDataFrame([(r["seq"], *[r[f] for f in FIELDS], r["tags"]) for r in rows], schema)


def outcomes(df):
    return {r["seq"]: (r["outcome"], r["id"]) for r in df.collect()}


def state(df):
    return {r["id"]: (r["title"], r["problem"], r["solution_text"], r["status"], r["tags"], r["dedup_key"]) for r in df.collect()}


def model_state(table):
    return {i: (r["title"], r["problem"], r["solution_text"], r["status"], r["tags"], r["key"]) for i, r in table.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_create_and_update_follow_the_sequential_model(spark, seed):
    rng = random.Random(seed)
    table = {}
    stored = None
    for _ in range(2):
        rows = make_requests(rng, 60)
        done = D.create_solutions(stored, frame(spark, rows), "2024-01-01")
        assert outcomes(done.outcomes) == model.create(table, rows)
        assert state(done.table) == model_state(table)
        stored = done.table
    assert sorted(table) == list(range(1, len(table) + 1))

    ids = [*table, 9999]
    changes = [{**r, "id": rng.choice(ids)} for r in make_requests(rng, 50)]
    updates = spark.createDataFrame(
        [tuple(r[c] for c in ("seq", "id", "title", "problem", "solution_text", "status", "tags")) for r in changes],
        "seq bigint, id bigint, title string, problem string, solution_text string, status string, tags array<string>",
    )
    done = D.update_solutions(stored, updates, "2024-02-01")
    before = dict(table)
    assert outcomes(done.outcomes) == model.update(table, changes)
    assert state(done.table) == model_state(table)
    bumped = {r["id"] for r in done.table.where("updated_at > created_at").collect()}
    assert bumped == {i for i in table if table[i] is not before[i]}


def test_hot_keys_take_the_broadcast_path(spark, monkeypatch):
    monkeypatch.setattr(first_wins, "HOT_KEY_ROWS", 5)
    monkeypatch.setattr(first_wins, "HOT_KEYS_MAX", 2)
    rows = make_requests(random.Random(3), 80, hot=True)
    table = {}
    done = D.create_solutions(None, frame(spark, rows))
    assert outcomes(done.outcomes) == model.create(table, rows)
    assert state(done.table) == model_state(table)


def test_dense_rank_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).withColumn("x", F.col("id") * 37 % 5003).repartition(5)
    rows = first_wins.with_dense_rank(df, "x").orderBy("x").collect()
    assert [r["rank"] for r in rows] == list(range(5000))


CANDIDATES = [
    ("Descale the kettle", "slow to boil", "Vinegar and water, one hour.", "note", "kitchen", "n-7", "raw://7", ["kettle", "lime"], None),
    ("Quiet hinge", "door squeaks", "A drop of oil on the pin.", "note", "hall", "n-8", "raw://8", ["door"], "confirmed_success"),
]


def test_import_of_two_candidates_and_again(spark, folder):
    path = f"{folder}/in"
    spark.createDataFrame(CANDIDATES, S.CANDIDATE).coalesce(1).write.json(path)
    defaults = {"default_status": "probable_success", "default_tags": ["imported", "auto"]}
    done = importing.import_path(spark, path, adapter=" LOCAL_JSON", **defaults)
    assert tuple(done.summary.first()) == (2, 0, 0)
    rows = sorted(done.created.collect(), key=lambda r: r["id"])
    assert [r["status"] for r in rows] == ["probable_success", "confirmed_success"]
    assert {r["efficacy_source"] for r in rows} == {"auto"}
    assert rows[0]["tags"] == ["auto", "imported", "kettle", "lime"]
    again = importing.import_path(spark, path, done.table, **defaults)
    assert tuple(again.summary.first()) == (0, 2, 0)
    assert again.created.count() == 0


def test_invalid_rows_never_claim_a_key(spark):
    good = make_requests(random.Random(1), 1)[0] | {"title": "T", "solution_text": "s", "status": "draft"}
    rows = [good | {"seq": 1, "status": "bogus"}, good | {"seq": 2}, good | {"seq": 3}]
    done = D.create_solutions(None, frame(spark, rows))
    assert outcomes(done.outcomes) == {1: ("invalid", None), 2: ("created", 1), 3: ("duplicate", 1)}


@pytest.fixture
def stored(spark):
    rows = [
        (1, "Alpha", "", "one", "draft", "auto", ["red"], "2024-01-01 00:00:01"),
        (2, "Beta", "alpha?", "two", "failed", "manual", ["blue", "red"], "2024-01-01 00:00:02"),
        (3, "Gamma", "", "100%", "draft", "auto", [], "2024-01-01 00:00:02"),
        (4, "Delta", "", "É", "draft", "auto", ["alphabet"], "2024-01-01 00:00:00"),
    ]
    names = "id bigint, title string, problem string, solution_text string, status string, efficacy_source string, tags array<string>, t string"
    df = spark.createDataFrame(rows, names).withColumn("updated_at", F.to_timestamp("t")).drop("t")
    return df


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(
    ("f", "expected"),
    [
        (Q.SolutionFilter(), [3, 2, 1, 4]),
        (Q.SolutionFilter(query=" ALPHA "), [2, 1, 4]),
        (Q.SolutionFilter(query="é"), []),
        (Q.SolutionFilter(query="0%"), [3]),
        (Q.SolutionFilter(status=" DRAFT"), [3, 1, 4]),
        (Q.SolutionFilter(efficacy_source="manual"), [2]),
        (Q.SolutionFilter(tag="RED "), [2, 1]),
        (Q.SolutionFilter(tag="re"), []),
        (Q.SolutionFilter(query="alpha", status="draft", tag="red"), [1]),
        (Q.SolutionFilter(limit=1, offset=1), [2]),
        (Q.SolutionFilter(offset=9), []),
    ],
)
def test_list_solutions(stored, f, expected):
    assert ids(Q.list_solutions(stored, f)) == expected
    page, totals = Q.page_with_total(stored, f)
    everything = Q.filter_solutions(stored, f).count()
    assert tuple(totals.first()) == (len(expected), everything)


def test_deep_pages_equal_the_others(stored, monkeypatch):
    filters = [Q.SolutionFilter(limit=2, offset=k) for k in (1, 2, 3, 4, 9)]
    expected = [ids(Q.list_solutions(stored, f)) for f in filters]
    monkeypatch.setattr(Q, "DEEP_OFFSET", 0)
    assert [ids(Q.list_solutions(stored, f)) for f in filters] == expected == [[2, 1], [1, 4], [4], [], []]


def test_relational_forms_agree(stored):
    rows = D.solution_tags(stored)
    for tag in ("red", "blue", "none"):
        assert sorted(ids(Q.filter_tag_relational(stored, rows, tag))) == sorted(ids(Q.filter_solutions(stored, Q.SolutionFilter(tag=tag))))
    assert sorted(ids(Q.search_or_exists(stored, rows, "alpha"))) == [1, 2, 4]
    csvs = {r["id"]: r["tags_csv"] for r in D.tags_group_concat(rows, stored).collect()}
    assert csvs == {1: "red", 2: "blue,red", 3: "", 4: "alphabet"}


def test_search_by_child_rows_moves_no_texts(spark):
    stored = spark.range(50).selectExpr("id", "'t' as title", "'p' as problem", "concat('s', id) as solution_text")
    rows = spark.createDataFrame([(7, "s1"), (8, "x")], "solution_id bigint, tag string")
    found = Q.search_or_exists(stored, rows, "S1").select("id", "title")
    assert sorted(ids(found)) == [1, 7, *range(10, 20)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    left = plan[: plan.index("Aggregate")]
    assert "LeftSemi" in left and "solution_text" not in left


@pytest.mark.parametrize(
    ("given", "bounds"),
    [
        ((-1, -1), (20, 0)),
        ((0, 0), (20, 0)),
        ((1, 5), (1, 5)),
        ((100, 0), (100, 0)),
        ((101, 0), (20, 0)),
        (("x", "y"), (20, 0)),
        (("7", None), (7, 0)),
    ],
)
def test_page_bounds(given, bounds):
    assert Q.page_bounds(*given) == bounds


def test_pager(spark):
    total = spark.createDataFrame([(81,)], "total bigint")
    assert tuple(Q.pager_info(total, 9).first()) == (81, 3, 3, 80)
    assert tuple(Q.pager_info(total.withColumn("total", F.lit(0)), 2).first()) == (0, 1, 1, 0)


def test_delete(spark, stored):
    asked = spark.createDataFrame([(1, 2), (2, 2), (3, 77), (4, 4)], "seq bigint, id bigint")
    done = D.delete_solutions(stored, asked)
    assert {s: o for s, (o, _) in outcomes(done.outcomes).items()} == {1: "deleted", 2: "not_found", 3: "not_found", 4: "deleted"}
    assert sorted(ids(done.table)) == [1, 3]


def test_replace_tags_and_lookups(spark, stored):
    changes = spark.createDataFrame([(1, ["Z", "a"]), (9, ["x"])], "id bigint, tags array<string>")
    got = {r["id"]: r["tags"] for r in D.replace_tags(stored, changes).collect()}
    assert got == {1: ["a", "z"], 2: ["blue", "red"], 3: [], 4: ["alphabet"]}
    asked = spark.createDataFrame([(2,), (2,), (9,)], "id bigint")
    assert ids(D.lookup_by_id(stored, asked)) == [2]


def test_schema_upgrade(spark):
    old = spark.createDataFrame([(1,)], "id int")
    new = S.with_default_column(S.with_default_column(old, "raw_content"), "raw_content")
    assert [tuple(r) for r in new.collect()] == [(1, "")]
