"""Plan shape: what must not move, run in Python, or be read."""

from __future__ import annotations

import contextlib
import io

import pytest

from lorekeep.operators import captures as C, search as Q, solutions as D
from lorekeep.plans.importing import import_candidates
from workload import inputs as I
from workload.base import captures, insights, solutions

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark):
    return solutions(spark, SF)


def test_page_is_a_top_k_without_shuffle(stored):
    matches = Q.filter_solutions(stored, Q.SolutionFilter(query="e", status="draft"))
    text = plan(Q.newest_first(matches.select("id", "updated_at"), "updated_at", 10, 5))
    assert "TakeOrderedAndProject(limit=15, offset=5" in text
    assert "Exchange" not in text and "Python" not in text
    assert "EqualTo(status,draft)" in text
    assert "raw_content" not in text


def test_page_rows_are_read_by_id(spark, stored):
    text = plan(Q.list_solutions(stored, Q.SolutionFilter(limit=5)))
    assert "PushedFilters: [In(id, [" in text and "Exchange" not in text
    text = plan(C.list_captures(captures(spark, SF), insights(spark, SF), Q.CaptureFilter(limit=5)))
    assert "In(id, [" in text and "In(capture_id, [" in text


def test_count_reads_only_the_searched_columns(stored):
    text = plan(Q.count_solutions(stored, Q.SolutionFilter(query="e")))
    assert "ReadSchema: struct<title:string,problem:string,solution_text:string,tags:array<string>>" in text


def test_unanalyzed_is_an_anti_join(spark):
    text = plan(C.unanalyzed(captures(spark, SF), insights(spark, SF)))
    assert "LeftAnti" in text


def test_writes_stay_in_the_jvm(spark, stored):
    done = import_candidates(I.view(spark, SF, I.MORE_CANDIDATES), stored)
    for df in (done.table, done.outcomes, done.summary):
        text = plan(df)
        assert "Python" not in text and "Pandas" not in text
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in plan(C.insert_captures(None, I.view(spark, SF, I.CAPTURES)).outcomes)


def test_outcomes_read_no_payload(spark, stored):
    done = import_candidates(I.view(spark, SF, I.MORE_CANDIDATES), stored)
    for text in (plan(done.outcomes), plan(done.summary)):
        assert "solution_text" not in text and "documents" not in text


def test_a_small_update_does_not_shuffle_the_stored_table(spark, stored):
    text = plan(D.update_solutions(stored, I.view(spark, SF, I.UPDATES)).table)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_capture_search_shuffles_narrow_rows(spark):
    text = plan(C.matching_captures(captures(spark, SF), insights(spark, SF), Q.CaptureFilter(query="e")))
    assert "CartesianProduct" not in text and "Python" not in text
    for line in text.splitlines():
        if "HashAggregate" in line:
            assert "content" not in line and "summary" not in line
