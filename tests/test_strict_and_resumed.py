"""Values with text beside them, and analysis runs that go on where an earlier one broke down."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from lorekeep import schemas as S
from lorekeep.operators.captures import insert_captures
from lorekeep.plans import enrich
from lorekeep.sources import candidates as src

TEXT_BESIDE = ['{"title":"a"}],[{"title":"b"}', '{"title":"c"}] junk', '{"title":"d"},"x"]', '{"title":"e"} ,', "", "]["]


@pytest.mark.parametrize("line", [x for x in TEXT_BESIDE if x])
def test_a_line_that_closes_the_array_early_fails(spark, folder, line):
    (Path(folder) / "x.jsonl").write_text('{"title":"ok"}\n' + line + "\n")
    with pytest.raises(Exception):
        src.read_json_lines(spark, folder).collect()


def test_an_answer_with_text_beside_it_is_bad(spark):
    reply = lambda text: json.dumps({"output": [{"content": [{"type": "output_text", "text": text}]}]})
    good = json.dumps({"title": "t] [", "tags": ['"', "],["]})
    rows = [(0, reply(good)), *[(k, reply(x)) for k, x in enumerate(TEXT_BESIDE, 1) if x], (9, reply(good) + "]"), (10, None)]
    got = enrich.parse_responses(spark.createDataFrame(rows, "id bigint, body string"))
    status = {r["id"]: (r["parse_error"], r["title"]) for r in got.collect()}
    assert status.pop(0) == (None, "t] [")
    assert status.pop(9)[0] == status.pop(10)[0] == "bad_envelope"
    assert {s for s, _ in status.values()} == {"bad_json"}


@pytest.fixture
def stored(spark):
    rows = [(k, f"text {k}") for k in range(40)]
    return insert_captures(None, spark.createDataFrame(rows, "seq bigint, content string"), "2024-01-01").table


def test_a_broken_run_goes_on_without_asking_twice(spark, folder, stored):
    """The extractor breaks down at one capture; the next run asks for it and for the rows never asked."""
    log = Path(folder) / "calls"
    log.mkdir()

    def extractor(breaks_at):
        def run(batches):
            for batch in batches:
                for row in batch.to_dict("records"):
                    if row["id"] == breaks_at:
                        raise RuntimeError("out of service")
                    with open(log / str(row["id"]), "a") as f:
                        f.write("x")
                    yield next(enrich.calls(enrich.rule_answer)(iter([batch[batch["id"] == row["id"]]])))

        return run

    none = spark.createDataFrame([], S.INSIGHT)
    run = lambda fn: enrich.analyze_captures(stored, none, fn, keep_at=f"{folder}/run-1", slices=3, as_of="2024-01-01")
    with pytest.raises(RuntimeError, match="out of service"):
        run(extractor(17))
    first = {p.name for p in log.iterdir()}
    assert 0 < len(first) < 40
    with pytest.raises(RuntimeError, match="out of service"):
        run(extractor(max({*range(1, 41)} - {int(name) for name in first})))
    table, report = run(extractor(None))
    assert table.count() == 40 and {r["status"] for r in report.collect()} == {"ok"} and report.count() == 40
    assert sorted(p.name for p in log.iterdir()) == sorted(str(k) for k in range(1, 41))
    assert all(p.read_text() == "x" for p in log.iterdir())
    # the same insights as from one run
    whole, _ = enrich.analyze_captures(stored, none, as_of="2024-01-01")
    fields = [c for c in S.INSIGHT.names]
    assert sorted(map(str, table.select(fields).collect())) == sorted(map(str, whole.select(fields).collect()))


def test_failed_calls_are_asked_again_and_only_the_last_failure_is_told(spark, folder, stored):
    def answer(fails):
        def one(row):
            if row["id"] % 4 == 0 and fails:
                raise TimeoutError("slow")
            return enrich.rule_answer(row)

        return enrich.calls(one)

    none = spark.createDataFrame([], S.INSIGHT)
    run = lambda fails: enrich.analyze_captures(stored, none, answer(fails), keep_at=f"{folder}/run-2", slices=2)
    for _ in range(2):
        table, report = run(True)
        assert table.count() == 30 and report.where("status = 'timeout'").count() == 10 and report.count() == 40
    table, report = run(False)
    assert table.count() == 40 and report.where("status = 'ok'").count() == 40
    empty, report = enrich.analyze_captures(stored.limit(0), none, answer(False), keep_at=f"{folder}/run-3")
    assert empty.count() == report.count() == 0
