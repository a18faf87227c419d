from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators.events import _blocked, at_micros, chord_held, double_chord, double_trigger, incomplete_events
from lorekeep.operators.recent_ring import case_tree, follow, recent_ring, run_ring
from lorekeep.streaming.events import DoubleTriggerStream, RecentRingStream, follow_presses
from tests import model


def make_events(rng, n):
    rows = []
    for event_id in range(n):
        user = 1 if rng.random() < 0.5 else rng.randint(2, 5)
        kind = rng.choice([("ctrl", "down"), ("ctrl", "up"), ("c", "down"), ("c", "down"), ("c", "up")])
        rows.append((user, rng.randint(-40, 400), event_id, *kind))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, at_us bigint, event_id bigint, key string, action string")


def fired(df):
    return sorted((r["user_id"], r["event_id"]) for r in df.collect())


def by_user(rows):
    users = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        users.setdefault(r[0], []).append(r[1:])
    return users


@pytest.mark.parametrize(("seed", "bits"), [(1, 2), (2, 0), (3, 17)])
def test_blocks_do_not_change_the_rules(spark, seed, bits):
    rows = make_events(random.Random(seed), 200)
    df = frame(spark, rows)
    users = by_user(rows)
    for gap in (3, 60):
        expected = sorted((u, e) for u, evs in users.items() for e in model.double_trigger([(a, i) for a, i, *_ in evs], gap))
        assert fired(double_trigger(df, gap, bits)) == expected
    held = {u: model.held_presses(evs) for u, evs in users.items()}
    assert fired(chord_held(df, bits)) == sorted((u, e) for u, evs in held.items() for _, e in evs)
    expected = sorted((u, e) for u, evs in held.items() for e in model.double_trigger(evs, 5))
    assert fired(double_chord(df, 5, bits)) == expected


def test_one_user_and_instant_with_most_events_is_cut(spark):
    rows = [(1, 7, i % 900, "c", "down") for i in range(1000)] + [(2, 7, 0, "c", "down"), (2, 9, 1, "c", "down")]
    df = frame(spark, rows).unionByName(frame(spark, [(None, 1, 1, "c", "down"), (1, None, 2, "c", "down")]))
    assert _blocked(df, 5).groupBy("user_id", "_block").count().agg(F.max("count")).first()[0] <= 32
    for bits in (5, 17):
        assert sorted(double_trigger(df, 3, bits).groupBy("user_id").count().collect()) == [(1, 500), (2, 1)]
    assert sorted(r["event_id"] for r in incomplete_events(df).collect()) == [1, 2]


@pytest.mark.parametrize(
    ("times", "gap", "count"),
    [([0, 1, 2], 10, 1), ([0, 1, 2, 3], 10, 2), ([0, 10], 10, 1), ([0, 11], 10, 0)],
)
def test_double_press(spark, times, gap, count):
    rows = [(1, t, i, "c", "down") for i, t in enumerate(times)]
    assert double_trigger(frame(spark, rows), gap).count() == count


def test_at_micros(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.000123' as t")
    assert df.select(at_micros(F.col("t"))).first()[0] == 1710037800000123


def ring_rows(spark, rows):
    return spark.createDataFrame(rows, "key string, seq bigint, hash string")


def test_ring_by_hand(spark):
    rows = [("k", i, h) for i, h in enumerate("abacdaeb")]
    for bits in (0, 1, 20):
        done = recent_ring(ring_rows(spark, rows), bits)
        flags = [r["accepted"] for r in sorted(done.rows.collect(), key=lambda r: r["seq"])]
        assert flags == [True, True, False, True, True, True, True, True]
        assert done.rings.first()["ring"] == ["b", "e", "a"]


@pytest.mark.parametrize("letters", ["abcd", "abcdefgh"])
def test_ring_in_blocks_equals_one_pass(spark, letters):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("xy"), s, rng.choice(letters)) for s in rng.sample(range(10**6), 150)]
    got = {r["seq"]: r["accepted"] for r in recent_ring(ring_rows(spark, rows), 3).rows.collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == key)
        expected |= dict(zip([s for s, _ in mine], model.ring([h for _, h in mine]), strict=True))
    assert got == expected


def test_case_tree_equals_one_pass():
    rng = random.Random(8)
    for _ in range(400):
        items = [rng.choice(["a", "b", "c", "d", "e", None]) for _ in range(rng.randint(0, 9))]
        ring = rng.sample(["a", "b", "c", "d", "x", "y", None], rng.randint(0, 3))
        assert follow(case_tree(items), ring) == run_ring(ring, items)[1]


def test_ring_jobs_do_not_grow_with_a_key(spark):
    def jobs(n):
        group = f"ring-{n}"
        spark.sparkContext.setJobGroup(group, "")
        rows = [("k", i, "z" if i == 0 else "a") for i in range(n)]
        got = recent_ring(ring_rows(spark, rows), 2).rows.where("accepted").count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == 2
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(16) == jobs(256)


def test_ring_null_keys_and_hashes(spark):
    rows = [(None, 1, "a"), (None, 2, None), (None, 3, "a"), ("", 4, "a"), (None, 5, None), ("", 6, None)]
    for bits in (0, 1, 20):
        done = recent_ring(ring_rows(spark, rows), bits)
        got = {r["seq"]: r["accepted"] for r in done.rows.collect()}
        assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}
        assert {r["key"]: r["ring"] for r in done.rings.collect()} == {None: [None, "a"], "": [None, "a"]}
    assert recent_ring(ring_rows(spark, [])).rows.count() == 0


def cut(rows, parts):
    size = len(rows) // parts + 1
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def feed(folder, loads, run):
    """Runs ``run`` on the stream of a folder after each load."""
    for rows in loads:
        rows.write.mode("append").parquet(f"{folder}/in")
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in"))


def test_presses_of_a_user_across_batches():
    rng = random.Random(11)
    for _ in range(300):
        at = sorted(rng.randint(0, 60) for _ in range(rng.randint(1, 30)))
        cuts = sorted(rng.randint(0, len(at)) for _ in range(2))
        last, waiting, got = None, False, []
        for a, b in zip([0, *cuts], [*cuts, len(at)]):
            late, fires, last, waiting = follow_presses(np.array(at[a:b], np.int64), last, waiting, 3)
            assert not late.any()
            got += [a + k for k in np.flatnonzero(fires)]
        assert got == model.double_trigger([(x, k) for k, x in enumerate(at)], 3)


def test_streamed_presses_equal_the_batch_rule(spark, folder):
    rows = sorted(make_events(random.Random(6), 120), key=lambda r: (r[1], r[2]))
    hot = [(9, 1000 + 3 * i, 1000 + i, "c", "down") for i in range(400)]
    rows += hot
    stream = DoubleTriggerStream(f"{folder}/press", gap=4)
    run = lambda df: stream.start(df).awaitTermination()
    feed(folder, [frame(spark, part) for part in cut(rows, 2)], run)
    assert fired(stream.firings(spark)) == fired(double_trigger(frame(spark, rows), 4))

    late = [(9, -1000, 10_000, "c", "down"), (9, -999, 10_001, "c", "down")]
    nowhere = [(None, 5, 10_002, "c", "down"), (9, None, 10_003, "c", "down")]
    nameless = [(77, 1, None, "c", "down"), (77, 2, None, "c", "down")]
    feed(folder, [frame(spark, late + nowhere + nameless)], run)
    refused = {r["event_id"]: r["reason"] for r in stream.refused(spark).collect()}
    assert refused == {10_000: "late", 10_001: "late", 10_002: "incomplete", 10_003: "incomplete"}
    extra = stream.firings(spark).where("event_id is null").collect()
    assert [(r["user_id"], r["at_us"]) for r in extra] == [(77, 2)]
    rest = stream.firings(spark).where("event_id is not null")
    assert fired(rest) == fired(double_trigger(frame(spark, rows), 4))


def test_streamed_ring_equals_the_batch_rule(spark, folder):
    bits, rng = 2, random.Random(7)
    hashes = [(rng.choice(["x", "y", None]), s, rng.choice(["a", "b", "c", "d", "e", None])) for s in range(90)]
    hashes += [("hot", s, rng.choice("abcdef")) for s in range(90, 250)]
    ring = RecentRingStream(f"{folder}/ring", block_bits=bits)
    feed(folder, [ring_rows(spark, part) for part in cut(hashes, 2)], ring.run)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(ring.decisions(spark)) == order(recent_ring(ring_rows(spark, hashes)).rows)
    trees = spark.read.parquet(f"{folder}/ring/cases")
    assert trees.where("key = 'hot'").count() >= 160 >> bits  # a hot key's task sees blocks only
