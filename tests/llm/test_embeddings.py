from __future__ import annotations

import math

import numpy as np
import pytest

from lorekeep.llm import embeddings
from lorekeep.llm.covertree import CoverTree, near_pairs
from lorekeep.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def order(row):
    return tuple((v is None, v) for v in row)


def sound(v) -> bool:
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def expected(rows: list[tuple], cosine: float) -> list[tuple]:
    links = [[] for _ in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if sound(v) else None for _, v, _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            other = rows[j]
            if label is not None and label == other[2] and unit[i] is not None and unit[j] is not None:
                if len(v) == len(other[1]) and unit[i] @ unit[j] >= cosine:
                    links[i].append(j)
                    links[j].append(i)
    found = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        component = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        found.append((row[0], len(links[i]), component, row[0] == component))
    return sorted(found, key=order)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, QUERIES["op10_cover_tree"](spark, SF).collect()), key=order)
    assert got == expected(rows, 0.93)


@pytest.mark.parametrize("block", [4096, 7])
def test_edge_rows_and_dealt_labels(spark, block):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=6)
    rows = [(k, (centre + rng.normal(size=6) * 0.3).tolist(), 1) for k in range(40)]
    rows += [(100 + k, [1.0, 2.0, 3.0], 2) for k in range(5)] + [(200, [2.0, 4.0, 6.0], 2), (201, [1.0, 2.0, 3.0], None)]
    rows += [
        (300, None, 1), (301, [], 1), (302, [0.0] * 6, 1), (303, [1.0, None] + [0.0] * 4, 1), (304, [math.nan] * 6, 1),
        (305, [math.inf] + [0.0] * 5, 1), (306, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, [9.0, 1.0, 0.0], 3),
        (307, [1e-30, 0.0, 0.0], 4), (308, [1e30, 0.0, 0.0], 4), (309, [-1.0, 0.0, 0.0], 4), (309, [-1.0, 0.0, 0.0], 4),
    ]
    df = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, node int, key string"
    )
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = sorted(map(tuple, embeddings.near_duplicates(df, block=block).collect()), key=order)
    assert got == expected(rows, 0.93)
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_traversal_finds_each_pair_once():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(60, 8)), rng.normal(size=8) + rng.normal(size=(90, 8)) * 0.1])
    points = np.concatenate([points, points[:20]])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    one, two = CoverTree(points[:80]), CoverTree(points[80:])
    for reach in (0.0, 0.2, 0.374, 1.0):
        got = [(i, j) for a, b in near_pairs(one, two, reach) for i, j in zip(a.tolist(), b.tolist())]
        apart = np.sqrt(np.maximum(0, 2 - 2 * points[:80] @ points[80:].T))
        assert len(got) == len(set(got))
        assert set(zip(*(x.tolist() for x in np.nonzero(apart <= reach)))) <= set(got)
