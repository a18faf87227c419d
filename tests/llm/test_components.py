from __future__ import annotations

import random

import pytest

from lorekeep.llm import components as subject


def expected(edges: list[tuple]) -> list[tuple]:
    """The smallest node of each component, by repeated lowering."""
    least = {x: x for a, b in edges if a != b for x in (a, b)}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return sorted(least.items())


def found(edges, **options) -> list[tuple]:
    return sorted((r["node"], r["root"]) for r in subject.components(edges, **options).collect())


@pytest.mark.parametrize("held", [1, 7, 1 << 18])
def test_components_of_any_edges(spark, held):
    rng = random.Random(held)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(170)]
    edges += [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000), (1000, 2000), (2000, 1000), (1 << 62, -(1 << 63))]
    rng.shuffle(edges)
    rows = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    assert found(rows, held=held) == expected(edges)
    assert found(rows.limit(0), held=held) == []


def test_a_dense_group_enters_the_rounds_with_few_edges(spark, monkeypatch):
    """All pairs of 80 nodes, twice: each task hands on a tree of them."""
    edges = [(a, b) for a in range(80) for b in range(80)]
    staged, real = [], subject.stage
    monkeypatch.setattr(subject, "stage", lambda df, label: staged.append(real(df, label)) or staged[-1])
    assert found(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)) == [(k, 0) for k in range(80)]
    assert staged[0].count() < 3 * 80
