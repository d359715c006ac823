from __future__ import annotations

import hashlib
import math
import random

import pytest

from tallywright.llm import centroids

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, dims, k=8, rounds=10):
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in order[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), number) for number, c in enumerate(means))

    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for c in range(len(means)):
            own = [v for (_, v), at in zip(kept, found) if at == c]
            if own:
                means[c] = [sum(column) // len(own) for column in zip(*own)]
    last = [(i, *near(v)) for i, v in kept]
    inertias = [sum(far for _, far, at in last if at == c) for c in range(len(means))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means]
    return sorted(repr((i, at, far, inertias[at], sum(inertias), digests[at])) for i, far, at in last)


def found(spark, rows, dims, **more):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(repr(tuple(row)) for row in centroids.described(spark, centroids.cluster(frame, dims=dims, **more)).collect())


def near_some(seed, n, dims):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = near_some(seed, 300, 5)
    assert found(spark, rows, 5) == brute(rows, 5)


def test_odd_rows(spark):
    """NULLs, wrong lengths, infinities, ids missing or repeated, a third of the rows one vector."""
    rows = near_some(3, 60, 3)
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, math.nan, 2.0])]
    rows += [(105, [math.inf, 0.0, 0.0]), (None, [0.5, -0.5, 0.25]), (None, None), (7, [9.0, -9.0, 1e-9]), (7, [9.0, -9.0, 1e-9])]
    rows += [(200 + i, [0.125, -0.125, 3.0]) for i in range(30)]
    assert found(spark, rows, 3) == brute(rows, 3)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]  # two different vectors, eight centroids
    assert found(spark, rows, 2) == brute(rows, 2)


def test_few_and_none(spark):
    assert found(spark, [], 4) == []
    assert found(spark, [(1, [1.0, None])], 2) == []
    rows = [(1, [1.0, 2.0]), (2, [0.0, 0.0])]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_layout_does_not_matter(spark, monkeypatch):
    rows = near_some(5, 200, 4)
    expected = brute(rows, 4)
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for parts in (1, 7):
        made = centroids.cluster(frame.repartition(parts), dims=4)
        assert sorted(repr(tuple(r)) for r in centroids.described(spark, made).collect()) == expected


def test_large_numbers_are_exact_or_refused(spark):
    edge = centroids.largest_value(2) / 1024
    rows = [(1, [edge, -edge]), (2, [-edge, edge]), (3, [0.0, edge])]
    assert found(spark, rows, 2, k=1) == brute(rows, 2, k=1)
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(1, [edge * 4, 0.0])], 2)


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, [1.0], 2, 3), (2, [4.0], 0, 0)], "vec_id bigint, embedding array<double>, cluster int, ids int")
    assert centroids.described(spark, centroids.cluster(frame, dims=1)).count() == 2
