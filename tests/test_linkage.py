import itertools
import math
import random

import pytest

from tidemark.operators.linkage import single_linkage


def brute(points, p):
    """The merges of single linkage: all pairs in rising order that join two groups."""
    dist = lambda a, b: sum(abs(x - y) ** p for x, y in zip(a, b)) ** (1 / p)
    pairs = sorted((dist(points[a], points[b]), a, b) for a, b in itertools.combinations(sorted(points), 2))
    group, merges = {i: i for i in points}, []
    for d, a, b in pairs:
        if group[a] != group[b]:
            merges.append((a, b, d))
            old, new = group[b], group[a]
            group = {i: new if g == old else g for i, g in group.items()}
    return merges


def cut(points, merges, k):
    group = {i: i for i in points}
    for a, b, _ in merges[: len(points) - k]:
        old, new = group[b], group[a]
        group = {i: new if g == old else g for i, g in group.items()}
    first = sorted({min(i for i in points if group[i] == g) for g in set(group.values())})
    return {i: first.index(min(j for j in points if group[j] == group[i])) for i in points}


@pytest.mark.parametrize("p, neighbours", [(2, 3), (1, 5), (2, 200)])
def test_single_linkage_by_brute_force(spark, p, neighbours):
    """Far blobs whose neighbours all lie inside them, a chain, ties on a grid, and equal points."""
    rng = random.Random(neighbours)
    spots = [(rng.gauss(cx, 0.5), rng.gauss(cy, 0.5)) for cx, cy in ((0, 0), (30, 5), (-20, 40)) for _ in range(25)]
    spots += [(50 + i * 1.1, -10.0) for i in range(12)] + [(float(x), 60.0 + y) for x in range(3) for y in range(3)] + [(7.0, 7.0)] * 6
    points = {i * 3: xy for i, xy in enumerate(spots)}
    df = spark.createDataFrame([(i, *xy) for i, xy in points.items()], "id int, x double, y double")
    merges = brute(points, p)
    tree = single_linkage(df, "id", ["x", "y"], neighbours, p, block_rows=32)
    got = sorted((r["distance"], r["a"], r["b"]) for r in tree.edges.collect())
    assert [(a, b) for _, a, b in got] == [(a, b) for a, b, _ in sorted(merges, key=lambda m: (m[2], m[0], m[1]))]
    assert all(math.isclose(g[0], m[2]) for g, m in zip(got, merges))
    for k in (1, 4, 11, 500):
        assert {r["id"]: r["cluster"] for r in tree.clusters(k).collect()} == cut(points, merges, min(k, len(points)))
    within = {r["id"]: r["cluster"] for r in tree.clusters_within(2.0).collect()}
    assert within == cut(points, merges, len(points) - sum(d <= 2.0 for _, _, d in merges))


def test_small_tables(spark):
    schema = "id long, x double"
    assert single_linkage(spark.createDataFrame([], schema), "id", ["x"]).clusters(3).count() == 0
    one = single_linkage(spark.createDataFrame([(5, 1.0)], schema), "id", ["x"])
    assert [tuple(r) for r in one.clusters(3).collect()] == [(5, 0)]
