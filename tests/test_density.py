"""Density clustering against brute force over all pairs."""

import random

import pytest

from tessera.operators.density import components, density_clusters, links, pick_pivots


def near(x, y, eps):
    return sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 <= eps


def brute(rows, eps, least, small):
    rows = [(i, v) for i, v in rows if i is not None and v is not None]
    beside = {i: [j for j, w in rows if near(v, w, eps)] for i, v in rows}
    core = {i for i in beside if len(beside[i]) >= least}
    root = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            low = min(root[j] for j in beside[i] if j in core)
            if low < root[i]:
                root[i], changed = low, True
    cluster = {i: root[i] if i in core else min((root[j] for j in beside[i] if j in core), default=None) for i in beside}
    size = {c: list(cluster.values()).count(c) for c in cluster.values() if c is not None}
    return sorted((i, len(beside[i]), i in core, cluster[i], size.get(cluster[i], 0), cluster[i] is None or size[cluster[i]] < small) for i in beside)


def groups(seed, n, dim=3):
    r = random.Random(seed)
    centres = [[r.uniform(-4, 4) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.35) for c in r.choice(centres)]) for i in range(n)]
    return rows + [(1000 + i, list(rows[i][1])) for i in range(0, n, 7)] + [(2000, [50.0] * dim), (None, [0.0] * dim), (2001, None)]


@pytest.mark.parametrize("eps, least", [(0.4, 2), (0.4, 4), (0.9, 6), (0.01, 2), (30.0, 3)])
def test_against_all_pairs(spark, eps, least):
    rows = groups(3, 150)
    got = density_clusters(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", eps, least, 5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, eps, least, 5)


def test_blocks_of_a_hot_cell_report_each_link_once(spark):
    rows = [(i, v) for i, v in groups(8, 200) if i is not None and v is not None and i < 1000]
    for eps in (0.3, 1.0, 40.0):
        got = sorted(tuple(sorted(r)) for r in links(spark.createDataFrame(rows, "vid long, v array<double>"), eps, block=16).collect())
        assert got == sorted((i, j) for i, v in rows for j, w in rows if i < j and near(v, w, eps))


def test_distance_of_exactly_eps_counts(spark):
    rows = [(i, [0.25 * i, 0.0]) for i in range(40)]
    got = {tuple(sorted(r)) for r in links(spark.createDataFrame(rows, "vid long, v array<double>"), 0.5).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, min(40, i + 3))}


def test_long_chains_and_stars_are_one_component(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(201, 200), (201, 202), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200, 202: 200}


def test_no_rows_one_row_and_equal_rows(spark):
    schema = "id long, v array<float>"
    assert density_clusters(spark.createDataFrame([], schema), "id", "v").collect() == []
    assert [tuple(r) for r in density_clusters(spark.createDataFrame([(4, [1.0])], schema), "id", "v").collect()] == [(4, 1, False, None, 0, True)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], schema)
    assert sorted(tuple(r) for r in density_clusters(same, "id", "v").collect()) == [(i, 6, True, 0, 6, False) for i in range(6)]
    assert len(pick_pivots(same.selectExpr("id as vid", "cast(v as array<double>) v"))) == 1
