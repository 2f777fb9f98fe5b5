"""Density clustering sends on fewer links than there are vectors, not one a pair."""

from __future__ import annotations

import random

import numpy as np

from tessera.operators import density as D


def test_links_of_a_dense_group_are_not_listed(spark, monkeypatch):
    r, kept = random.Random(5), []
    rows = [(i, [r.gauss(0, 0.05), r.gauss(0, 0.05)]) for i in range(300)] + [(900, [0.9, 0.0]), (901, [9.0, 9.0])]
    write = D.materialise
    monkeypatch.setattr(D, "materialise", lambda df, name, **k: kept.append((name, out := write(df, name, **k))) or out)
    got = {x.id: tuple(x) for x in D.density_clusters(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.8, 5, 5).collect()}
    # there are 44850 links and more; each pair of adjacent cells keeps fewer than it has vectors, in both directions
    assert max(df.count() for name, df in kept if name in ("near", "links")) < 10 * len(rows)
    v = np.array([x[1] for x in rows])
    near = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= 0.8
    assert [got[i][1] for i, _ in rows] == near.sum(1).tolist()
    assert got[0][3:5] == (0, sum(got[i][3] == 0 for i, _ in rows)) and got[901][3] is None


def test_joins_keep_components_and_the_links_of_other_vectors():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(60, 2)), r.normal(size=(50, 2))
    ids, core = np.arange(110), (r.random(110) < 0.7).astype(np.int64)
    near = lambda eps: D._near(x, y, False, eps)
    D_CELLS, D.CELLS = D.CELLS, 200  # several tiles
    try:
        look = D._joins(0.4)
        pa = __import__("pyarrow")
        cells = [ids[:60].tobytes(), core[:60].tobytes(), x.tobytes(), ids[60:].tobytes(), core[60:].tobytes(), y.tobytes()]
        batch = pa.RecordBatch.from_arrays([*[pa.array([c], pa.binary()) for c in cells], pa.array([False])], names=list("abcdefg"))
        out = [row for b in look([batch]) for row in b.to_pylist()]
        pairs = [(int(a), int(b) + 60) for i, j in near(0.4) for a, b in zip(i, j)]
    finally:
        D.CELLS = D_CELLS

    def parts(edges):
        root = list(range(110))
        for a, b in edges * 110:
            root[a] = root[b] = min(root[a], root[b])
        return root
    assert parts([(o["a"], o["b"]) for o in out if o["inner"]]) == parts([p for p in pairs if core[p[0]] and core[p[1]]])
    assert sorted((o["a"], o["b"]) for o in out if not o["inner"]) == sorted((a, b) if not core[a] else (b, a) for a, b in pairs if core[a] != core[b])
