"""Exact density clustering of vectors (A8): candidates for new issue types.

Vectors within ``eps`` of each other (Euclidean) are neighbours; a vector with ``min_samples`` and
more of them, itself included, is a core; clusters are the connected cores with the vectors next to
them; what is in no cluster is noise. Noise and small clusters are candidates for new types.

1. Equal vectors become one row with the number of its copies.
2. Distances to a few pivots are cut into bands of width ``eps``. Neighbours differ by at most one
   band at every pivot (triangle inequality), so cells of equal bands meet only adjacent cells.
3. A cell is dealt into blocks, however hot it is. Pairs of blocks of adjacent cells are joined by block
   number and compared in the task by matrix products. Distances near ``eps`` are computed again term by term.
   Links are never listed, their number grows with the square of the input: a first round sends on each vector's
   number of neighbours in the other block, a second, which knows the cores, links that join the same cores (fewer
   than the vectors of both blocks) and the links of other vectors to cores (fewer than ``min_samples`` a vector).
4. Components of linked cores by rounds of smallest labels with pointer jumping; every round is a
   written table, so a lost executor costs one round.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import materialise

#: Vectors of a block: a share of all (one of ``DEAL``), at least and at most so many. Products are made for ``CELLS`` pairs at once.
BLOCK, MOST, DEAL, CELLS = 1024, 16384, 32, 2_000_000
PIVOTS = 3


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vid, v, copies): one row per different vector, named by its smallest id; null vectors have no row."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null and id is not null")
    return v.groupBy("v").agg(F.min("id").alias("vid"), F.count(F.lit(1)).alias("copies")).select("vid", "v", "copies")


def pick_pivots(points: DataFrame, n: int = PIVOTS) -> list[list[float]]:
    """The vector of the smallest id, then the one farthest from all picked so far (``n`` rows reach the driver)."""
    first = points.agg(F.min_by("v", "vid").alias("v")).first()
    picked = [first.v] if first.v is not None else []
    while picked and len(picked) < n:
        nearest = F.least(*d) if len(d := [distance(F.col("v"), F.array(*map(F.lit, p))) for p in picked]) > 1 else d[0]
        best = points.select(nearest.alias("d"), "vid", "v").agg(F.max_by("v", F.struct("d", (-F.col("vid")).alias("i"))).alias("v"), F.max("d").alias("d")).first()
        if not best.d > 0:
            break
        picked.append(best.v)
    return picked


def cells(points: DataFrame, pivots: list[list[float]], eps: float) -> DataFrame:
    """Points with ``cell``, the bands of their distances to the pivots."""
    band = [F.floor(distance(F.col("v"), F.array(*map(F.lit, p))) / F.lit(eps * (1 + 1e-9))).cast("int") for p in pivots]
    return points.withColumn("cell", F.array(*band))


def _pack(batches) -> Iterator[pa.RecordBatch]:
    """One row per block: its ids, marks and vectors as bytes. Rows come sorted by (cell, block)."""
    held: list = []
    key = None

    def row():
        ids, marks = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
        m = np.array([h[2] for h in held], np.float64)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.list_(pa.int32())), pa.array([key[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, marks, m)]],
                                          names=["cell", "block", "ids", "marks", "m"])
    for b in batches:
        for cell, block, vid, mark, v in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and (cell, block) != key:
                yield row()
                held = []
            key = (cell, block)
            held.append((vid, mark, v))
    if held:
        yield row()


def _near(x: np.ndarray, y: np.ndarray, same: bool, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the vectors of two blocks within ``eps``, some rows at a time; in one block i < j."""
    yy = (y * y).sum(1)
    step = max(1, CELLS // max(len(y), 1))
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        square = (part * part).sum(1)[:, None] + yy[None, :] - 2 * (part @ y.T)
        slack = 1e-9 * (1 + float(square.max(initial=0)) + eps * eps)
        i, j = np.nonzero(square <= eps * eps + slack)
        if same:
            ahead = i + lo < j
            i, j = i[ahead], j[ahead]
        doubt = np.flatnonzero(square[i, j] > eps * eps - slack)
        good = np.ones(len(i), bool)
        for k in range(0, len(doubt), 65536):
            d = doubt[k:k + 65536]
            good[d] = np.sqrt(((part[i[d]] - y[j[d]]) ** 2).sum(1)) <= eps
        yield i[good] + lo, j[good]


def _of_pairs(columns: list[str], look):
    """A function of Arrow batches: ``look`` makes a pair of blocks (ids and marks of either, near places, same) to ``columns``."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *cells, same in zip(*[c.to_pylist() for c in b.columns], strict=True):
                (ia, ka, ib, kb), (x, y) = ([np.frombuffer(cells[k], np.int64) for k in (0, 1, 3, 4)], [np.frombuffer(cells[k]) for k in (2, 5)])
                found = lambda eps: _near(x.reshape(len(ia), -1), y.reshape(len(ib), -1), same, eps)  # noqa: B023, E731
                for out in look(ia, ka, ib, kb, found, same):
                    yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=columns)
    return run


def _links(eps: float):
    def look(ia, ka, ib, kb, near, same):
        for i, j in near(eps):
            yield ia[i], ib[j]
    return _of_pairs(["a", "b"], look)


def _counts(eps: float):
    """(vid, n): the summed marks of a vector's neighbours in the other block."""
    def look(ia, ka, ib, kb, near, same):
        na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        for i, j in near(eps):
            np.add.at(na, i, kb[j])
            np.add.at(nb, j, ka[i])
        for ids, n in ((ia, na), (ib, nb)):
            yield ids[n > 0], n[n > 0]
    return _of_pairs(["vid", "n"], look)


def _joins(eps: float):
    """(a, b, inner): links that join the same cores as all links of two blocks do, fewer than there are vectors, and the links of
    other vectors (a) to cores (b)."""
    def look(ia, ka, ib, kb, near, same):
        ids, core = (ia, ka) if same else (np.concatenate([ia, ib]), np.concatenate([ka, kb]))
        label = np.arange(len(ids))
        for i, j in near(eps):
            j = j if same else j + len(ia)
            edge = core[i] != core[j]
            rim, middle = np.where(core[i[edge]] == 1, j[edge], i[edge]), np.where(core[i[edge]] == 1, i[edge], j[edge])
            yield ids[rim], ids[middle], np.zeros(len(rim), bool)
            both = (core[i] == 1) & (core[j] == 1)
            p, q = label[i[both]], label[j[both]]
            apart = p != q
            named = np.unique(np.minimum(p, q)[apart] * len(ids) + np.maximum(p, q)[apart])
            root, used = np.arange(len(ids)), []

            def top(k):
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k
            for n in named.tolist():
                u, w = top(n // len(ids)), top(n % len(ids))
                if u != w:
                    root[max(u, w)] = min(u, w)
                    used.append((u, w))
            while (root[root] != root).any():
                root = root[root]
            label = root[label]
            u = np.array(used, np.int64).reshape(-1, 2)
            yield ids[u[:, 0]], ids[u[:, 1]], np.ones(len(u), bool)
    return _of_pairs(["a", "b", "inner"], look)


def block_pairs(points: DataFrame, eps: float, block: int | None = None, pivots: list[list[float]] | None = None) -> DataFrame | None:
    """Pairs of blocks of adjacent cells of ``points`` (vid, v, mark: a long), each once; nothing without points."""
    if not eps > 0:
        raise ValueError("eps must be positive")
    pivots = pick_pivots(points) if pivots is None else pivots
    if not pivots:
        return None
    block = block or max(BLOCK, min(MOST, -(-points.count() // DEAL)))
    placed = cells(points, pivots, eps)
    sizes = materialise(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "cells")
    dealt = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    dealt = dealt.select("cell", "block", "vid", "mark", "v").repartition("cell", "block").sortWithinPartitions("cell", "block")
    packed = materialise(dealt.mapInArrow(_pack, "cell array<int>, block int, ids binary, marks binary, m binary"), "blocks")
    # the directory of blocks: adjacent cells meet on the cell, in the direction of the larger offset
    ahead = [o for o in itertools.product((-1, 0, 1), repeat=len(pivots)) if o >= (0,) * len(pivots)]
    steps = F.array(*[F.array(*[(F.col("cell")[k] + d).cast("int") for k, d in enumerate(o)]) for o in ahead])
    beside = sizes.select(F.col("cell").alias("cell_a"), F.col("blocks").alias("blocks_a"), F.explode(steps).alias("cell"))
    beside = beside.join(sizes, "cell").select("cell_a", "blocks_a", F.col("cell").alias("cell_b"), F.col("blocks").alias("blocks_b"))
    pairs = beside.select("cell_a", "cell_b", "blocks_b", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)).alias("block_a"))
    pairs = pairs.select("cell_a", "block_a", "cell_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)).alias("block_b"))
    pairs = pairs.where((F.col("cell_a") != F.col("cell_b")) | (F.col("block_a") <= F.col("block_b")))
    left = packed.select(*[F.col(c).alias(f"{c}_a") for c in packed.columns])
    right = packed.select(*[F.col(c).alias(f"{c}_b") for c in packed.columns])
    met = pairs.join(left, ["cell_a", "block_a"]).join(right, ["cell_b", "block_b"])
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("block_a") == F.col("block_b"))
    return met.select("ids_a", "marks_a", "m_a", "ids_b", "marks_b", "m_b", same.alias("same"))


def links(points: DataFrame, eps: float, block: int | None = None) -> DataFrame:
    """(a, b): vids of different vectors (vid, v) at most ``eps`` apart, each pair once, in either order."""
    met = block_pairs(points.select("vid", "v", F.lit(0).cast("long").alias("mark")), eps, block)
    if met is None:
        return points.select(F.col("vid").alias("a"), F.col("vid").alias("b")).limit(0)
    return met.mapInArrow(_links(float(eps)), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node of the links (a, b).

    A round gives each node the smallest label among its own and its neighbours', then the label of
    its label (pointer jumping). It ends when no label changes."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    now = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = now.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        after = materialise(step.join(jump, "root").select("node", "was", F.least("root", "beyond").alias("root")), "labels")
        now = after.select("node", "root")
        if not after.where("was <> root").take(1):
            return now


def density_clusters(vectors: DataFrame, id_col: str, vec_col: str, eps: float = 0.5, min_samples: int = 2, small: int = 5) -> DataFrame:
    """One row per row of ``vectors`` with an id and a vector: id, n_neighbours (rows within ``eps``, itself included),
    is_core, cluster_id (smallest id of the cluster's cores; null: noise), cluster_size (rows), is_candidate
    (noise, or a cluster of fewer than ``small`` rows)."""
    points = materialise(distinct_vectors(vectors, id_col, vec_col), "points")
    spark, pivots = vectors.sparkSession, pick_pivots(points)
    met = block_pairs(points.withColumn("mark", F.col("copies")), eps, pivots=pivots)
    others = met.mapInArrow(_counts(float(eps)), "vid long, n long") if met is not None else spark.createDataFrame([], "vid long, n long")
    degree = others.groupBy("vid").agg(F.sum("n").alias("others"))
    counted = materialise(points.select("vid", "copies").join(degree, "vid", "left").select("vid", "copies", (F.col("copies") + F.coalesce("others", F.lit(0))).alias("n_neighbours"))
                          .withColumn("is_core", F.col("n_neighbours") >= min_samples), "degrees")
    marked = points.select("vid", "v").join(counted.select("vid", F.col("is_core").cast("long").alias("mark")), "vid")
    met = block_pairs(marked, eps, pivots=pivots)
    joins = "a long, b long, inner boolean"
    near = materialise(met.mapInArrow(_joins(float(eps)), joins) if met is not None else spark.createDataFrame([], joins), "near")
    core = counted.where("is_core").select("vid")
    inner = near.where(F.col("inner")).select("a", "b")
    roots = core.join(components(inner).withColumnRenamed("node", "vid"), "vid", "left").select("vid", F.coalesce("root", "vid").alias("root"))
    # a vector beside cores of several clusters goes to the one of the smallest id
    border = near.where(~F.col("inner")).select(F.col("a").alias("vid"), F.col("b").alias("other")).join(roots.select(F.col("vid").alias("other"), "root"), "other").groupBy("vid").agg(F.min("root").alias("beside"))
    named = counted.join(roots, "vid", "left").join(border, "vid", "left").select("vid", "copies", "n_neighbours", "is_core", F.when(F.col("is_core"), F.col("root")).otherwise(F.col("beside")).alias("cluster_id"))
    named = materialise(named, "clusters")
    sized = named.where("cluster_id is not null").groupBy("cluster_id").agg(F.sum("copies").alias("cluster_size"))
    classes = named.join(sized, "cluster_id", "left").join(points.select("vid", "v"), "vid")
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null and _id is not null")
    out = rows.join(classes, "v")
    return out.select(F.col("_id").alias(id_col), "n_neighbours", "is_core", "cluster_id", F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"),
                      (F.col("cluster_id").isNull() | (F.col("cluster_size") < small)).alias("is_candidate"))
