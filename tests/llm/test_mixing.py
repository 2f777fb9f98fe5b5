"""Mixing: apportionment against seat-by-seat allocation, targets against the water-filling loop, totals."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M


def words(t):
    return len((t or "").encode().split())


def plain_targets(sizes):
    """sizes by source: share 150 % by weight, cap at twice the size, reshare until nobody is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def make(seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(400):
        s = r.choice(["a"] * 6 + ["b", "Z", "é", None, "tiny"])
        if s == "tiny" and r.random() < 0.9:
            s = "a"
        rows.append((k, "w " * int(r.paretovariate(1.1) * 20), "en", s, 0))
    return rows + [(900, None, "en", "a", 0), (901, "", "en", "nothing", 0), (902, "w " * 30000, "en", "b", 0), (None, "x y", "en", "b", 0), (5, "w w w", "en", "b", 0), (5, "w w w", "en", "b", 0)]


@pytest.mark.parametrize("shard_words", [M.SHARD_WORDS, 2000])
def test_totals(spark, docs, shard_words):
    rows = make()
    df = docs(rows).withColumn("size", F.lit("clash")).withColumn("_source", F.lit(1))
    got = M.mix(df, shard_words=shard_words).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in target.items():
        shards = -(-sizes[s] // shard_words)
        assert abs(taken[s] - t) <= M.BLOCK_WORDS * (1 + (shards if t >= 2 * sizes[s] else 0))
    again = M.mix(df.repartition(7), shard_words=shard_words).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_seats_against_one_by_one(spark):
    r = random.Random(9)
    for house in (0, 1, 7, 100):
        votes = [float(r.choice([0, 1, 1, 3, 50, 1000, r.randrange(1, 5000)])) for _ in range(15)]
        df = spark.createDataFrame([(1, k, v) for k, v in enumerate(votes)], "g int, k int, v double")
        got = {x.k: x.seats for x in M.seats(df, ["g"], "k", "v", F.lit(sum(votes)), F.lit(house)).collect()}
        seats = [0] * len(votes)
        for _ in range(house):
            best = max(range(len(votes)), key=lambda k: (votes[k] / (2 * seats[k] + 1), -k))
            seats[best] += 1
        assert [got[k] for k in range(len(votes))] == seats


def test_empty(spark, docs):
    assert M.mix(docs([])).count() == 0
    assert M.mix(docs([(1, None), (2, "")])).select("taken", "target").distinct().collect() == [(0, 0.0)]
