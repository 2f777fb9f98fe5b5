"""Blocked semantic top-k, feedback vectors and impact-ordered postings against plain scoring."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.impact import block_plan, impact_blocks, keyword_top_k
from tessera.operators.semantic import feedback_vectors, semantic_of, semantic_top_k

VEC = "long, embedding array<double>"


def cos(x, y):
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def vectors(seed, n, dim=6):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return rows + [(5000 + i, [2 * x for x in rows[i][1]]) for i in range(0, n, 9)]


def best(scores, k):
    return sorted((-s, d) for d, s in scores)[:k]


@pytest.mark.parametrize("doc_block, query_block, k", [(16, 4, 5), (7, 100, 1), (2048, 256, 40)])
def test_top_k_is_that_of_all_pairs(spark, doc_block, query_block, k):
    docs, queries = vectors(1, 120), vectors(2, 15)
    got = {}
    frames = spark.createDataFrame([*docs, (9000, None), (9001, [0.0] * 6)], "doc_id " + VEC).repartition(3), spark.createDataFrame([*queries, (9000, None)], "query_id " + VEC)
    for r in semantic_top_k(*frames, k, doc_block=doc_block, query_block=query_block).collect():
        got.setdefault(r.query_id, []).append((-r.value, r.doc_id))
    assert {q: sorted(v) for q, v in got.items()} == {q: best([(d, round(cos(v, w), 6)) for d, w in docs], k) for q, v in queries}


def test_filters_and_gains(spark):
    docs, queries = vectors(3, 150), vectors(4, 12)
    r = random.Random(5)
    kind = {d: r.choice(["a", "b", None]) for d, _ in docs}
    place = {d: r.choice(["x", "y", "z", None]) for d, _ in docs}
    want_kind = {q: r.choice(["a", "b", None]) for q, _ in queries}
    want_place = {q: r.choice(["x", "y", None]) for q, _ in queries}
    dv = spark.createDataFrame([(d, v, kind[d], place[d]) for d, v in docs], "doc_id " + VEC + ", kind string, place string")
    qv = spark.createDataFrame([(q, v, want_kind[q], want_place[q], 0.25) for q, v in queries], "query_id " + VEC + ", q_kind string, q_place string, gain double")
    got = {}
    for row in semantic_top_k(dv, qv, 4, [(F.col("kind"), F.col("q_kind"))], [(F.col("place"), F.col("q_place"), F.col("gain"))], 0.3, doc_block=16, query_block=5).collect():
        got.setdefault(row.query_id, []).append((-row.value, row.doc_id))
    for q, v in queries:
        scores = [(d, round(0.3 * round(cos(v, w), 6) + (0.25 if want_place[q] is not None and place[d] == want_place[q] else 0), 6))
                  for d, w in docs if want_kind[q] is None or kind[d] == want_kind[q]]
        want = best(scores, 4)
        assert [d for _, d in sorted(got[q])] == [d for _, d in want]
        assert [s for s, _ in sorted(got[q])] == pytest.approx([s for s, _ in want], abs=2e-6)  # .3 of six decimals can be a tie


def test_plan_has_no_cross_join(spark):
    docs, queries = spark.createDataFrame(vectors(1, 20), "doc_id " + VEC), spark.createDataFrame(vectors(2, 3), "query_id " + VEC)
    plan = semantic_top_k(docs, queries, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_documents_or_queries(spark):
    none, some = spark.createDataFrame([], "doc_id " + VEC), spark.createDataFrame(vectors(2, 3), "query_id " + VEC)
    assert semantic_top_k(none, some, 3).collect() == []
    assert semantic_top_k(spark.createDataFrame(vectors(2, 3), "doc_id " + VEC), some.limit(0), 3).collect() == []


def test_feedback_and_scores_of_pairs(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 4.0]), (4, None), (5, [0.0, 0.0])], "doc_id " + VEC)
    hits = spark.createDataFrame([(7, 1, .9), (7, 4, .8), (7, 2, .7), (7, 3, .1), (8, 4, .5), (9, 3, .2)], "query_id long, doc_id long, s double")
    q = feedback_vectors(hits, docs, "s", top=2)
    assert {r.query_id: r.embedding for r in q.collect()} == {7: [0.5, 0.5], 9: [3.0, 4.0]}
    got = {(r.query_id, r.doc_id): r.semantic_score for r in semantic_of(hits.union(spark.createDataFrame([(9, 5, 0.0)], hits.schema)), docs, q).collect()}
    assert got == {(7, 1): 0.707107, (7, 2): 0.707107, (7, 3): 0.989949, (9, 3): 1.0}


@pytest.mark.parametrize("k", [1, 5, 200])
def test_impact_order_gives_the_same_best(spark, k):
    r = random.Random(6)
    post = []
    for d in range(300):
        for t in {"hot", "warm" if d % 3 == 0 else "hot", f"t{r.randrange(40)}", f"t{r.randrange(40)}"}:
            post.append((d, t, round(r.random() * (0.05 if t in ("hot", "warm") else 1.0), 3)))
    asked = [(q, t, w) for q in range(6) for t, w in {"hot": 0.1, "warm": 0.2, f"t{q}": 0.8, f"t{q + 7}": 0.5}.items()] + [(6, "hot", 1.0), (7, "never", 1.0)]
    postings = spark.createDataFrame(post, "doc_id long, term string, weight double")
    terms = spark.createDataFrame(asked, "query_id long, term string, qw double")
    blocks = impact_blocks(postings, 8)
    got = {}
    for row in keyword_top_k(postings, blocks, terms, k).collect():
        got.setdefault(row.query_id, []).append((-row.keyword_score, row.doc_id))
    want = {}
    for q in range(8):
        weight = {t: w for i, t, w in asked if i == q}
        sums = {}
        for d, t, w in post:
            if t in weight:
                sums[d] = sums.get(d, 0) + weight[t] * w
        if sums:
            want[q] = best([(d, round(s, 6)) for d, s in sums.items()], k)
    assert {q: sorted(v) for q, v in got.items()} == want
    if k == 1:
        every = terms.join(blocks, "term").count()
        assert block_plan(blocks, terms, k).count() < every / 2


def test_blocks_are_in_impact_order(spark):
    postings = spark.createDataFrame([(d, "t", w) for d, w in enumerate([.1, .9, .5, .5, .7])], "doc_id long, term string, weight double")
    rows = sorted((r.block, r.top, sorted(x.doc_id for x in r.docs)) for r in impact_blocks(postings, 2).collect())
    assert rows == [(0, .9, [1, 4]), (1, .5, [2, 3]), (2, .1, [0])]
