"""Keyword scores by document block against plain sums; only needed pairs leave the tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import products as P
from tessera.operators import retrieval as R
from tessera.operators.impact import impact_blocks, keyword_top_k


def data(spark, seed=3):
    r = random.Random(seed)
    post = [(d, t, r.random()) for d in range(120) for t in r.sample(range(30), r.randint(1, 8))]
    vec = [(f"q{q}", t, r.random()) for q in range(9) for t in r.sample(range(33), 5)] + [("none", 99, 1.0)]
    sums = {}
    for q, t, a in vec:
        for d, u, b in post:
            if t == u:
                sums[q, d] = sums.get((q, d), 0) + a * b
    return spark.createDataFrame(post, "doc_id long, term long, weight double"), spark.createDataFrame(vec, "query_id string, term long, weight double"), sums


def rows(df):
    return {(r.query_id, r.doc_id): r.score for r in df.collect()}


@pytest.fixture(params=[(500_000, 1_000_000, 4_000_000), (100, 12, 50)])
def sizes(request, monkeypatch):
    for name, value in zip(("ROWS", "TERMS", "CELLS"), request.param):
        monkeypatch.setattr(P, name, value)


def test_products_equal_plain_sums(spark, sizes):
    post, vec, want = data(spark)
    assert rows(P.block_scores(post, vec)) == pytest.approx(want)
    assert rows(P.block_scores(post, vec, 0.8)) == pytest.approx({k: v for k, v in want.items() if v > 0.8})
    assert rows(P.block_scores(post.limit(0), vec)) == rows(P.block_scores(post, vec.limit(0))) == {}


def test_sums_of_squares_divide_the_scores(spark, sizes):
    post, vec, want = data(spark)
    parts = [(d, None, None, s) for d in range(120) for s in (1.0 + d, 3.0)]
    both = post.withColumn("s", F.lit(None).cast("double")).unionByName(spark.createDataFrame(parts, "doc_id long, term long, weight double, s double"))
    assert rows(P.block_scores(both, vec)) == pytest.approx({k: v / (4 + k[1]) ** .5 for k, v in want.items()})


def test_filters_and_pairs_and_best(spark, sizes):
    post, vec, want = data(spark)
    docs = [(d, "ab"[d % 2], f"p{d % 3}" if d % 5 else None) for d in range(120)] + [(7, "a", "p0")]  # id 7 in two rows
    asked = [(f"q{q}", None if q == 0 else "ab"[q % 2], None if q < 3 else f"p{q % 3}") for q in range(9)]
    got = rows(P.block_scores(post, vec, docs=spark.createDataFrame(docs, "doc_id long, c string, p string"), filters=spark.createDataFrame(asked, "query_id string, c string, p string")))
    ok = {(q, d) for q, qc, qp in asked for d, c, p in docs if (qc is None or qc == c) and (qp is None or qp == p)}
    assert got == pytest.approx({k: v for k, v in want.items() if k in ok})
    some = random.Random(1).sample(sorted(want), 60)
    assert rows(P.block_scores(post, vec, pairs=spark.createDataFrame(some, "query_id string, doc_id long"))) == pytest.approx({k: want[k] for k in some})
    best = rows(P.block_scores(post, vec, k=4))
    for q in {q for q, _ in want}:
        top = sorted((v for (x, _), v in want.items() if x == q), reverse=True)[:4]
        assert sorted((v for (x, _), v in best.items() if x == q), reverse=True)[:4] == pytest.approx(top)


def test_candidates_are_not_multiplied_by_terms(spark):
    post, vec, _ = data(spark)
    top = keyword_top_k(post, impact_blocks(post, 8), vec.withColumnRenamed("weight", "qw"), 3)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan, plan


def test_searches_leave_rejected_pairs_in_the_task(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} common", None, "ab"[i % 2], f"p{i % 5}") for i in range(60)], "id long, description string, subject string, category string, product string")
    idx = R.build_index(docs, "fast", write_entities=False)
    q = R.prepare_queries(spark.createDataFrame([(1, "word1 word2", "A", None, "p1"), (2, "word2", None, None, None)], "query_id long, query string, category string, subcategory string, product string"))
    every, kept = (sorted((r.query_id, r.doc_id) for r in R.keyword_scores(idx, q, filtered=f).collect()) for f in (False, True))
    assert kept == [(x, d) for x, d in every if x == 2 or (d % 2 == 0 and d % 5 == 1)] and kept != every


def test_pairs_are_merged_where_they_lie(spark):
    docs = [(i, f"word{i % 7} timeout" if i % 4 else "timeout", None, "ab"[i % 2] if i % 9 else None, f"p{i % 5}") for i in range(60)] + [(3, "word3", None, "b", "p3")]  # id 3 in two rows
    idx = R.build_index(spark.createDataFrame(docs, "id long, description string, subject string, category string, product string"), "fast")
    asked = [(1, "word1 timeout", "a", "p1"), (2, "word2", None, "p2"), (3, "word3", "b", None), (4, "word3", None, None)]
    q = R.prepare_queries(spark.createDataFrame(asked, "query_id long, query string, category string, product string"))
    want = {}
    pairs = {(p, c) for *_, c, p in docs}
    for n, _, c, p in asked:
        for d, _, _, dc, _ in docs:
            if dc is not None and (dc == c or (p, dc) in pairs):
                want[n, d] = want.get((n, d), 0) + .5 * (dc == c) + .3 * ((p, dc) in pairs)
    category = R.category_scores(idx, q)
    assert {(r.query_id, r.doc_id): r.category_score for r in category.collect()} == pytest.approx(want)
    frames = {"keyword": R.keyword_scores(idx, q), "entity": R.entity_scores(idx, q), "category": category}
    merged = R.merge_scores(frames, R.FAST_WEIGHTS, ("category",))
    lines = merged._jdf.queryExecution().executedPlan().toString().splitlines()
    above = lines[:next(i for i, x in enumerate(lines) if "Union" in x)]
    assert not any("Exchange" in x for x in above), "\n".join(lines)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, R.merge_scores(frames, R.FAST_WEIGHTS).collect()))


def test_feedback_takes_the_best_hits_of_all_documents_with_a_vector(spark):
    from tessera.operators.semantic import feedback_vectors
    docs = [(i, f"word{i % 7} word{i % 4} common{i % 2}", None, "ab"[i % 2], "p") for i in range(80)]
    idx = R.build_index(spark.createDataFrame(docs, "id long, description string, subject string, category string, product string"), "fast", write_entities=False)
    q = R.prepare_queries(spark.createDataFrame([(1, "word1 common1", "a"), (2, "word5 word2", "b"), (3, "unknown", None)], "query_id long, query string, category string"))
    vectors = spark.createDataFrame([(i, [float(i), 1.0] if i % 3 else None) for i in range(5, 80)], "doc_id long, embedding array<double>")
    got = {r.query_id: r.embedding for r in R.feedback(idx.tfidf.matches(q, "query_id", "q_text"), vectors).collect()}
    want = {r.query_id: r.embedding for r in feedback_vectors(R.keyword_scores(idx, q), vectors, "keyword_score").collect()}
    assert got == want and set(got) == {1, 2}
