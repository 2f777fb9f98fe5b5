"""Hand-computed expectations (FIXTURES.md) for the scoring, metric and feature operators."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.numfmt import fixed
from tessera.operators import aggregates as G
from tessera.operators import features as X
from tessera.operators import retrieval as R
from tessera.operators import sampling as P
from tessera.operators import windows as W
from tessera.operators.tfidf import TfidfConfig, fit_transform


def test_success_rate(spark):
    df = spark.createDataFrame([(True, 5.0), (True, 4.0), (False, 3.0), (True, 0.0), (None, None)],
                               "h boolean, s double")
    rows = df.select(R.success_rate(F.col("h"), F.col("s"), "full").alias("full"),
                     R.success_rate(F.col("h"), F.col("s"), "fast").alias("fast")).collect()
    assert [round(r.full, 4) for r in rows] == [1.0, 0.94, 0.18, 0.94, 0.94]
    assert [round(r.fast, 4) for r in rows] == [1.0, 0.94, 0.18, 0.70, 0.94]


def test_combine_fast_and_boost(spark):
    k, e, c = spark.createDataFrame([(1, 1, 0.3030)], "query_id long, doc_id long, keyword_score double"), \
        spark.createDataFrame([(1, 1, 1.0)], "query_id long, doc_id long, entity_score double"), \
        spark.createDataFrame([(1, 1, 0.8)], "query_id long, doc_id long, category_score double")
    m = R.merge_scores({"keyword": k, "entity": e, "category": c}, R.FAST_WEIGHTS).first()
    assert m.relevance_score == pytest.approx(0.5518, abs=1e-6)
    assert R.CATEGORY_BOOST + R.PRODUCT_CATEGORY_BOOST == pytest.approx(0.8)


def test_enhanced_rerank(spark):
    df = spark.range(1)
    v = df.select(R.rerank_enhanced_score(F.lit(0.5), F.lit(0.94), F.lit(True), F.lit(1.0), F.lit(1.0)).alias("s")).first().s
    assert v == pytest.approx(0.5455, abs=1e-9)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "y string")
    w = {r.y: r.weight for r in G.class_weights(df, "y").collect()}
    assert w["a"] == pytest.approx(2 / 3, abs=1e-4) and w["b"] == pytest.approx(2.0)


def test_f1_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("a", "b"), ("b", "b")], "y string, p string")
    rep = {r.cls: r for r in X.classification_report(df, "y", "p").collect()}
    assert rep["a"].f1 == pytest.approx(0.8)
    assert rep["b"].f1 == pytest.approx(2 / 3)
    assert rep["macro avg"].f1 == pytest.approx(0.7333, abs=1e-4)
    assert rep["weighted avg"].f1 == pytest.approx(0.7667, abs=1e-4)
    assert rep["micro avg"].f1 == pytest.approx(0.75)


def test_standard_scale(spark):
    df = spark.createDataFrame([(5,), (10,), (2,)], "x long")
    out = X.apply_scaling(df, X.fit_moments(df, ["x"]), ["x"]).orderBy("x").collect()
    assert [round(r.x_scaled, 4) for r in out] == [-1.1112, -0.2020, 1.3132]


def test_label_encode(spark):
    df = spark.createDataFrame([("Technical", "High"), ("Billing", "Low"), ("Technical", "Medium")], "category string, priority string")
    idx = {(r.column, r.value): r.code for r in X.fit_label_index(df, ["category", "priority"]).collect()}
    assert idx == {("category", "Billing"): 0, ("category", "Technical"): 1,
                   ("priority", "High"): 0, ("priority", "Low"): 1, ("priority", "Medium"): 2}
    unseen = X.apply_label_index(spark.createDataFrame([("Sales",)], "category string"), X.fit_label_index(df, ["category"]),
                                 ["category"]).first()
    assert unseen.category_code == -1


def test_ordered_split_counts(spark):
    df = spark.range(10001).withColumnRenamed("id", "k")
    counts = {r.split: r["count"] for r in P.split_ordered(df, "k").groupBy("split").count().collect()}
    assert counts == {"train": 7000, "val": 1500, "test": 1501}


def test_row_index_is_dense(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"))
    idx = P.row_index(df, ["k"], partitions=7)
    assert idx.where(F.col("row_idx") != F.col("k")).count() == 0


def test_rolling_mean(spark):
    df = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 5.0), ("p", 3, 2.0)], "key string, t int, v double")
    out = W.rolling_stats(df, "key", "t", "v", 2).orderBy("t").collect()
    assert [r.rolling_mean for r in out] == [None, 3.0, 3.5]


def test_tfidf_unigrams(spark):
    docs = spark.createDataFrame([(0, "sync timeout"), (1, "sync backup")], "doc_id long, text string")
    cfg = TfidfConfig(max_features=None, ngram_range=(1, 1), min_df=1, max_df=1.0, stop_words=False)
    m = fit_transform(docs, "doc_id", "text", cfg, persist=False)
    idf = {r.term: r.idf for r in m.vocab.collect()}
    assert idf["sync"] == pytest.approx(1.0) and idf["timeout"] == pytest.approx(1.405465, abs=1e-6)
    w = {(r.doc_id, r.term): r.weight for r in m.weights.collect()}
    assert w[(0, "sync")] == pytest.approx(0.579739, abs=1e-6)
    assert w[(0, "timeout")] == pytest.approx(0.814802, abs=1e-6)
    idx = R.SolutionIndex("fast", docs, m, spark.createDataFrame([], "doc_id long, type string, value string"), {})
    q = spark.createDataFrame([(7, "timeout")], "query_id long, q_text string")
    s = {r.doc_id: r.keyword_score for r in R.keyword_scores(idx, q).collect()}
    assert s == {0: pytest.approx(0.814802, abs=1e-6)}


def test_entity_patterns(spark):
    text = "error error_connection_refused error_404 err-12 synctimeout_error myerr 503 4567 v1.2.3 2.0"
    df = spark.createDataFrame([(text,)], "t string")

    def ents(pats):
        return sorted((r.type, r.value) for r in df.select(F.explode(T.extract_entities(F.col("t"), pats)).alias("e"))
                      .select("e.*").collect())

    full = ents(T.ENTITY_PATTERNS_FULL)
    assert {v for t, v in full if t == "error_codes"} == {"error_404", "err-12", "synctimeout_error", "myerr"}
    assert {v for t, v in full if t == "version_numbers"} == {"v1.2.3", "2.0"}
    fast = ents(T.ENTITY_PATTERNS_FAST)
    assert {v for t, v in fast if t == "errors"} == {"error_404", "err-12"}
    assert {v for t, v in fast if t == "codes"} == {"503", "4567"}
    ultra = ents(T.ENTITY_PATTERNS_ULTRA)
    assert {v for t, v in ultra if t == "errors"} == {"error", "error_connection_refused", "error_404"}


def test_model_selection(spark):
    df = spark.createDataFrame([("m1", 0.51), ("m2", 0.50), ("m3", None)], "model string, f1 double")
    st = {r.model: r.status for r in X.selection_status(df).collect()}
    assert st == {"m1": "selected", "m2": "rejected", "m3": "failed"}
    st2 = {r.model: r.status for r in X.selection_status(df, threshold=0.5, inclusive=True).collect()}
    assert st2["m2"] == "selected"


def test_fixed_format_matches_python(spark):
    vals = [65.175, 0.20625, 0.125, 2.5, -1.005, 123456.789, 99.995, 0.0, 1e-7]
    rows = spark.createDataFrame([(v,) for v in vals], "x double").select(
        "x", fixed(F.col("x"), 2).alias("a"), fixed(F.col("x"), 4).alias("b")).collect()
    for r in rows:
        assert r.a == f"{r.x:.2f}" and r.b == f"{r.x:.4f}"


def test_concurrency_two_level(spark):
    df = spark.createDataFrame([("k", "2024-01-01 10:00:00", "2024-01-02 10:00:00"),
                                ("k", "2024-01-01 11:00:00", "2024-01-01 12:00:00"),
                                ("k", "2024-01-02 09:00:00", "2024-01-03 09:00:00")], "key string, s string, e string")
    df = df.select("key", F.to_timestamp("s").alias("s"), F.to_timestamp("e").alias("e"))
    out = [r.in_progress for r in W.concurrency(df, "key", "s", "e").orderBy("ts").collect()]
    assert out == [1, 2, 1, 2, 1, 0]


def test_cooccurrence_states_hot_entities_whole(spark):
    rows = [(i, "codes", "111") for i in range(6)] + [(0, "codes", "222"), (1, "codes", "222"), (1, "codes", "222")]
    ents = spark.createDataFrame(rows, "doc_id long, type string, value string")
    from tessera.operators.graph import anchor_pairs, cooccurrence
    got = sorted(tuple(r) for r in cooccurrence(ents).collect())
    assert got == sorted([(i, "codes", "111", 6, 15) for i in range(6)] + [(i, "codes", "222", 2, 1) for i in (0, 1)])
    anchors = spark.createDataFrame([(0,), (3,)], "doc_id long")
    want = sorted([(0, 1, 2), *[(0, b, 1) for b in (2, 3, 4, 5)], *[(3, b, 1) for b in (0, 1, 2, 4, 5)]])
    for block in (10_000, 2):
        assert sorted(tuple(r) for r in anchor_pairs(ents, anchors, block).collect()) == want


def test_fingerprint_has_four_parts(spark):
    import hashlib

    from pyspark.sql import functions as F

    from tessera.functions.text import fingerprint
    r = spark.range(1).select(fingerprint(F.lit("printer broken"), F.lit("hardware"), F.lit(None), F.lit(10)).alias("f")).first()
    assert r.f == hashlib.md5(b"printer broken_hardware_None_10").hexdigest() == "0773f16503e3b6b0b9c139ef2b5563bf"


def test_gates_flag_instead_of_dropping(spark):
    from pyspark.sql import functions as F

    from tessera.operators.anomaly import retrieval_failures
    log = spark.createDataFrame([("a", 0.0)] * 101 + [("b", 0.0)] * 3, "category string, success double")
    got = sorted(tuple(r) for r in retrieval_failures(log).select("category", "tickets", "is_anomaly", "enough_data").collect())
    assert got == [("a", 101, True, True), ("b", 3, False, False)]


def test_replayed_batch_repeats_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming import monitor as V
    src = str(tmp_path / "in")
    spark.range(10).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)

    def twice(batch, batch_id):
        return batch.withColumn("n", F.col("id") * 2)
    assert V.run_to_table(spark, stream, [], "replay", per_batch=twice).count() == 10
