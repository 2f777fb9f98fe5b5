"""Feature state and models: fits see training rows only; scores are proper; failures are named."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import assembler as A
from tessera.operators import ml as M
from tessera.operators.tfidf import TfidfConfig
from tessera.sources.files import scan_report, scratch_path, write_json

CFG = TfidfConfig(max_features=50, stop_words=False)
WORDS = {"net": ["router", "cable", "signal"], "bill": ["invoice", "refund", "payment"], "auth": ["password", "login", "token"]}


@pytest.fixture(scope="module")
def tickets(spark):
    r = random.Random(1)
    rows = []
    for i in range(240):
        c = r.choice(sorted(WORDS))
        body = r.choices(WORDS[c], k=4) + r.choices(["the", "please", "today", "again"], k=3)
        rows.append((i, " ".join(body), r.choice(["a", "b", None]), float(r.randint(0, 9)), c, None if i % 5 else "x"))
    return spark.createDataFrame(rows, "id long, text string, product string, hours double, team string, rare string").cache()


@pytest.fixture(scope="module")
def prepared(tickets):
    return M.prepare(tickets, "team", ["text"], ["product"], ["hours"], cfg=CFG)


@pytest.fixture(scope="module", params=["logistic", "forest", "boosted"])
def fitted(request, prepared):
    train = M.with_class_weights(prepared.part("train"))
    return request.param, M.train(train, request.param, trees=10, depth=4, boosted=M.Boosting(3, 0.2, 4))


def test_probabilities_and_predictions(prepared, fitted):
    rows = M.score(fitted[1], prepared.part("test")).select("id", "prediction", vector_to_array("probability").alias("p")).collect()
    assert len(rows) == prepared.part("test").count() > 20
    for r in rows:
        assert abs(sum(r.p) - 1) < 1e-9 and min(r.p) >= 0
        assert r.p[int(r.prediction)] == max(r.p)


def test_test_rows_are_recognised(prepared, fitted):
    f1 = {r.cls: r.f1 for r in M.evaluate(M.score(fitted[1], prepared.part("test"))).collect()}
    assert f1["macro avg"] > 0.9


def test_boosted_uses_one_model_per_class_and_its_settings(prepared, fitted):
    kind, model = fitted
    if kind == "boosted":
        models = model.stages[-1].models
        assert len(models) == 3
        assert all(m.getNumTrees <= 4 and max(t.depth for t in m.trees) <= 3 for m in models)


def test_boosting_settings_by_classes():
    assert (M.boosting(4), M.boosting(20), M.boosting(25)) == (M.FEW, M.FEW, M.MANY)


def test_fit_sees_training_rows_only(spark):
    rows = [(1, "old words", "p"), (2, "old words", "p"), (3, "new words", "q")]
    df = spark.createDataFrame(rows, "id long, text string, product string").withColumn("split", F.when(F.col("id") < 3, "train").otherwise("test"))
    p = M.prepare(df, "product", ["text"], [], [], cfg=CFG, split=df)
    assert sorted(r.term for r in p.state.terms.collect()) == ["old", "words"]
    assert {r.id: r.label for r in p.rows.collect()} == {1: 0.0, 2: 0.0, 3: -1.0}
    assert [r.id for r in p.part("test").collect()] == []


def test_state_roundtrip_missing_columns_and_unseen_values(spark, tickets):
    state = A.fit_features(tickets, ["text"], ["product"], ["hours"], CFG)
    base = scratch_path(spark, "state")
    state.save(base)
    back = A.load_state(spark, base, "1", CFG)
    whole = lambda df, s: sorted((r.id, r.slot, round(r.value, 9)) for r in A.nonzero(A.apply_features(df, s)).collect())
    assert whole(tickets, back) == whole(tickets, state)
    n = state.terms.count()
    asked = spark.createDataFrame([(1, "router zzz", "never", None), (2, None, None, 3.0)], "id long, text string, product string, hours double")
    mean, std = state.moments.select("mean", "std").first()
    rows = {r.id: dict(enumerate(r.features.toArray().tolist())) for r in A.apply_features(asked, back).collect()}
    assert all(len(v) == n + 2 for v in rows.values())
    assert rows[1][n] == -1.0 and abs(rows[1][n + 1] + mean / std) < 1e-9 and sum(v != 0 for k, v in rows[1].items() if k < n) == 1
    assert rows[2][n] == back.codes.where("value = 'unknown'").first().code and not any(v for k, v in rows[2].items() if k < n)
    assert [r.features.size for r in A.apply_features(asked.drop("text"), back).collect()] == [2, 2]
    nothing = A.apply_features(asked.select("id"), back).collect()
    assert [r.features.toArray().tolist() for r in nothing] == [[0.0], [0.0]]
    names = {r.slot: r.name for r in A.feature_names(back, ["product", "hours"]).collect()}
    assert names == {0: "product", 1: "hours"}


def test_pipeline_names_what_cannot_be_trained(tickets):
    rep, models = M.train_targets(tickets.withColumn("same", F.lit(1)).withColumn("empty", F.lit(None).cast("string")), ["team", "same", "empty", "missing", "rare"],
                                  ["text"], ["product"], ["hours"], cfg=CFG)
    got = {r.target: (r.status, r.reason) for r in rep.collect()}
    assert got == {"team": ("ok", None), "same": ("failed", "one class"), "empty": ("failed", "no values"), "missing": ("failed", "missing column"), "rare": ("failed", "one class")}
    assert list(models) == ["team"] and rep.where("target = 'team'").first().meets_target


def test_folds_hold_every_row_once(tickets):
    folds = M.kfold_scores(tickets, "team", ["text"], ["product"], ["hours"], 3, cfg=CFG).collect()
    assert [r.fold for r in folds] == [0, 1, 2] and sum(r.rows for r in folds) == 240
    assert all(r.f1 > 0.9 for r in folds)


def test_importance_names_columns_too(prepared):
    model = M.train(M.with_class_weights(prepared.part("train")), "forest", trees=10, depth=4)
    rows = M.feature_importance(model, prepared.state, 60).collect()
    width = prepared.rows.first().features.size
    assert abs(sum(r.importance for r in rows) - 1) < 1e-9
    assert all(r.term is not None for r in rows) and {r.column for r in rows} <= {"text", "product", "hours"}
    assert max(r.feature_index for r in rows) < width


def test_report_that_does_not_exist_is_empty(spark):
    path = scratch_path(spark, "report")
    schema = "target string, f1 double"
    assert scan_report(spark, path, schema).collect() == []
    write_json(spark.createDataFrame([("a", 0.5)], schema), path)
    assert [tuple(r) for r in scan_report(spark, path, schema).collect()] == [("a", 0.5)]


def test_boosted_queries_use_the_settings_of_the_library(spark, monkeypatch):
    from conftest import SMOKE
    from tessera.plans import models as Q
    train, asked = M.train, []

    def quick(df, kind="logistic", **settings):
        asked.append((kind, settings.get("boosted")))
        return train(df, "logistic", iterations=1)
    monkeypatch.setattr(M, "train", quick)
    assert Q.train_boosted(spark, SMOKE).count() > 0
    assert Q.compare_models(spark, SMOKE).count() == 3
    assert [kind for kind, _ in asked] == ["boosted", "logistic", "forest", "boosted"]
    assert all(b in (None, M.FEW) for _, b in asked)


def test_texts_are_cut_into_words_once_for_all_targets(tickets, monkeypatch):
    from tessera.functions import text as T
    plain, calls = T.tokens, []
    monkeypatch.setattr(T, "tokens", lambda c, strip_accents=False: calls.append(1) or plain(c, strip_accents))
    rep, models = M.train_targets(tickets, ["team", "product"], ["text"], [], ["hours"], cfg=CFG, iterations=2)
    assert sorted(models) == ["product", "team"] and len(calls) == 1


def test_words_give_the_features_of_their_texts(spark):
    cfg = TfidfConfig(max_features=30, ngram_range=(1, 2))
    rows = [(1, "The Router, the cable and THE signal"), (2, None), (3, ""), (4, "the"), (5, "router cable router cable"), (6, "cable Straße é")]
    texts = spark.createDataFrame(rows, "id long, text string")
    words = A.with_words(texts, ["text"], cfg)
    assert dict(words.dtypes)["text"] == "array<string>"
    state, same = (A.fit_features(x, ["text"], [], [], cfg) for x in (texts, words))
    assert sorted(map(tuple, state.terms.collect())) == sorted(map(tuple, same.terms.collect()))
    got = lambda x: {r.id: r.features for r in A.apply_features(x, state).collect()}
    assert got(texts) == got(words)
