"""Feature-engineering and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import features as X
from tessera.operators import sampling as P
from tessera.plans import sqlparts as S
from tessera.plans.registry import query
from tessera.sources.tables import v_event, v_order, v_text

def tok(x: str) -> str:
    return S.tokens(x)


def _rule_sql(x: str) -> str:
    """SQL twin of the rule-based language classifier."""
    toks = tok(x)
    counts = {lg: f"len(list_filter({toks}, lambda t: t IN ({', '.join(S.lit(w) for w in ws)})))"
              for lg, ws in X.LANG_MARKERS.items()}
    langs = sorted(counts)
    best = "greatest(" + ", ".join(counts[lg] for lg in langs) + ")"
    cases = " ".join(f"WHEN {counts[lg]} = {best} THEN '{lg}'" for lg in langs)
    return f"CASE WHEN {best} = 0 THEN 'en' {cases} END"


PRED_SQL = f"pred AS (SELECT id, category AS label, {_rule_sql('description')} AS prediction FROM v_text)"


def _predictions(spark, sf):
    v = v_text(spark, sf).select("id", F.col("category").alias("label"), "description")
    return X.with_rule_language(v, "description", "prediction").select("id", "label", "prediction")


# ---------------------------------------------------------------- X3, X4, X7, X9, X10, X11
@query("label_encode", S.with_views("""
SELECT column_name AS "column", value, CAST(dense_rank() OVER (PARTITION BY column_name ORDER BY value) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT column_name, value FROM (
  SELECT 'category' AS column_name, coalesce(category, 'unknown') AS value FROM v_text UNION ALL SELECT 'product', coalesce(product, 'unknown') FROM v_text
  UNION ALL SELECT 'subcategory', coalesce(subcategory, 'unknown') FROM v_text))"""))
def label_encode(spark, sf):
    return X.fit_label_index(v_text(spark, sf), ["category", "product", "subcategory"])


@query("standard_scale", S.with_views("""
SELECT id, (resolution_time_hours - m1) / coalesce(nullif(s1, 0), 1) AS resolution_time_hours_scaled,
       (satisfaction_score - m2) / coalesce(nullif(s2, 0), 1) AS satisfaction_score_scaled
FROM v_event, (SELECT avg(resolution_time_hours) AS m1, stddev_pop(resolution_time_hours) AS s1,
                      avg(satisfaction_score) AS m2, stddev_pop(satisfaction_score) AS s2 FROM v_event)"""))
def standard_scale(spark, sf):
    cols = ["resolution_time_hours", "satisfaction_score"]
    e = v_event(spark, sf)
    out = X.apply_scaling(e, X.fit_moments(e, cols), cols)
    return out.select("id", *[f"{c}_scaled" for c in cols])


SPLIT_SQL = """sp AS (SELECT id, priority, product, CASE WHEN r < floor(0.7 * n) THEN 'train'
  WHEN r < floor(0.7 * n) + floor(0.15 * n) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT id, priority, product, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM v_order))"""


@query("transform_inference", S.with_views("""
SELECT s.id, coalesce(a.code, -1) AS priority_code, coalesce(b.code, -1) AS product_code FROM sp s
LEFT JOIN (SELECT priority AS value, dense_rank() OVER (ORDER BY priority) - 1 AS code
           FROM (SELECT DISTINCT priority FROM sp WHERE split = 'train' AND priority IS NOT NULL)) a ON s.priority = a.value
LEFT JOIN (SELECT product AS value, dense_rank() OVER (ORDER BY product) - 1 AS code
           FROM (SELECT DISTINCT product FROM sp WHERE split = 'train' AND product IS NOT NULL)) b ON s.product = b.value
WHERE s.split = 'test'""", SPLIT_SQL))
def transform_inference(spark, sf):
    """Label index fitted on the train split, applied to the test split (unseen -> -1)."""
    sp = P.split_ordered(v_order(spark, sf).select("id", "priority", "product"), "id")
    idx = X.fit_label_index(sp.where(F.col("split") == "train"), ["priority", "product"])
    out = X.apply_label_index(sp.where(F.col("split") == "test"), idx, ["priority", "product"])
    return out.select("id", "priority_code", "product_code")


WORDS_SQL = f"""words AS (
  SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS BIGINT) AS code FROM (
    SELECT word, count(*) AS n FROM (SELECT unnest({tok('description')}) AS word FROM v_text) GROUP BY word)
  QUALIFY code < 10000)"""
SEQ_SQL = f"""seq AS (
  SELECT s.id, s.pos, coalesce(w.code, 1) AS code FROM (
    SELECT id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM (
      SELECT id, {tok('description')} AS t FROM v_text)) s LEFT JOIN words w ON s.word = w.word)"""


def _sequences(spark, sf):
    v = v_text(spark, sf)
    return X.to_sequences(v, "id", "description", X.word_index(v, "description", 10000))


@query("text_to_sequence", S.with_views("SELECT id, pos, code FROM seq", WORDS_SQL, SEQ_SQL))
def text_to_sequence(spark, sf):
    return _sequences(spark, sf)


@query("pad_sequence", S.with_views("""
SELECT id, pos - greatest(n - 100, 0) AS pos, code FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM seq)
WHERE pos >= n - 100
UNION ALL
SELECT id, CAST(p AS BIGINT) AS pos, CAST(0 AS BIGINT) AS code FROM (
  SELECT id, unnest(range(least(count(*), 100), 100)) AS p FROM seq GROUP BY id)""", WORDS_SQL, SEQ_SQL))
def pad_sequence(spark, sf):
    return X.pad_sequences(_sequences(spark, sf), 100)


@query("realtime_features", S.with_views("""
SELECT e.id, c.code AS category_code, p.code AS product_code, hour(created_at) AS hour,
       isodow(created_at) - 1 AS weekday, isodow(created_at) - 1 IN (5, 6) AS is_weekend,
       resolution_time_hours, satisfaction_score
FROM v_event e
JOIN (SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT category FROM v_event)) c
  ON e.category = c.category
JOIN (SELECT product, CAST(dense_rank() OVER (ORDER BY product) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT product FROM v_event)) p
  ON e.product = p.product"""))
def realtime_features(spark, sf):
    """X11: per-row feature table (label codes + time features + numerics)."""
    e = v_event(spark, sf)
    idx = X.fit_label_index(e, ["category", "product"])
    x = X.apply_label_index(e, idx, ["category", "product"])
    wd = F.weekday("created_at")
    return x.select("id", "category_code", "product_code", F.hour("created_at").alias("hour"), wd.alias("weekday"),
                    wd.isin(5, 6).alias("is_weekend"), "resolution_time_hours", "satisfaction_score")


# ---------------------------------------------------------------- G12, G13, M6, M9, G20
@query("confusion_matrix", S.with_views("SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2", PRED_SQL))
def confusion_matrix(spark, sf):
    return X.confusion(_predictions(spark, sf), "label", "prediction")


REPORT_SQL = """rep AS (
  WITH cm AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2),
  cls AS (SELECT c AS cls, coalesce(s.support, 0) AS support, coalesce(p.predicted, 0) AS predicted, coalesce(t.tp, 0) AS tp
    FROM (SELECT label AS c FROM cm UNION SELECT prediction FROM cm) k
    LEFT JOIN (SELECT label, sum(n) AS support FROM cm GROUP BY label) s ON s.label = k.c
    LEFT JOIN (SELECT prediction, sum(n) AS predicted FROM cm GROUP BY prediction) p ON p.prediction = k.c
    LEFT JOIN (SELECT label, n AS tp FROM cm WHERE label = prediction) t ON t.label = k.c),
  per AS (SELECT cls, precision, recall, support, tp,
                 CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
    FROM (SELECT cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                 CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support, tp FROM cls)),
  tot AS (SELECT sum(support) AS N, sum(tp) AS TP, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
                 sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM per)
  SELECT cls, precision, recall, f1, CAST(support AS BIGINT) AS support FROM per
  UNION ALL SELECT 'macro avg', mp, mr, mf, CAST(N AS BIGINT) FROM tot
  UNION ALL SELECT 'weighted avg', wp / N, wr / N, wf / N, CAST(N AS BIGINT) FROM tot
  UNION ALL SELECT 'micro avg', TP / N, TP / N, TP / N, CAST(N AS BIGINT) FROM tot
  UNION ALL SELECT 'accuracy', TP / N, TP / N, TP / N, CAST(N AS BIGINT) FROM tot)"""


@query("classification_report", S.with_views("SELECT * FROM rep", PRED_SQL, REPORT_SQL))
def classification_report(spark, sf):
    return X.classification_report(_predictions(spark, sf), "label", "prediction")


@query("model_selection", S.with_views("""
SELECT cls, f1, CASE WHEN f1 IS NULL THEN 'failed' WHEN f1 > 0.5 THEN 'selected' ELSE 'rejected' END AS status
FROM rep""", PRED_SQL, REPORT_SQL))
def model_selection(spark, sf):
    """M9 over the per-class report rows (threshold .5, exclusive, as the pipeline does)."""
    rep = X.classification_report(_predictions(spark, sf), "label", "prediction")
    return X.selection_status(rep.select("cls", "f1"), "f1", 0.5)


@query("best_model", S.with_views("""
SELECT cls, f1 FROM rep WHERE cls NOT IN ('macro avg', 'weighted avg', 'micro avg', 'accuracy')
ORDER BY f1 DESC, cls LIMIT 1""", PRED_SQL, REPORT_SQL))
def best_model(spark, sf):
    """K0e: arg-max row of a metrics table (here: the best-recognised class)."""
    rep = X.classification_report(_predictions(spark, sf), "label", "prediction")
    return rep.where(~F.col("cls").isin("macro avg", "weighted avg", "micro avg", "accuracy")).orderBy(
        F.col("f1").desc(), "cls").limit(1).select("cls", "f1")


@query("selected_models", S.with_views("""
SELECT l.cls, f1, CASE WHEN f1 IS NULL THEN NULL WHEN f1 > 0.5 THEN 'selected' ELSE 'rejected' END AS status,
       coalesce(f1 > 0.5, false) AS is_selected
FROM (SELECT DISTINCT lang AS cls FROM documents UNION SELECT 'unknown') l LEFT JOIN rep USING (cls)""", PRED_SQL, REPORT_SQL))
def selected_models(spark, sf):
    """The selection report asked for every language and for one that it does not hold."""
    from tessera.sources.tables import table
    rep = X.classification_report(_predictions(spark, sf), "label", "prediction").select("cls", "f1")
    wanted = table(spark, sf, "documents").select(F.col("lang").alias("cls")).union(spark.sql("SELECT 'unknown' AS cls"))
    return X.model_status(X.selection_status(rep, "f1", 0.5), wanted, "cls").select("cls", "f1", "status", "is_selected")
