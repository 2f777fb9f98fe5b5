"""Whole forms of operators whose first queries show a part: real-time features, data quality, current values, shifts by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import aggregates as G
from tessera.operators import anomaly as A
from tessera.operators import features as X
from tessera.operators import quality as Q
from tessera.operators import retrieval as R
from tessera.operators.tfidf import CONFIGS
from tessera.plans import sqlparts as S
from tessera.plans.registry import query
from tessera.sources.tables import benchmark_queries, table, v_event, v_text

CODED = ["agent_id", "product", "category", "customer_sentiment", "escalated", "language", "region"]


def _clean(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-zA-Z0-9\\s.,!?]', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def _codes_sql() -> str:
    joins = " ".join(f"""LEFT JOIN (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'unknown') AS v FROM t)) c_{c}
  ON c_{c}.v = coalesce(CAST(t.{c} AS VARCHAR), 'unknown')""" for c in CODED)
    codes = ", ".join(f"c_{c}.code AS {c}_code" for c in CODED)
    return S.with_views(f"""SELECT id, {codes}, hour(created_at) AS hour, isodow(created_at) - 1 AS weekday, isodow(created_at) - 1 IN (5, 6) AS is_weekend,
  resolution_time_hours, satisfaction_score, text_length FROM t {joins}""",
                        f"""t AS (SELECT e.*, d.category AS language, d.product AS region, CAST(length({_clean(_clean('subject') + " || ' ' || " + _clean('description'))}) AS BIGINT) AS text_length
  FROM v_event e LEFT JOIN v_text d ON d.id = e.id)""")


@query("realtime_feature_table", _codes_sql())
def realtime_feature_table(spark, sf):
    """X11, all thirteen columns: seven codes, the time of the event, its numbers and the length of the ticket's cleaned text
    (the document of the event's id; language and region are its language and source)."""
    d = v_text(spark, sf)
    text = T.clean_text(F.concat(T.clean_text(F.col("subject")), F.lit(" "), T.clean_text(F.col("description"))))
    d = d.select("id", F.col("category").alias("language"), F.col("product").alias("region"), F.length(text).cast("long").alias("text_length"))
    t = v_event(spark, sf).join(d, "id", "left").withColumn("text_length", F.coalesce("text_length", F.lit(0).cast("long")))
    x = X.apply_label_index(t, X.fit_label_index(t, CODED), CODED)
    day = F.weekday("created_at")
    return x.select("id", *[f"{c}_code" for c in CODED], F.hour("created_at").alias("hour"), day.alias("weekday"), day.isin(5, 6).alias("is_weekend"),
                    "resolution_time_hours", "satisfaction_score", "text_length")


@query("dq_events", S.with_views("""
SELECT metric, value FROM (SELECT 'rows' AS metric, count(*) AS value FROM v_event
  UNION ALL SELECT 'nulls_resolution_time_hours', count(*) FILTER (WHERE resolution_time_hours IS NULL) FROM v_event
  UNION ALL SELECT 'issue_negative_resolution_time', count(*) FILTER (WHERE resolution_time_hours < 0) FROM v_event
  UNION ALL SELECT 'issue_over_200_hours', count(*) FILTER (WHERE resolution_time_hours > 200) FROM v_event
  UNION ALL SELECT 'duplicate_rows', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM v_event GROUP BY user_id, category)
  UNION ALL SELECT 'class_' || dimension || '_' || value, n FROM (
    SELECT 'category' AS dimension, category AS value, count(*) AS n FROM v_event WHERE category IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'customer_sentiment', customer_sentiment, count(*) FROM v_event WHERE customer_sentiment IS NOT NULL GROUP BY ALL))"""))
def dq_events(spark, sf):
    """rows, nulls, duplicates, issue rules (negative times among them) and the class distributions."""
    e = v_event(spark, sf)
    hours = F.col("resolution_time_hours")
    report = Q.dq_report(e, ["resolution_time_hours"], ["user_id", "category"], {"negative_resolution_time": hours < 0, "over_200_hours": hours > 200})
    classes = G.unpivot_counts(e, ["category", "customer_sentiment"])
    return report.unionByName(classes.select(F.concat_ws("_", F.lit("class"), "dimension", "value").alias("metric"), F.col("n").alias("value")))


@query("dup_array_rows", """SELECT count(*) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (
  SELECT words, lang, count(*) AS n FROM (SELECT string_split(text, ' ') AS words, lang FROM documents) GROUP BY words, lang)""")
def dup_array_rows(spark, sf):
    """Duplicates of rows with an array column, which counts as its JSON text; ``rows`` are the distinct ones."""
    d = table(spark, sf, "documents").select(F.split("text", " ").alias("words"), "lang")
    keys = d.groupBy(Q.row_digest(d, ["words", "lang"]).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


@query("current_values", S.with_views("""
SELECT dimension, value, count(*) AS n, round(sum(coalesce(resolution_time_hours, 0)), 4) AS time_sum, CAST(sum(CASE WHEN coalesce(resolution_helpful, false) THEN 1 ELSE 0 END) AS BIGINT) AS helpful_sum FROM (
  SELECT 'category' AS dimension, coalesce(category, 'unknown') AS value, resolution_time_hours, resolution_helpful FROM v_event
  UNION ALL SELECT 'product', coalesce(product, 'unknown'), resolution_time_hours, resolution_helpful FROM v_event
  UNION ALL SELECT 'customer_sentiment', coalesce(customer_sentiment, 'unknown'), resolution_time_hours, resolution_helpful FROM v_event) GROUP BY dimension, value"""))
def current_values(spark, sf):
    """The period's counters with the sums of the values that the reference lists (times, helpful marks)."""
    return G.unpivot_values(v_event(spark, sf), ["category", "product", "customer_sentiment"], "resolution_time_hours", "resolution_helpful")


@query("anomaly_sentiment_daily", S.with_views("""
SELECT product, week, total, negative, negative_share, rolling_mean, rolling_std,
       coalesce(weeks >= 4 AND rolling_std > 0 AND abs(negative_share - rolling_mean) > 2 * rolling_std, false) AS is_anomaly, weeks >= 4 AS enough_data
FROM (SELECT *, count(*) OVER (PARTITION BY product) AS weeks,
  CASE WHEN count(negative_share) OVER w = 8 THEN avg(negative_share) OVER w END AS rolling_mean,
  CASE WHEN count(negative_share) OVER w = 8 THEN stddev_samp(negative_share) OVER w END AS rolling_std
  FROM (SELECT product, strftime(date_trunc('day', created_at), '%Y-%m-%d') AS week, count(*) AS total, count(*) FILTER (WHERE customer_sentiment = 'negative') AS negative,
          count(*) FILTER (WHERE customer_sentiment = 'negative') / count(*) AS negative_share FROM v_event GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY product ORDER BY week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""))
def anomaly_sentiment_daily(spark, sf):
    """A7 by day over eight days: a window of n periods can flag only if (n - 1) / sqrt(n) > 2, so of six and more."""
    return A.sentiment_shift(v_event(spark, sf), window_size=8, period="day")


@query("retrieval_failures_events", S.with_views("""
SELECT category, count(*) AS tickets, avg(CAST(resolution_helpful AS DOUBLE)) AS success_rate,
       count(*) > 100 AND avg(CAST(resolution_helpful AS DOUBLE)) < 0.75 AS is_anomaly, count(*) > 100 AS enough_data
FROM v_event GROUP BY category"""))
def retrieval_failures_events(spark, sf):
    """A9 on the event tickets, whose categories differ in success."""
    return A.retrieval_failures(v_event(spark, sf), "category", F.col("resolution_helpful").cast("double"))


def _cleaned_sql() -> str:
    cfg = CONFIGS["fast"]
    docs = f"fdocs AS (SELECT id AS doc_id, {_clean('subject')} || ' ' || {_clean('description')} || ' ' AS text FROM v_text)"
    q = f"q AS (SELECT item_id AS query_id, {_clean('text')} AS q_text FROM benchmark)"
    return S.with_views("SELECT query_id, doc_id, round(sum(qw * weight), 6) AS keyword_score FROM fx_qv JOIN fx_w USING (term) GROUP BY query_id, doc_id",
                        docs, q, *S.tfidf_ctes("fx", "fdocs", "doc_id", "text", cfg), *S.query_vec_cte("fx", "q", cfg))


@query("search_cleaned", _cleaned_sql())
def search_cleaned(spark, sf):
    """The keyword channel of an index whose texts and queries go through a cleaner that the caller gives."""
    idx = R.build_index(v_text(spark, sf), "fast", clean=T.clean_text)
    kw = R.keyword_scores(idx, R.prepare_queries(benchmark_queries(spark, sf), T.clean_text))
    return kw.select("query_id", "doc_id", R.r6(F.col("keyword_score")).alias("keyword_score"))
