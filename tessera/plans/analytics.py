"""Aggregation, window and anomaly queries over the event and order views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as G
from tessera.operators import anomaly as A
from tessera.operators import windows as W
from tessera.plans.registry import query
from tessera.plans.sqlparts import with_views
from tessera.sources.tables import v_event, v_order, v_text

HOUR = "yyyy-MM-dd HH"
SQL_HOUR = "strftime(created_at, '%Y-%m-%d %H')"
TS_FMT = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "'%Y-%m-%d %H:%M:%S'"


def _hour(df):
    return df.withColumn("hour", F.date_format("created_at", HOUR))


# ---------------------------------------------------------------- G1, G2, G3, A1
@query("value_counts", with_views("""
SELECT dimension, value, count(*) AS n FROM (
  SELECT 'category' AS dimension, category AS value FROM v_event
  UNION ALL SELECT 'product', product FROM v_event
  UNION ALL SELECT 'customer_sentiment', customer_sentiment FROM v_event
  UNION ALL SELECT 'agent_id', agent_id FROM v_event) WHERE value IS NOT NULL GROUP BY dimension, value"""))
def value_counts(spark, sf):
    return G.unpivot_counts(v_event(spark, sf), ["category", "product", "customer_sentiment", "agent_id"])


@query("baseline_scalars", with_views("""
SELECT count(*) AS total_tickets, avg(resolution_time_hours) AS avg_resolution_time,
       avg(CAST(resolution_helpful AS DOUBLE)) AS success_rate FROM v_event"""))
def baseline_scalars(spark, sf):
    return G.scalar_stats(v_event(spark, sf))


@query("current_stats", with_views("""
SELECT dimension, value, count(*) AS n FROM (
  SELECT 'priority' AS dimension, coalesce(priority, 'unknown') AS value FROM v_order
  UNION ALL SELECT 'product', coalesce(product, 'unknown') FROM v_order
  UNION ALL SELECT 'status', coalesce(status, 'unknown') FROM v_order) GROUP BY dimension, value"""))
def current_stats(spark, sf):
    return G.unpivot_counts(v_order(spark, sf), ["priority", "product", "status"], unknown="unknown")


@query("baseline_stats", with_views("""
, base AS (SELECT * FROM v_event WHERE created_at >= (SELECT max(created_at) FROM v_event) - INTERVAL 30 DAYS)
SELECT d.dimension, d.value, d.n, s.total_tickets, s.avg_resolution_time, s.success_rate FROM (
  SELECT dimension, value, count(*) AS n FROM (
    SELECT 'category' AS dimension, category AS value FROM base
    UNION ALL SELECT 'customer_sentiment', customer_sentiment FROM base
    UNION ALL SELECT 'product', product FROM base) WHERE value IS NOT NULL GROUP BY dimension, value) d,
  (SELECT count(*) AS total_tickets, avg(resolution_time_hours) AS avg_resolution_time,
          avg(CAST(resolution_helpful AS DOUBLE)) AS success_rate FROM base) s""".replace("\n, base AS", "", 0)))
def baseline_stats(spark, sf):
    base = G.recent_window(v_event(spark, sf), "created_at", 30)
    dist = G.unpivot_counts(base, ["category", "customer_sentiment", "product"])
    return dist.crossJoin(F.broadcast(G.scalar_stats(base)))  # one-row side


# ---------------------------------------------------------------- F7
@query("recent_window", with_views(f"""
SELECT id, strftime(created_at, {SQL_TS}) AS created_at, priority, product FROM v_order
WHERE created_at >= (SELECT max(created_at) FROM v_order) - INTERVAL 30 DAYS"""))
def recent_window_q(spark, sf):
    r = G.recent_window(v_order(spark, sf), "created_at", 30)
    return r.select("id", F.date_format("created_at", TS_FMT).alias("created_at"), "priority", "product")


# ---------------------------------------------------------------- G4, G5
DAILY_SQL = "SELECT strftime(created_at, '%Y-%m-%d') AS date, category, count(*) AS n FROM v_event GROUP BY 1, 2"


@query("daily_counts", with_views(DAILY_SQL))
def daily_counts(spark, sf):
    return G.daily_counts(v_event(spark, sf), "created_at", "category")


@query("daily_stats", with_views(f"""
SELECT category, round_even(avg(n), 2) AS mean, round_even(stddev_samp(n), 2) AS std, count(*) AS days
FROM ({DAILY_SQL}) GROUP BY category"""))
def daily_stats(spark, sf):
    return G.daily_stats(G.daily_counts(v_event(spark, sf), "created_at", "category"), "category")


# ---------------------------------------------------------------- G6, G7, G8
@query("product_features", with_views("""
SELECT s.product, resolution_time_mean, resolution_time_std, satisfaction_mean, satisfaction_std, escalation_rate, n,
       category_counts FROM (
  SELECT product, avg(resolution_time_hours) AS resolution_time_mean, stddev_samp(resolution_time_hours) AS resolution_time_std,
         avg(satisfaction_score) AS satisfaction_mean, stddev_samp(satisfaction_score) AS satisfaction_std,
         avg(CAST(escalated AS DOUBLE)) AS escalation_rate, count(*) AS n FROM v_event GROUP BY product) s
JOIN (SELECT product, string_agg(category || ':' || CAST(c AS VARCHAR), ',' ORDER BY category) AS category_counts
      FROM (SELECT product, category, count(*) AS c FROM v_event GROUP BY 1, 2) GROUP BY product) h
  ON s.product = h.product"""))
def product_features(spark, sf):
    return G.product_features(v_event(spark, sf))


@query("business_metrics", with_views("""
SELECT CASE WHEN GROUPING(category, product, agent_id) = 7 THEN 'all'
            WHEN GROUPING(category, product, agent_id) = 3 THEN 'category'
            WHEN GROUPING(category, product, agent_id) = 5 THEN 'product' ELSE 'agent' END AS level,
       coalesce(category, product, agent_id) AS key, count(*) AS n,
       avg(resolution_time_hours) AS avg_resolution_time, avg(satisfaction_score) AS avg_satisfaction,
       avg(CAST(escalated AS DOUBLE)) AS escalation_rate
FROM v_event GROUP BY GROUPING SETS ((), (category), (product), (agent_id))"""))
def business_metrics(spark, sf):
    return G.business_metrics(v_event(spark, sf))


SENTIMENTS = ["negative", "neutral", "positive"]


@query("pivot_sentiment", with_views("""
SELECT strftime(created_at, '%Y-%m-%d') AS date,
       count(*) FILTER (WHERE customer_sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE customer_sentiment = 'neutral') AS neutral,
       count(*) FILTER (WHERE customer_sentiment = 'positive') AS positive
FROM v_event GROUP BY 1"""))
def pivot_sentiment(spark, sf):
    ev = v_event(spark, sf).withColumn("date", F.date_format("created_at", "yyyy-MM-dd"))
    return G.pivot_counts(ev, ["date"], "customer_sentiment", SENTIMENTS)


# ---------------------------------------------------------------- G9, W1, A7
WEEKLY_SQL = """SELECT product, strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week, count(*) AS total,
       count(*) FILTER (WHERE customer_sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE customer_sentiment = 'negative') / count(*) AS negative_share
FROM v_event GROUP BY 1, 2"""


@query("weekly_sentiment", with_views(WEEKLY_SQL))
def weekly_sentiment(spark, sf):
    return A.sentiment_shift(v_event(spark, sf), min_weeks=0).select("product", "week", "total", "negative",
                                                                       "negative_share")


@query("rolling_sentiment", with_views(f"""
SELECT product, week, negative_share,
  CASE WHEN count(negative_share) OVER w = 2 THEN avg(negative_share) OVER w END AS rolling_mean,
  CASE WHEN count(negative_share) OVER w = 2 THEN stddev_samp(negative_share) OVER w END AS rolling_std
FROM ({WEEKLY_SQL}) WINDOW w AS (PARTITION BY product ORDER BY week ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"""))
def rolling_sentiment(spark, sf):
    weekly = A.sentiment_shift(v_event(spark, sf), min_weeks=0).select("product", "week", "negative_share")
    return W.rolling_stats(weekly, "product", "week", "negative_share", 2)


@query("anomaly_sentiment_shift", with_views(f"""
SELECT product, week, total, negative, negative_share, rolling_mean, rolling_std,
       coalesce(weeks >= 4 AND rolling_std > 0 AND abs(negative_share - rolling_mean) > 2 * rolling_std, false) AS is_anomaly,
       weeks >= 4 AS enough_data
FROM (SELECT *, count(*) OVER (PARTITION BY product) AS weeks,
  CASE WHEN count(negative_share) OVER w = 2 THEN avg(negative_share) OVER w END AS rolling_mean,
  CASE WHEN count(negative_share) OVER w = 2 THEN stddev_samp(negative_share) OVER w END AS rolling_std
  FROM ({WEEKLY_SQL}) WINDOW w AS (PARTITION BY product ORDER BY week ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))"""))
def anomaly_sentiment_shift(spark, sf):
    return A.sentiment_shift(v_event(spark, sf))


# ---------------------------------------------------------------- G10, G11, G19, G18
@query("dup_rows", """
SELECT count(*) AS distinct_rows, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT text, lang, source, count(*) AS n FROM documents GROUP BY ALL)""")
def dup_rows(spark, sf):
    from tessera.sources.tables import table
    return G.duplicate_count(table(spark, sf, "documents"), ["text", "lang", "source"])


@query("class_weights", with_views("""
SELECT category, n, (mx / n) / sum(n * (mx / n)) OVER () * sum(n) OVER () AS weight FROM (
  SELECT category, count(*) AS n, max(count(*)) OVER () AS mx FROM v_text GROUP BY category)"""))
def class_weights(spark, sf):
    return G.class_weights(v_text(spark, sf), "category")


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query("duration_histogram", with_views(
    "SELECT le, n FROM (" + " UNION ALL ".join(
        f"SELECT '{b}' AS le, count(*) FILTER (WHERE resolution_time_hours <= {b}) AS n FROM v_event" for b in BOUNDS)
    + " UNION ALL SELECT '+Inf', count(resolution_time_hours) FROM v_event)"))
def duration_histogram(spark, sf):
    return G.cumulative_histogram(v_event(spark, sf), "resolution_time_hours", BOUNDS)


@query("kpi_counters", with_views("""
SELECT CASE WHEN GROUPING(priority, product, status) = 7 THEN 'total'
            WHEN GROUPING(priority, product, status) = 3 THEN 'priority'
            WHEN GROUPING(priority, product, status) = 5 THEN 'product' ELSE 'status' END AS label,
       coalesce(priority, product, status) AS value, count(*) AS n
FROM v_order GROUP BY GROUPING SETS ((), (priority), (product), (status))"""))
def kpi_counters(spark, sf):
    o = v_order(spark, sf)
    g = o.groupingSets([[], [F.col("priority")], [F.col("product")], [F.col("status")]],
                       F.col("priority"), F.col("product"), F.col("status")).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n"))
    label = (F.when(F.col("_gid") == 7, "total").when(F.col("_gid") == 3, "priority")
             .when(F.col("_gid") == 5, "product").otherwise("status"))
    return g.select(label.alias("label"), F.coalesce("priority", "product", "status").alias("value"), "n")


# ---------------------------------------------------------------- W2, W3, A6, W7
@query("share_of_total", with_views("""
SELECT category, n, n / sum(n) OVER () AS share FROM (SELECT category, count(*) AS n FROM v_event GROUP BY 1)"""))
def share_of_total(spark, sf):
    c = v_event(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return W.share_of_total(c, [], "n")


def _band_sql(view: str, key: str) -> str:
    return with_views(f"""
SELECT date, {key}, n, mean, std, lower, upper, coalesce(n > upper OR n < lower, false) AS is_anomaly FROM (
  SELECT *, greatest(0.0, mean - 2.0 * std) AS lower, mean + 2.0 * std AS upper FROM (
    SELECT *, avg(n) OVER (PARTITION BY {key}) AS mean, stddev_samp(n) OVER (PARTITION BY {key}) AS std FROM (
      SELECT strftime(created_at, '%Y-%m-%d') AS date, {key}, count(*) AS n FROM {view} GROUP BY 1, 2)))""")


@query("anomaly_volume", _band_sql("v_event", "category"))
def anomaly_volume(spark, sf):
    return A.volume_anomalies(v_event(spark, sf), "created_at", "category")


@query("volume_band", _band_sql("v_order", "priority"))
def volume_band(spark, sf):
    return A.volume_anomalies(v_order(spark, sf), "created_at", "priority")


@query("concurrency_sweep", with_views(f"""
, ev AS (SELECT category, created_at AS ts, 1 AS d FROM v_event
         UNION ALL SELECT category, created_at + to_seconds(CAST(round(resolution_time_hours * 3600) AS BIGINT)), -1
         FROM v_event)
SELECT category, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, delta,
       sum(delta) OVER (PARTITION BY category ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_progress
FROM (SELECT category, ts, sum(d) AS delta FROM ev GROUP BY 1, 2)""".replace("\n, ev AS", "", 0)))
def concurrency_sweep(spark, sf):
    ev = v_event(spark, sf).select(
        "category", "created_at",
        F.expr("created_at + make_dt_interval(0, 0, 0, CAST(round(resolution_time_hours * 3600) AS DECIMAL(18, 0)))")
        .alias("ended_at"))
    c = W.concurrency(ev, "category", "created_at", "ended_at")
    return c.select("category", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                    F.col("delta").cast("long").alias("delta"), F.col("in_progress").cast("long").alias("in_progress"))


# ---------------------------------------------------------------- A2-A5, A9, A10
BASE_SQL = "(SELECT * FROM v_event WHERE created_at >= (SELECT max(created_at) FROM v_event) - INTERVAL 30 DAYS)"


def _share_sql(dim: str, kind: str, text: str) -> str:
    return with_views(f"""
SELECT '{kind}' AS type, c.period, c.value AS key, b.base_rate AS baseline, c.cur_n / c.ct AS current,
       (c.cur_n / c.ct) / b.base_rate AS anomaly_score,
       ((c.cur_n / c.ct) / b.base_rate > 2.0 OR (c.cur_n / c.ct) / b.base_rate < 0.5) AS is_anomaly, true AS enough_data,
       printf('{text}', c.value, b.base_rate, c.cur_n / c.ct) AS description
FROM (SELECT period, value, cur_n, sum(cur_n) OVER (PARTITION BY period) AS ct FROM (
        SELECT {SQL_HOUR} AS period, coalesce({dim}, 'unknown') AS value, count(*) AS cur_n FROM v_event GROUP BY 1, 2)) c
JOIN (SELECT value, base_n / sum(base_n) OVER () AS base_rate FROM (
        SELECT {dim} AS value, count(*) AS base_n FROM {BASE_SQL} WHERE {dim} IS NOT NULL GROUP BY 1)) b
  ON c.value = b.value WHERE b.base_rate > 0""")


@query("anomaly_category", _share_sql("category", "category_volume_anomaly",
                                      "Unusual volume for category ''%s'': baseline rate %.4f, current rate %.4f"))
def anomaly_category(spark, sf):
    ev = _hour(v_event(spark, sf))
    return A.share_ratio(ev, A.recent_window(ev, "created_at", 30), "category", ["hour"])


@query("anomaly_sentiment", _share_sql("customer_sentiment", "sentiment_shift_anomaly",
                                       "Sentiment shift for ''%s'': baseline rate %.4f, current rate %.4f"))
def anomaly_sentiment(spark, sf):
    ev = _hour(v_event(spark, sf))
    return A.share_ratio(ev, A.recent_window(ev, "created_at", 30), "customer_sentiment", ["hour"],
                         kind="sentiment_shift_anomaly", label="sentiment")


RES_SQL = f"""
SELECT 'resolution_time_anomaly' AS type, c.period, 'resolution_time_hours' AS key, b.base AS baseline, c.cur AS current,
       abs(c.cur - b.base) / b.base AS anomaly_score, coalesce(c.n >= 10 AND b.base > 0 AND abs(c.cur - b.base) / b.base > 2.0, false) AS is_anomaly,
       c.n >= 10 AND coalesce(b.base, 0) > 0 AS enough_data,
       printf('Resolution time anomaly: baseline avg %.2f hours, current avg %.2f hours', b.base, c.cur) AS description
FROM (SELECT {{period}} AS period, count(*) AS n, avg(coalesce(resolution_time_hours, 0.0)) AS cur FROM v_event GROUP BY 1) c,
     (SELECT avg(resolution_time_hours) AS base FROM {BASE_SQL}) b"""

SUCC_SQL = f"""
SELECT 'success_rate_anomaly' AS type, c.period, 'resolution_helpful' AS key, b.base AS baseline, c.cur AS current,
       abs(c.cur - b.base) AS anomaly_score, c.n >= 10 AND abs(c.cur - b.base) > 0.1 AS is_anomaly, c.n >= 10 AS enough_data,
       printf('Success rate anomaly: baseline %.4f, current %.4f', b.base, c.cur) AS description
FROM (SELECT {{period}} AS period, count(*) AS n,
             avg(CAST(coalesce(resolution_helpful, false) AS DOUBLE)) AS cur FROM v_event GROUP BY 1) c,
     (SELECT avg(CAST(resolution_helpful AS DOUBLE)) AS base FROM {BASE_SQL}) b"""


@query("anomaly_resolution", with_views(RES_SQL.format(period=SQL_HOUR)))
def anomaly_resolution(spark, sf):
    ev = _hour(v_event(spark, sf))
    return A.mean_deviation(ev, A.recent_window(ev, "created_at", 30), ["hour"])


@query("anomaly_success", with_views(SUCC_SQL.format(period=SQL_HOUR)))
def anomaly_success(spark, sf):
    ev = _hour(v_event(spark, sf))
    return A.rate_difference(ev, A.recent_window(ev, "created_at", 30), ["hour"])


def _all_sql() -> str:
    day = "strftime(created_at, '%Y-%m-%d')"
    parts = [
        _share_sql("category", "category_volume_anomaly",
                   "Unusual volume for category ''%s'': baseline rate %.4f, current rate %.4f"),
        _share_sql("customer_sentiment", "sentiment_shift_anomaly",
                   "Sentiment shift for ''%s'': baseline rate %.4f, current rate %.4f"),
        with_views(RES_SQL.format(period=day)),
        with_views(SUCC_SQL.format(period=day)),
    ]
    parts = [p.replace(SQL_HOUR, day) for p in parts]
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@query("anomaly_all", _all_sql())
def anomaly_all(spark, sf):
    ev = v_event(spark, sf).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return A.detect_all(ev, ev, ["day"])


@query("retrieval_failures", with_views("""
SELECT category, count(*) AS tickets, avg(CAST(resolution_helpful AS DOUBLE)) AS success_rate,
       count(*) > 100 AND avg(CAST(resolution_helpful AS DOUBLE)) < 0.75 AS is_anomaly, count(*) > 100 AS enough_data
FROM v_text GROUP BY category"""))
def retrieval_failures(spark, sf):
    return A.retrieval_failures(v_text(spark, sf), "category", F.col("resolution_helpful").cast("double"))
