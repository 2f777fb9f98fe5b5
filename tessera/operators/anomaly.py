"""Anomaly detection (A1-A10) as DataFrame plans.

Each detector returns the *scored* rows with an ``is_anomaly`` flag (not only the hits), so an
empty result can be told apart from a detector that never ran. Current-period statistics are
aggregates over a batch (optionally per period key, e.g. per hour); baselines are small tables
(one row per dimension value, or one row of scalars) joined back, which keeps every detector a
few hash aggregates and broadcast joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numfmt import format_fixed
from tessera.operators.aggregates import recent_window, scalar_stats

ANOMALY_COLUMNS = ["type", "period", "key", "baseline", "current", "anomaly_score", "is_anomaly", "enough_data", "description"]


def baseline_distribution(baseline: DataFrame, dim: str) -> DataFrame:
    """(value, base_n, base_rate) of one dimension; nulls dropped (pandas value counts)."""
    c = baseline.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("base_n"))
    tot = c.agg(F.sum("base_n").alias("_bt"))
    return c.crossJoin(F.broadcast(tot)).select("value", "base_n", (F.col("base_n") / F.col("_bt")).alias("base_rate"))


def share_ratio(current: DataFrame, baseline: DataFrame, dim: str, period: Sequence[str] = (),
                threshold: float = 2.0, kind: str = "category_volume_anomaly", label: str = "category") -> DataFrame:
    """A2 / A3: per (period, value) share of the current batch vs share in the baseline.

    ratio = current_rate / baseline_rate; anomaly when ratio > threshold or < 1/threshold.
    Missing values count as 'unknown' in the current batch (T11); values absent from the
    baseline are skipped (J6 inner side).
    """
    cur = current.groupBy(*period, F.coalesce(F.col(dim), F.lit("unknown")).alias("value")).agg(
        F.count(F.lit(1)).alias("cur_n"))
    tot = cur.groupBy(*period).agg(F.sum("cur_n").alias("_ct"))
    cur = cur.join(tot, list(period)) if period else cur.crossJoin(F.broadcast(tot))
    base = baseline_distribution(baseline, dim)
    x = cur.join(base, "value").where(F.col("base_rate") > 0)
    rate = F.col("cur_n") / F.col("_ct")
    ratio = rate / F.col("base_rate")
    desc = format_fixed(
        ("Unusual volume for category '{}': baseline rate {}, current rate {}" if label == "category"
         else "Sentiment shift for '{}': baseline rate {}, current rate {}"),
        F.col("value"), (F.col("base_rate"), 4), (rate, 4))
    return x.select(
        F.lit(kind).alias("type"),
        (F.concat_ws("|", *[F.col(p).cast("string") for p in period]) if period else F.lit("")).alias("period"),
        F.col("value").alias("key"),
        F.col("base_rate").alias("baseline"),
        rate.alias("current"),
        ratio.alias("anomaly_score"),
        ((ratio > threshold) | (ratio < 1.0 / threshold)).alias("is_anomaly"),
        F.lit(True).alias("enough_data"),
        desc.alias("description"),
    )


def mean_deviation(current: DataFrame, baseline: DataFrame, period: Sequence[str] = (), threshold: float = 2.0,
                   min_rows: int = 10) -> DataFrame:
    """A4: relative deviation |cur - base| / base of the mean resolution time (the reference calls
    it a z-score, T13); rows under ``min_rows`` or without a
    positive baseline stay, with ``enough_data`` false and no flag."""
    b = scalar_stats(baseline).select(F.col("avg_resolution_time").alias("base"))
    c = current.groupBy(*period).agg(F.count(F.lit(1)).alias("_n"),
                                     F.avg(F.coalesce(F.col("resolution_time_hours"), F.lit(0.0))).alias("cur"))
    x = c.crossJoin(F.broadcast(b))  # one-row side
    enough = (F.col("_n") >= min_rows) & (F.coalesce(F.col("base"), F.lit(0.0)) > 0)
    score = F.abs(F.col("cur") - F.col("base")) / F.nullif(F.col("base"), F.lit(0.0))
    return x.select(
        F.lit("resolution_time_anomaly").alias("type"),
        (F.concat_ws("|", *[F.col(p).cast("string") for p in period]) if period else F.lit("")).alias("period"),
        F.lit("resolution_time_hours").alias("key"),
        F.col("base").alias("baseline"), F.col("cur").alias("current"), score.alias("anomaly_score"),
        F.coalesce(enough & (score > threshold), F.lit(False)).alias("is_anomaly"), enough.alias("enough_data"),
        format_fixed("Resolution time anomaly: baseline avg {} hours, current avg {} hours",
                     (F.col("base"), 2), (F.col("cur"), 2)).alias("description"),
    )


def rate_difference(current: DataFrame, baseline: DataFrame, period: Sequence[str] = (), threshold: float = 0.1,
                    min_rows: int = 10) -> DataFrame:
    """A5: |current success rate - baseline success rate| > threshold; under ``min_rows`` rows no flag."""
    b = scalar_stats(baseline).select(F.col("success_rate").alias("base"))
    c = current.groupBy(*period).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.coalesce(F.col("resolution_helpful"), F.lit(False)).cast("double")).alias("cur"))
    x = c.crossJoin(F.broadcast(b))  # one-row side
    enough = F.col("_n") >= min_rows
    score = F.abs(F.col("cur") - F.col("base"))
    return x.select(
        F.lit("success_rate_anomaly").alias("type"),
        (F.concat_ws("|", *[F.col(p).cast("string") for p in period]) if period else F.lit("")).alias("period"),
        F.lit("resolution_helpful").alias("key"),
        F.col("base").alias("baseline"), F.col("cur").alias("current"), score.alias("anomaly_score"),
        F.coalesce(enough & (score > threshold), F.lit(False)).alias("is_anomaly"), enough.alias("enough_data"),
        format_fixed("Success rate anomaly: baseline {}, current {}", (F.col("base"), 4),
                     (F.col("cur"), 4)).alias("description"),
    )


def detect_all(current: DataFrame, history: DataFrame, period: Sequence[str] = (), history_days: int = 30) -> DataFrame:
    """Baseline over the recency window of ``history`` (A1), then the four detectors
    on the current batch, unioned onto one anomaly schema."""
    base = recent_window(history, "created_at", history_days)
    parts = [
        share_ratio(current, base, "category", period),
        share_ratio(current, base, "customer_sentiment", period, kind="sentiment_shift_anomaly", label="sentiment"),
        mean_deviation(current, base, period),
        rate_difference(current, base, period),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*ANOMALY_COLUMNS)


def volume_anomalies(df: DataFrame, ts_col: str, key: str, k: float = 2.0) -> DataFrame:
    """Daily counts per key; flag days outside [max(0, mean - k sd), mean + k sd] of the key."""
    from tessera.operators.aggregates import daily_counts
    from tessera.operators.windows import band_flags

    return band_flags(daily_counts(df, ts_col, key), key, "n", k)


def sentiment_shift(df: DataFrame, ts_col: str = "created_at", product: str = "product",
                    sentiment: str = "customer_sentiment", negative: str = "negative", window_size: int = 2,
                    k: float = 2.0, min_weeks: int = 4, period: str = "week") -> DataFrame:
    """Weekly negative share per product; rolling mean / sample std over ``window_size``
    weeks (previous + current, T14); flag |share - mean| > k * std when std > 0; products with
    fewer than ``min_weeks`` weeks get no flag (``enough_data`` false). The week key is date_trunc('week') (T15);
    ``period`` takes another unit of date_trunc in its place."""
    wk = F.date_format(F.date_trunc(period, F.col(ts_col)), "yyyy-MM-dd")
    weekly = df.groupBy(F.col(product).alias("product"), wk.alias("week")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(sentiment) == negative).alias("negative"))
    weekly = weekly.select("*", (F.col("negative") / F.col("total")).alias("negative_share"))
    pw = Window.partitionBy("product")
    w = pw.orderBy("week").rowsBetween(-(window_size - 1), 0)
    full = F.count("negative_share").over(w) == window_size
    x = weekly.select(
        "*",
        F.count(F.lit(1)).over(pw).alias("weeks"),
        F.when(full, F.avg("negative_share").over(w)).alias("rolling_mean"),
        F.when(full, F.stddev_samp("negative_share").over(w)).alias("rolling_std"),
    )
    enough = F.col("weeks") >= min_weeks
    flag = enough & (F.col("rolling_std") > 0) & (F.abs(F.col("negative_share") - F.col("rolling_mean")) > k * F.col("rolling_std"))
    return x.select("product", "week", "total", "negative", "negative_share", "rolling_mean", "rolling_std",
                    F.coalesce(flag, F.lit(False)).alias("is_anomaly"), enough.alias("enough_data"))


def retrieval_failures(log: DataFrame, category: str = "category", success: Column | None = None,
                       min_tickets: int = 100, threshold: float = 0.75) -> DataFrame:
    """Per category the success rate from a retrieval log; flagged below ``threshold`` where there
    are more than ``min_tickets`` rows (the reference draws a random number here, T17)."""
    s = success if success is not None else F.col("success").cast("double")
    g = log.groupBy(category).agg(F.count(F.lit(1)).alias("tickets"), F.avg(s).alias("success_rate"))
    enough = F.col("tickets") > min_tickets
    return g.select("*", F.coalesce(enough & (F.col("success_rate") < threshold), F.lit(False)).alias("is_anomaly"), enough.alias("enough_data"))
