"""Aggregations (G1-G19) as grouped DataFrame plans.

All of them use hash aggregation with map-side partial aggregation, so a hot key (one category
holding a third of the rows) is pre-combined in every task before the shuffle. Where a result
needs a per-group list (a category histogram), it is built from an already aggregated table
whose group size is bounded by the number of distinct values, never from raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_counts(df: DataFrame, dims: Sequence[str], unknown: str | None = None) -> DataFrame:
    """(dimension, value, n) for several columns in one pass.

    Nulls are dropped (value counts) unless ``unknown`` names the default they map to (current
    counters). The unpivot is a per-row ``explode`` of a small array, so one scan feeds all dims.
    """
    pairs = F.array(*[
        F.struct(F.lit(d).alias("dimension"),
                 (F.coalesce(F.col(d).cast("string"), F.lit(unknown)) if unknown is not None
                  else F.col(d).cast("string")).alias("value"))
        for d in dims
    ])
    x = df.select(F.explode(pairs).alias("p")).select("p.dimension", "p.value")
    if unknown is None:
        x = x.where(F.col("value").isNotNull())
    return x.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def unpivot_values(df: DataFrame, dims: Sequence[str], time_col: str, helpful_col: str, unknown: str = "unknown") -> DataFrame:
    """(dimension, value, n, time_sum, helpful_sum) in one pass: the sums stand for the lists of values that grow with the
    period. Missing values are ``unknown``, 0 and false."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(unknown)).alias("value")) for d in dims])
    x = df.select(F.explode(pairs).alias("p"), F.coalesce(F.col(time_col).cast("double"), F.lit(0.0)).alias("t"), F.coalesce(F.col(helpful_col), F.lit(False)).cast("long").alias("h"))
    return x.groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("t"), 4).alias("time_sum"), F.sum("h").alias("helpful_sum"))


def scalar_stats(df: DataFrame, time_col: str = "resolution_time_hours", helpful_col: str = "resolution_helpful",
                 defaults: bool = False) -> DataFrame:
    """One row (total_tickets, avg_resolution_time, success_rate).

    ``defaults`` applies the current-period defaults (missing time 0, missing helpful false, T11).
    """
    t, h = F.col(time_col), F.col(helpful_col)
    if defaults:
        t, h = F.coalesce(t, F.lit(0.0)), F.coalesce(h, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.avg(t).alias("avg_resolution_time"),
        F.avg(h.cast("double")).alias("success_rate"),
    )


def recent_window(df: DataFrame, ts_col: str = "created_at", days: int = 30) -> DataFrame:
    """rows with ts >= max(ts) - days (inclusive); the max is a one-row aggregate."""
    mx = df.agg(F.max(ts_col).alias("_max_ts"))
    return (
        df.crossJoin(F.broadcast(mx))  # one row
        .where(F.col(ts_col) >= F.col("_max_ts") - F.expr(f"INTERVAL {int(days)} DAYS"))
        .drop("_max_ts")
    )


def day_string(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def daily_counts(df: DataFrame, ts_col: str, key: str) -> DataFrame:
    """(date, key, n)."""
    return df.groupBy(day_string(F.col(ts_col)).alias("date"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))


def daily_stats(daily: DataFrame, key: str) -> DataFrame:
    """Mean / sample std / count of daily counts per key, rounded half-even to 2 decimals."""
    return daily.groupBy(key).agg(
        F.bround(F.avg("n"), 2).alias("mean"),
        F.bround(F.stddev_samp("n"), 2).alias("std"),
        F.count(F.lit(1)).alias("days"),
    )


def histogram_text(df: DataFrame, group: str, key: str, out: str) -> DataFrame:
    """Per-group value counts rendered as 'value:n,...' sorted by value (a map's text form).

    The list is built from the (group, value) count table, so its length is the number of
    distinct values of ``key`` in the group.
    """
    counts = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col("_n").alias("n")))),
                        lambda s: F.concat(s["k"], F.lit(":"), s["n"].cast("string"))),
            ",",
        ).alias(out)
    )


def product_features(df: DataFrame) -> DataFrame:
    """Batch feature row per product."""
    stats = df.groupBy("product").agg(
        F.avg("resolution_time_hours").alias("resolution_time_mean"),
        F.stddev_samp("resolution_time_hours").alias("resolution_time_std"),
        F.avg("satisfaction_score").alias("satisfaction_mean"),
        F.stddev_samp("satisfaction_score").alias("satisfaction_std"),
        F.avg(F.col("escalated").cast("double")).alias("escalation_rate"),
        F.count(F.lit(1)).alias("n"),
    )
    return stats.join(histogram_text(df, "product", "category", "category_counts"), "product")


def business_metrics(df: DataFrame) -> DataFrame:
    """Global means, counts per category, mean time per product, mean satisfaction per agent,
    as one grouping-sets aggregate: (level, key, n, avg_resolution_time, avg_satisfaction,
    escalation_rate)."""
    g = df.groupingSets(
        [[], [F.col("category")], [F.col("product")], [F.col("agent_id")]],
        F.col("category"), F.col("product"), F.col("agent_id"),
    ).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("n"),
        F.avg("resolution_time_hours").alias("avg_resolution_time"),
        F.avg("satisfaction_score").alias("avg_satisfaction"),
        F.avg(F.col("escalated").cast("double")).alias("escalation_rate"),
    )
    level = (F.when(F.col("_gid") == 7, "all").when(F.col("_gid") == 3, "category")
             .when(F.col("_gid") == 5, "product").otherwise("agent"))
    key = F.coalesce(F.col("category"), F.col("product"), F.col("agent_id"))
    return g.select(level.alias("level"), key.alias("key"), "n", "avg_resolution_time", "avg_satisfaction",
                    "escalation_rate")


def pivot_counts(df: DataFrame, rows: Sequence[Column | str], col: str, values: Sequence[str]) -> DataFrame:
    """Counts pivoted on ``col`` with the given (fixed) values, missing = 0."""
    p = df.groupBy(*rows).pivot(col, list(values)).count()
    return p.na.fill(0, subset=list(values))


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact duplicate rows = sum(n - 1) over identical rows, grouped by a digest of the row."""
    from tessera.operators.quality import row_digest

    g = df.groupBy(row_digest(df, cols).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.count(F.lit(1)).alias("distinct_rows"),
                 F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights normalised so the per-sample weights average 1:
    w_c = (max_n / n_c) / sum_samples(max_n / n_y) * N = N / (K * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.sum("n").alias("_N"), F.count(F.lit(1)).alias("_K"))
    return counts.crossJoin(F.broadcast(tot)).select(  # one-row side
        label, "n", (F.col("_N") / (F.col("_K") * F.col("n"))).alias("weight"))


def cumulative_histogram(df: DataFrame, col: str, bounds: Sequence[float]) -> DataFrame:
    """Prometheus-style cumulative buckets (le, n) including +Inf, one pass."""
    aggs = [F.count_if(F.col(col) <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(F.col(col)).alias("binf"))
    one = df.agg(*aggs)
    labels = [str(float(b)) for b in bounds] + ["+Inf"]
    cols = [f"b{i}" for i in range(len(bounds))] + ["binf"]
    stack = F.explode(F.array(*[F.struct(F.lit(lb).alias("le"), F.col(c).alias("n")) for lb, c in zip(labels, cols)]))
    return one.select(stack.alias("s")).select("s.le", "s.n")
