"""Window operators.

Windows partitioned by a key are used only on already aggregated tables (one row per key and
period), never on raw rows, so a partition's size is the number of periods, not of tickets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_stats(df: DataFrame, key: str, order: str, col: str, size: int = 2) -> DataFrame:
    """Rolling mean and sample std over the previous ``size - 1`` rows and the current one;
    null until the window is full (pandas ``rolling(size)``)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(size - 1), 0)
    full = F.count(F.col(col)).over(w) == size
    return df.select(
        "*",
        F.when(full, F.avg(col).over(w)).alias("rolling_mean"),
        F.when(full, F.stddev_samp(col).over(w)).alias("rolling_std"),
    )


def band_flags(df: DataFrame, key: str, col: str, k: float = 2.0) -> DataFrame:
    """Group mean and sample std beside each row; outside [max(0, mean - k sd), mean + k sd]
    flags an anomaly."""
    w = Window.partitionBy(key)
    mean, sd = F.avg(col).over(w), F.stddev_samp(col).over(w)
    x = df.select("*", mean.alias("mean"), sd.alias("std"))
    lower = F.greatest(F.lit(0.0), F.col("mean") - k * F.col("std"))
    upper = F.col("mean") + k * F.col("std")
    return x.select("*", lower.alias("lower"), upper.alias("upper"),
                    F.coalesce((F.col(col) > upper) | (F.col(col) < lower), F.lit(False)).alias("is_anomaly"))


def share_of_total(df: DataFrame, part: Sequence[str], col: str = "n", out: str = "share") -> DataFrame:
    """Value / sum(value) over the partition."""
    w = Window.partitionBy(*part)
    return df.select("*", (F.col(col) / F.sum(col).over(w)).alias(out))


def concurrency(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """In-progress gauge. +1 at each start, -1 at each end, running sum per key in time order.

    A running sum over one window per key would put a hot key in one task, so it is a prefix sum in
    two levels: rows are range-partitioned by (key, time) into ranges of like size, running sums are
    taken inside each (range, key), and the totals of a key's earlier ranges (one row per range and
    key) are added.
    """
    ev = df.select(F.col(key), F.col(start).alias("ts"), F.lit(1).alias("d")).unionByName(
        df.select(F.col(key), F.col(end).alias("ts"), F.lit(-1).alias("d")))
    per_ts = (ev.where(F.col("ts").isNotNull()).groupBy(key, "ts").agg(F.sum("d").alias("delta"))
              )
    # range number = partition number; persisted, so that both branches see the same ranges
    per_ts = per_ts.repartitionByRange(key, "ts").withColumn("_b", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    local = per_ts.select("*", F.sum("delta").over(
        Window.partitionBy(key, "_b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)).alias("_local"))
    totals = per_ts.groupBy(key, "_b").agg(F.sum("delta").alias("_t"))
    before = totals.select(key, "_b", F.coalesce(F.sum("_t").over(
        Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return local.join(before, [key, "_b"]).select(
        key, "ts", "delta", (F.col("_off") + F.col("_local")).alias("in_progress"))
