"""Structured Streaming monitors (V1-V8) and their batch twins.

Events arrive through a file source; each monitor is a watermarked, windowed aggregation written
in update mode through ``foreachBatch`` to Parquet under the session's checkpoint folder (one
folder per batch id). The current state of a monitor is read back as the latest row per key,
so no result passes through the driver. The trigger is a parameter: ``AVAILABLE_NOW`` drains what has
arrived, ``{"processingTime": "15 seconds"}`` follows a live folder (the reference scrapes every 10-15 s).

The counters of a period start again with each period (a tumbling window); its state leaves when the
watermark passes it. A row that arrives after that is late and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_columns(df: DataFrame) -> DataFrame:
    """Ticket activity columns; event time cast to TIMESTAMP (watermarks reject timestamp_ntz); sentiment as in ``v_event``."""
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return df.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"),
        F.col("value"), F.concat(F.lit("prod"), (F.col("user_id") % 4).cast("string")).alias("product"),
        (F.col("event_type") != "error").alias("resolution_helpful"),
        F.when(k < 34, "negative").when(k < 67, "neutral").otherwise("positive").alias("customer_sentiment"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming scan of the events table (file source, fixed schema)."""
    base = sf_dir.rstrip("/")
    raw = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).option("basePath", base)
           .parquet(f"{base}/events*.parquet"))
    return event_columns(raw)


def event_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet"))


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Streaming scan of a folder into which event files arrive: a file is a micro-batch."""
    return event_columns(spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))


# ------------------------------------------------------------------ aggregations (stream = batch)
def _win(w: Column) -> list[Column]:
    return [F.date_format(w.start, "yyyy-MM-dd HH:mm:ss").alias("window_start"),
            F.date_format(w.end, "yyyy-MM-dd HH:mm:ss").alias("window_end")]


def period_stats(ev: DataFrame, period: str = "24 hours", watermark: str = "1 hour") -> DataFrame:
    """V1: per tumbling period and category: count, mean resolution time, success rate."""
    g = ev.withWatermark("ts", watermark).groupBy(F.window("ts", period).alias("w"), "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_resolution_time"),
        F.avg(F.col("resolution_helpful").cast("double")).alias("success_rate"))
    return g.select(*_win(F.col("w")), "category", "n", "avg_resolution_time", "success_rate")


def rate(ev: DataFrame, length: str = "5 minutes", slide: str = "1 minute", seconds: int = 300,
         watermark: str = "10 minutes") -> DataFrame:
    """V2: rate(counter[5m]) by label = events in a sliding window / window seconds."""
    g = ev.withWatermark("ts", watermark).groupBy(F.window("ts", length, slide).alias("w"), "category").agg(
        F.count(F.lit(1)).alias("n"))
    return g.select(*_win(F.col("w")), "category", "n", (F.col("n") / float(seconds)).alias("rate"))


def quantiles(ev: DataFrame, length: str = "5 minutes", slide: str = "1 minute", watermark: str = "10 minutes",
              exact: bool = False) -> DataFrame:
    """V3: p50 / p95 of the value per sliding window (approximate on streams, exact in the twin)."""
    agg = (F.percentile("value", [0.5, 0.95]) if exact else F.percentile_approx("value", [0.5, 0.95], 10000))
    g = ev.withWatermark("ts", watermark).groupBy(F.window("ts", length, slide).alias("w")).agg(agg.alias("q"))
    return g.select(*_win(F.col("w")), F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))


def error_ratio(ev: DataFrame, length: str = "5 minutes", slide: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """V4: non-success share (category = 'error') per sliding window."""
    g = ev.withWatermark("ts", watermark).groupBy(F.window("ts", length, slide).alias("w")).agg(
        F.count_if(F.col("category") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))
    return g.select(*_win(F.col("w")), "errors", "n", (F.col("errors") / F.col("n")).alias("error_ratio"))


def last_value(ev: DataFrame, key: str = "product", period: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """V5: gauge = last value per key (max_by on event time) per period."""
    g = ev.withWatermark("ts", watermark).groupBy(F.window("ts", period).alias("w"), key).agg(
        F.max_by("value", F.struct("ts", "id")).alias("last_value"))
    return g.select(*_win(F.col("w")), key, "last_value")


def sum_by(ev: DataFrame, key: str = "category") -> DataFrame:
    """V6: running count per label (update mode, no window)."""
    return ev.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 150).alias("high_value"))


# ------------------------------------------------------------------ running a monitor
AVAILABLE_NOW = {"availableNow": True}


def run_to_table(spark: SparkSession, stream_df: DataFrame, keys: Sequence[str], name: str,
                 per_batch: Callable[[DataFrame, int], DataFrame] | None = None, trigger: Mapping | None = None,
                 root: str | None = None, timeout: float | None = None) -> DataFrame:
    """Run a streaming aggregation in update mode; each micro-batch's updated rows overwrite the Parquet
    folder of their batch id under ``<root>/data`` (``<checkpoint dir>/streams/<name>-<uuid>`` unless given),
    so a replayed batch repeats nothing; the result is the latest row per key.

    With a ``trigger`` that never ends, ``timeout`` seconds stop the query. The same ``root`` goes on
    where an earlier run stopped."""
    root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    out = f"{root}/data"

    def sink(batch: DataFrame, batch_id: int) -> None:
        b = per_batch(batch, batch_id) if per_batch else batch
        b.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream_df.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{root}/ckpt").trigger(**dict(trigger or AVAILABLE_NOW)).start())
    try:
        if timeout is None:
            q.awaitTermination()
        else:
            q.awaitTermination(timeout)
    finally:
        q.stop()
    rows = spark.read.parquet(out)
    if not keys:
        return rows.drop("batch")
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "batch")
