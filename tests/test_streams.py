"""Monitors on real micro-batches: late rows, replay, continuing, triggers."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.sources.files import scratch_path
from tessera.streaming import monitor as V

DAY = datetime(2024, 1, 1)


def arrive(spark, path, rows):
    """One file with events (id, hours after the first day's begin, type, value)."""
    full = [(i, DAY + timedelta(hours=h), i % 8, kind, float(v), '{"k": 5}') for i, h, kind, v in rows]
    spark.createDataFrame(full, V.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stats(df):
    return sorted((r.window_start[:10], r.category, r.n) for r in df.collect())


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "events")


def test_late_rows_count_until_the_watermark_passes_their_window(spark, folder):
    arrive(spark, folder, [(1, 1, "a", 1), (2, 30, "a", 1)])
    arrive(spark, folder, [(3, 60, "a", 1), (4, 2, "a", 1)])     # day 1 is still open: no watermark yet
    arrive(spark, folder, [(5, 90, "a", 1), (6, 3, "a", 1)])     # watermark of the first file: 29 h, day 1 is closed
    arrive(spark, folder, [(7, 31, "a", 1), (8, 61, "a", 1)])    # watermark 59 h: day 2 is closed, day 3 is open
    got = stats(V.run_to_table(spark, V.period_stats(V.arriving(spark, folder)), ["window_start", "category"], "t"))
    assert got == [("2024-01-01", "a", 2), ("2024-01-02", "a", 1), ("2024-01-03", "a", 2), ("2024-01-04", "a", 1)]


def test_counters_start_again_each_period(spark, folder):
    for day in range(4):
        arrive(spark, folder, [(day * 10 + i, 24 * day + i, "a", i) for i in range(day + 1)])
    got = V.run_to_table(spark, V.period_stats(V.arriving(spark, folder)), ["window_start", "category"], "t")
    assert [n for _, _, n in stats(got)] == [1, 2, 3, 4]


def test_a_run_goes_on_and_a_replayed_batch_repeats_nothing(spark, folder):
    root = scratch_path(spark, "monitor")
    run = lambda: V.run_to_table(spark, V.period_stats(V.arriving(spark, folder)), ["window_start", "category"], "t", root=root)
    arrive(spark, folder, [(1, 1, "a", 1), (2, 2, "b", 1)])
    assert stats(run()) == [("2024-01-01", "a", 1), ("2024-01-01", "b", 1)]
    arrive(spark, folder, [(3, 3, "a", 1)])
    assert stats(run()) == [("2024-01-01", "a", 2), ("2024-01-01", "b", 1)]
    local = root.removeprefix("file:")
    shutil.copytree(f"{local}/ckpt", f"{local}/ckpt-kept")
    last = max(int(x.name) for x in __import__("pathlib").Path(f"{local}/ckpt/commits").iterdir() if x.name.isdigit())
    for name in (str(last), f".{last}.crc"):  # the driver was lost after the sink wrote, before the commit
        __import__("pathlib").Path(f"{local}/ckpt/commits/{name}").unlink(missing_ok=True)
    rows = V.run_to_table(spark, V.period_stats(V.arriving(spark, folder)), [], "t", root=root)
    assert stats(run()) == [("2024-01-01", "a", 2), ("2024-01-01", "b", 1)]
    assert rows.count() == 3  # two rows of the first batch, one of the second


def test_trigger_is_a_parameter(spark, folder):
    arrive(spark, folder, [(1, 1, "a", 1), (2, 2, "a", 1)])
    got = V.run_to_table(spark, V.sum_by(V.arriving(spark, folder)), ["category"], "t", trigger={"processingTime": "1 second"}, timeout=15)
    assert [(r.category, r.n) for r in got.collect()] == [("a", 2)]


def test_stream_scores_are_those_of_the_batch(spark):
    from __spark_entry__ import queries
    from conftest import SMOKE
    qs = queries()
    a = qs["stream_score"](spark, SMOKE).select("doc_id", "prediction")
    b = qs["train_classifier"](spark, SMOKE).select("doc_id", "prediction")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_hourly_anomalies_of_a_stream_are_flagged(spark):
    from __spark_entry__ import queries
    from conftest import SMOKE
    rows = queries()["stream_anomaly"](spark, SMOKE)
    assert rows.where("is_anomaly").count() > 0 and rows.where(F.col("anomaly_score").isNotNull()).count() > 0
