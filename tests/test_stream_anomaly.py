"""V8: the stream's detectors see the sentiment that v_event has."""

from pyspark.sql import functions as F

from conftest import SMOKE


def test_sentiment_is_that_of_v_event(spark):
    from tessera.sources.tables import v_event
    from tessera.streaming import monitor as V
    got = V.event_batch(spark, SMOKE).select("id", "customer_sentiment")
    want = v_event(spark, SMOKE).select("id", "customer_sentiment")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_sentiment_rows_appear(spark):
    from __spark_entry__ import queries
    out = queries()["stream_anomaly"](spark, SMOKE)
    rows = out.where(F.col("type") == "sentiment_shift_anomaly")
    assert {r.sentiment for r in rows.select(F.col("key").alias("sentiment")).distinct().collect()} == {"negative", "neutral", "positive"}
