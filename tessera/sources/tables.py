"""Scans of the input tables and the ticket views built on them.

There is no ticket table in the test data, so tickets are projections of the given tables
(documents + labels, events, orders + customer). Only columns are renamed or derived; no rows
are invented, so every query's work grows with its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one input table; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def first_line(text: Column) -> Column:
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def _one_row_an_id(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` for a left join by id. Where no id repeats, the plan says so: the join is then left out by the optimiser
    wherever only the left side's columns are read, and whole texts are not shuffled for it."""
    if not rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy(id_col).agg(*[F.first(c).alias(c) for c in rows.columns if c != id_col])


def v_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as solved tickets.

    id = doc_id, subject = first line, description = whole text, product = source,
    category = lang, subcategory = lang/(doc_id mod 5), resolution_helpful = (quality = 1)
    (unlabelled -> true, the retriever's default), satisfaction_score = 1 + doc_id mod 5.
    """
    docs = table(spark, sf_dir, "documents")
    return docs.join(_one_row_an_id(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id"), "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        first_line(F.col("text")).alias("subject"),
        F.col("text").alias("description"),
        F.col("source").alias("product"),
        F.col("lang").alias("category"),
        F.concat(F.col("lang"), F.lit("/"), (F.col("doc_id") % 5).cast("string")).alias("subcategory"),
        F.coalesce(F.col("quality") == 1, F.lit(True)).alias("resolution_helpful"),
        (F.lit(1) + F.col("doc_id") % 5).cast("double").alias("satisfaction_score"),
        F.col("quality"),
        F.col("toxic"),
    )


def v_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticket activity.

    created_at = ts (kept as wall-clock timestamp_ntz; cast for watermarks only),
    category = event_type, resolution_time_hours = value, product = 'prod' + user_id mod 4,
    agent_id = user_id mod 10, k = props.k; sentiment negative (<34) / neutral (<67) / positive,
    satisfaction = 1 + k mod 5, resolution_helpful = event_type <> 'error', escalated = value > 150.
    """
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("user_id"),
        F.col("event_type").alias("category"),
        F.col("value").alias("resolution_time_hours"),
        F.concat(F.lit("prod"), (F.col("user_id") % 4).cast("string")).alias("product"),
        (F.col("user_id") % 10).cast("string").alias("agent_id"),
        k.alias("k"),
    ).select(
        "*",
        F.when(F.col("k") < 34, "negative")
        .when(F.col("k") < 67, "neutral")
        .otherwise("positive")
        .alias("customer_sentiment"),
        (F.lit(1) + F.col("k") % 5).cast("double").alias("satisfaction_score"),
        (F.col("category") != "error").alias("resolution_helpful"),
        (F.col("resolution_time_hours") > 150).alias("escalated"),
    )


def v_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to their customer: created_at, priority, product = market segment."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total_price"),
        F.col("c_mktsegment").alias("product"),
        F.col("c_acctbal").alias("account_monthly_value"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str, with_filters: bool = False) -> DataFrame:
    """The benchmark passages as a batch of search queries (query_id, query).

    With ``with_filters`` each query also carries a category (one of the four languages) and a
    product (one of the sources), derived from item_id, to exercise the filter and boost paths.
    """
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    if not with_filters:
        return b.select("query_id", "query", F.lit(None).cast("string").alias("category"),
                        F.lit(None).cast("string").alias("subcategory"), F.lit(None).cast("string").alias("product"))
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    return b.select(
        "query_id",
        "query",
        F.element_at(langs, (F.col("query_id") % 4 + 1).cast("int")).alias("category"),
        F.lit(None).cast("string").alias("subcategory"),
        F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("product"),
    )


def conversation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a query batch: query_id = conv_id * 1000 + turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"),
                    F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("subcategory"),
                    F.lit(None).cast("string").alias("product"))
