"""Projection, defaults, validation and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import strip_ws, text_length

# Canonical ticket schema (union of every field the reference touches).
TICKET_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("customer_id", T.StringType()), T.StructField("customer_tier", T.StringType()),
    T.StructField("organization_id", T.StringType()), T.StructField("product", T.StringType()),
    T.StructField("product_version", T.StringType()), T.StructField("product_module", T.StringType()),
    T.StructField("channel", T.StringType()), T.StructField("subject", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("error_logs", T.StringType()),
    T.StructField("stack_trace", T.StringType()), T.StructField("previous_tickets", T.LongType()),
    T.StructField("agent_experience_months", T.LongType()), T.StructField("agent_specialization", T.StringType()),
    T.StructField("environment", T.StringType()), T.StructField("account_age_days", T.LongType()),
    T.StructField("account_monthly_value", T.DoubleType()), T.StructField("similar_issues_last_30_days", T.LongType()),
    T.StructField("product_version_age_days", T.LongType()), T.StructField("affected_users", T.LongType()),
    T.StructField("response_count", T.LongType()), T.StructField("attachments_count", T.LongType()),
    T.StructField("business_impact", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()), T.StructField("priority", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("feedback_text", T.StringType()),
    T.StructField("ticket_text_length", T.LongType()), T.StructField("resolution_helpful", T.BooleanType()),
    T.StructField("satisfaction_score", T.DoubleType()), T.StructField("customer_sentiment", T.StringType()),
    T.StructField("resolution_time_hours", T.DoubleType()), T.StructField("resolution", T.StringType()),
    T.StructField("agent_id", T.StringType()), T.StructField("escalated", T.BooleanType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])
REQUIRED = ("subject", "description")
# Text and categorical columns of the feature store (fixed values).
TEXT_COLUMNS = ("subject", "description", "error_logs", "feedback_text")
CATEGORICAL_COLUMNS = ("product", "product_version", "product_module", "channel",
                       "customer_tier", "agent_specialization", "environment",
                       "business_impact", "language", "region")
# Further text columns of the ticket schema, filled alike.
MORE_TEXT_COLUMNS = ("stack_trace", "resolution")
TARGET_COLUMNS = ("category", "subcategory", "priority", "severity")
# Defaults of the prediction request (fixed values).
REQUEST_DEFAULTS = {
    "feedback_text": "",
    "product_version": "unknown",
    "product_module": "unknown",
    "channel": "email",
    "agent_specialization": "unknown",
    "environment": "production",
    "business_impact": "medium",
    "language": "en",
    "region": "NA",
    "previous_tickets": 0,
    "agent_experience_months": 12,
    "account_age_days": 365,
    "account_monthly_value": 1000.0,
    "similar_issues_last_30_days": 0,
    "product_version_age_days": 100,
    "affected_users": 1,
    "response_count": 0,
    "attachments_count": 0,
}  # ticket_text_length, the nineteenth, is computed (``preprocess``)


def project(df: DataFrame, schema: T.StructType = TICKET_SCHEMA) -> DataFrame:
    """select + cast onto a fixed schema; columns the input lacks become typed nulls."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def fill_by_kind(df: DataFrame) -> DataFrame:
    """text -> '', categorical and target -> 'unknown', numeric -> 0."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in TEXT_COLUMNS + MORE_TEXT_COLUMNS:
            c = F.coalesce(c, F.lit(""))
        elif f.name in CATEGORICAL_COLUMNS or f.name in TARGET_COLUMNS:
            c = F.coalesce(c, F.lit("unknown"))
        elif isinstance(f.dataType, (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def apply_defaults(df: DataFrame, defaults: Mapping[str, object] = REQUEST_DEFAULTS) -> DataFrame:
    """coalesce listed columns with their default (explicit nulls included, T9)."""
    return df.select(*[
        (F.coalesce(F.col(c), F.lit(defaults[c]).cast(t)).alias(c) if c in defaults else F.col(c)) for c, t in df.dtypes
    ])


def preprocess(df: DataFrame) -> DataFrame:
    """defaults + kind fills + ticket_text_length = length(subject) + length(description)."""
    x = fill_by_kind(apply_defaults(df))
    return x.withColumn("ticket_text_length", (text_length(F.col("subject")) + text_length(F.col("description"))).cast("long"))


def blank(c: Column) -> Column:
    return c.isNull() | (strip_ws(c) == "")


def violations(df: DataFrame, id_col: str, rules: Mapping[str, Column]) -> DataFrame:
    """F8: one (id, rule) row per failed rule (rules are boolean 'is violated' columns)."""
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return df.select(F.col(id_col).alias("id"), F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("rule"))


def required_rules(columns: Sequence[str] = REQUIRED, max_len: int | None = 10000) -> dict[str, Column]:
    rules = {f"{c}_missing": blank(F.col(c)) for c in columns}
    if max_len is not None and "description" in columns:
        rules["description_too_long"] = F.length(F.col("description")) > max_len
    return rules


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the columns' JSON: equal for equal rows, nulls and arrays included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def dq_report(df: DataFrame, null_columns: Sequence[str], dup_columns: Sequence[str],
              issue_rules: Mapping[str, Column]) -> DataFrame:
    """(metric, value) rows from one aggregate pass plus one duplicate count.

    rows, nulls per column, issue-rule counts; duplicates = rows - distinct rows of dup_columns.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in null_columns]
    aggs += [F.count_if(cond).alias(f"issue_{name}") for name, cond in issue_rules.items()]
    one = df.agg(*aggs)
    # grouped by a digest: whole texts are not shuffled as keys
    dups = df.groupBy(row_digest(df, dup_columns).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    both = one.crossJoin(dups)  # two one-row frames
    names = [a for a in both.columns]
    return both.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names])).alias("m")
    ).select("m.metric", "m.value")


def grade(latency_s: Column, bands: Sequence[tuple[float, str]] = ((0.1, "excellent"), (0.5, "good")),
          otherwise: str = "acceptable") -> Column:
    """first band whose upper bound the value is below."""
    expr = None
    for bound, name in bands:
        expr = F.when(latency_s < bound, F.lit(name)) if expr is None else expr.when(latency_s < bound, F.lit(name))
    return expr.otherwise(F.lit(otherwise))
