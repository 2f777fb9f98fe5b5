"""Scalar text functions, projections, validation, sampling and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import quality as Q
from tessera.operators import sampling as P
from tessera.operators.retrieval import doc_entities
from tessera.operators.tfidf import TfidfConfig, document_terms
from tessera.plans import sqlparts as S
from tessera.plans.registry import query
from tessera.sources.tables import benchmark_queries, table, v_event, v_text

# ---------------------------------------------------------------- C1, C2, C3, C9, F11
@query("text_normalise", S.with_views(f"SELECT id, {S.norm('subject')} AS subject_norm FROM v_text"))
def text_normalise(spark, sf):
    return v_text(spark, sf).select("id", T.normalise(F.col("subject")).alias("subject_norm"))


@query("clean_text", """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-zA-Z0-9\\s.,!?]', ' ', 'g'),
       '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM documents""")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("combine_text", S.with_views(
    "SELECT id, length(coalesce(subject, '') || ' ' || coalesce(description, '')) AS combined_length, "
    "md5(coalesce(subject, '') || ' ' || coalesce(description, '')) AS combined_md5 FROM v_text"))
def combine_text(spark, sf):
    c = T.combine_text(F.col("subject"), F.col("description"))
    return v_text(spark, sf).select("id", F.length(c).alias("combined_length"), F.md5(c).alias("combined_md5"))


@query("text_length", S.with_views("SELECT id, length(coalesce(description, '')) AS text_length FROM v_text"))
def text_length(spark, sf):
    return v_text(spark, sf).select("id", T.text_length(F.col("description")).alias("text_length"))


@query("preview_text", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE coalesce(text, '') END AS preview
FROM documents""")
def preview_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview(F.col("text"), 200).alias("preview"))


# ---------------------------------------------------------------- C4-C7
@query("extract_entities", S.with_views(f"""
SELECT id, e.type AS type, e.value AS value FROM (
  SELECT id, unnest({S.entity_list_unicode("subject || ' ' || description", S.UNICODE_FULL)}) AS e FROM v_text)"""))
def extract_entities(spark, sf):
    v = v_text(spark, sf).select(F.col("id").alias("doc_id"),
                                 F.concat(F.col("subject"), F.lit(" "), F.col("description")).alias("text"))
    return doc_entities(v, T.ENTITY_PATTERNS_FULL).withColumnRenamed("doc_id", "id")


@query("extract_entities_fast", f"""
SELECT doc_id, e.type AS type, e.value AS value FROM (
  SELECT doc_id, unnest({S.entity_list('text', T.ENTITY_PATTERNS_FAST)}) AS e FROM documents)""")
def extract_entities_fast(spark, sf):
    return doc_entities(table(spark, sf, "documents"), T.ENTITY_PATTERNS_FAST)


@query("extract_entities_ultra", f"""
SELECT id, e.type AS type, e.value AS value FROM (
  SELECT event_id AS id, unnest({S.entity_list_unicode("event_type || '-' || CAST(user_id AS VARCHAR) || ' ' || props", S.UNICODE_ULTRA, False)}) AS e FROM events
  UNION ALL SELECT doc_id, unnest({S.entity_list_unicode('text', S.UNICODE_ULTRA, False)}) FROM documents)""")
def extract_entities_ultra(spark, sf):
    """C6 over the event messages (which name errors) and the documents; repeated matches stay."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"), F.lit(" "), "props").alias("text"))
    both = e.unionByName(table(spark, sf, "documents").select("doc_id", "text"))
    return doc_entities(both, T.ENTITY_PATTERNS_ULTRA, distinct=False).withColumnRenamed("doc_id", "id")


@query("tokenise_ngrams", f"""
SELECT doc_id, term, count(*) AS n FROM (
  SELECT doc_id, unnest({S.terms('text', (1, 3), False, True)}) AS term FROM documents) GROUP BY doc_id, term""")
def tokenise_ngrams(spark, sf):
    return document_terms(table(spark, sf, "documents"), "doc_id", "text", TfidfConfig(ngram_range=(1, 3)))


# ---------------------------------------------------------------- C8, F10, F13, C13
@query("time_features", S.with_views("""
SELECT id, hour(created_at) AS hour, isodow(created_at) - 1 AS weekday, strftime(created_at, '%Y-%m-%d') AS date,
       weekofyear(created_at) AS iso_week, isodow(created_at) - 1 IN (5, 6) AS is_weekend FROM v_event"""))
def time_features(spark, sf):
    e = v_event(spark, sf)
    wd = F.weekday("created_at")
    return e.select("id", F.hour("created_at").alias("hour"), wd.alias("weekday"),
                    F.date_format("created_at", "yyyy-MM-dd").alias("date"),
                    F.weekofyear("created_at").alias("iso_week"), wd.isin(5, 6).alias("is_weekend"))


@query("grade_bands", S.with_views("""
SELECT grade, count(*) AS n FROM (
  SELECT CASE WHEN resolution_time_hours / 100.0 < 0.1 THEN 'excellent'
              WHEN resolution_time_hours / 100.0 < 0.5 THEN 'good' ELSE 'acceptable' END AS grade FROM v_event)
GROUP BY grade"""))
def grade_bands(spark, sf):
    """F13 on a latency derived from the event value (value / 100 seconds)."""
    e = v_event(spark, sf)
    return e.groupBy(Q.grade(F.col("resolution_time_hours") / 100.0).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query("query_fingerprint", """
SELECT item_id AS query_id, md5(concat_ws('_', text, 'None', 'None', '10')) AS fingerprint FROM benchmark""")
def query_fingerprint(spark, sf):
    q = benchmark_queries(spark, sf)
    return q.select("query_id", T.fingerprint(F.col("query"), F.col("category"), F.col("product"),
                                              F.lit(10)).alias("fingerprint"))


# ---------------------------------------------------------------- F1-F4, F8, F9, F14
@query("ticket_project", S.with_views("""
SELECT CAST(id AS VARCHAR) AS ticket_id, subject, description, product, category, subcategory,
       resolution_helpful, satisfaction_score, CAST(NULL AS VARCHAR) AS priority, CAST(NULL AS BIGINT) AS affected_users,
       CAST(NULL AS DOUBLE) AS account_monthly_value FROM v_text"""))
def ticket_project(spark, sf):
    p = Q.project(v_text(spark, sf).withColumn("ticket_id", F.col("id").cast("string")))
    return p.select("ticket_id", "subject", "description", "product", "category", "subcategory", "resolution_helpful",
                    "satisfaction_score", "priority", "affected_users", "account_monthly_value")


@query("default_fill", S.with_views("""
SELECT CAST(id AS VARCHAR) AS ticket_id, 'en' AS language, 'NA' AS region, '' AS feedback_text,
       coalesce(product, 'unknown') AS product, 'unknown' AS priority, 'unknown' AS severity,
       'unknown' AS product_version, 'unknown' AS product_module, 'email' AS channel, 'unknown' AS agent_specialization,
       'production' AS environment, 'medium' AS business_impact, CAST(0 AS BIGINT) AS previous_tickets,
       CAST(12 AS BIGINT) AS agent_experience_months, CAST(365 AS BIGINT) AS account_age_days,
       CAST(1000.0 AS DOUBLE) AS account_monthly_value, CAST(0 AS BIGINT) AS similar_issues_last_30_days,
       CAST(100 AS BIGINT) AS product_version_age_days, CAST(1 AS BIGINT) AS affected_users,
       CAST(0 AS BIGINT) AS response_count, CAST(0 AS BIGINT) AS attachments_count FROM v_text"""))
def default_fill(spark, sf):
    p = Q.project(v_text(spark, sf).withColumn("ticket_id", F.col("id").cast("string")))
    f = Q.fill_by_kind(Q.apply_defaults(p))
    return f.select("ticket_id", "product", "priority", "severity", *Q.REQUEST_DEFAULTS)


@query("filter_metadata", S.with_views("""
SELECT id, category, subcategory, product FROM v_text
WHERE lower(category) = lower('EN') AND lower(product) = lower('Src3')"""))
def filter_metadata(spark, sf):
    from tessera.operators.retrieval import filter_condition
    v = v_text(spark, sf)
    cond = filter_condition(F.col("category"), F.col("subcategory"), F.col("product"),
                            F.lit("EN"), F.lit(None).cast("string"), F.lit("Src3"))
    return v.where(cond).select("id", "category", "subcategory", "product")


@query("validate_required", S.with_views("""
SELECT id, rule FROM (
  SELECT id, 'subject_missing' AS rule FROM v_text WHERE subject IS NULL OR regexp_replace(subject, '^\\s+|\\s+$', '', 'g') = ''
  UNION ALL SELECT id, 'description_missing' FROM v_text
    WHERE description IS NULL OR regexp_replace(description, '^\\s+|\\s+$', '', 'g') = ''
  UNION ALL SELECT id, 'description_too_long' FROM v_text WHERE length(description) > 10000)"""))
def validate_required(spark, sf):
    return Q.violations(v_text(spark, sf), "id", Q.required_rules())


@query("dq_report", S.with_views("""
SELECT metric, value FROM (
  SELECT 'rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM v_text
  UNION ALL SELECT 'nulls_subject', count(*) FILTER (WHERE subject IS NULL) FROM v_text
  UNION ALL SELECT 'nulls_quality', count(*) FILTER (WHERE quality IS NULL) FROM v_text
  UNION ALL SELECT 'nulls_product', count(*) FILTER (WHERE product IS NULL) FROM v_text
  UNION ALL SELECT 'issue_text_over_10000', count(*) FILTER (WHERE length(description) > 10000) FROM v_text
  UNION ALL SELECT 'duplicate_rows', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (
    SELECT description, category, product, count(*) AS n FROM v_text GROUP BY ALL))"""))
def dq_report(spark, sf):
    v = v_text(spark, sf)
    return Q.dq_report(v, ["subject", "quality", "product"], ["description", "category", "product"],
                       {"text_over_10000": F.length(F.col("description")) > 10000})


@query("preprocess", S.with_views("""
SELECT CAST(id AS VARCHAR) AS ticket_id, coalesce(subject, '') AS subject, coalesce(category, 'unknown') AS category,
       CAST(length(coalesce(subject, '')) + length(coalesce(description, '')) AS BIGINT) AS ticket_text_length
FROM v_text"""))
def preprocess(spark, sf):
    p = Q.preprocess(Q.project(v_text(spark, sf).withColumn("ticket_id", F.col("id").cast("string"))))
    return p.select("ticket_id", "subject", "category", "ticket_text_length")


# ---------------------------------------------------------------- P1-P3
@query("sample_n", "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id LIMIT 100")
def sample_n(spark, sf):
    return P.sample_n(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100, 42)


@query("split_ordered", S.with_views("""
SELECT id, CASE WHEN r < floor(0.7 * n) THEN 'train' WHEN r < floor(0.7 * n) + floor(0.15 * n) THEN 'val'
                ELSE 'test' END AS split
FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM v_text)"""))
def split_ordered(spark, sf):
    return P.split_ordered(v_text(spark, sf).select("id"), "id").select("id", "split")


@query("split_stratified", S.with_views("""
SELECT id, category, CASE WHEN r < floor(0.7 * n) THEN 'train' WHEN r < floor(0.7 * n) + floor(0.15 * n) THEN 'val'
                ELSE 'test' END AS split
FROM (SELECT id, category,
             row_number() OVER (PARTITION BY category ORDER BY md5(CAST(id AS VARCHAR) || '42'), id) - 1 AS r,
             count(*) OVER (PARTITION BY category) AS n FROM v_text)"""))
def split_stratified(spark, sf):
    return P.split_stratified(v_text(spark, sf).select("id", "category"), "id", "category").select("id", "category", "split")
