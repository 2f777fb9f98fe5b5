"""Retrieval queries: the benchmark passages searched over the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.operators.tfidf import CONFIGS
from tessera.plans import sqlparts as S
from tessera.plans.registry import query
from tessera.sources.tables import benchmark_queries, v_text

LIMIT = 10


# ------------------------------------------------------------------------------------------
# SQL twins
# ------------------------------------------------------------------------------------------
def _fast_sql(with_filters: bool, body: str | None = None, q_sql: str | None = None,
              extra: tuple[str, ...] = ()) -> str:
    cfg = CONFIGS["fast"]
    pats = S.UNICODE_FAST | S.UNICODE_LONG
    if q_sql is not None:
        q = q_sql
    elif with_filters:
        q = ("SELECT item_id AS query_id, " + S.norm("text") + " AS q_text, "
             "(['de','en','es','fr'])[CAST(item_id % 4 AS INTEGER) + 1] AS q_category, "
             "CAST(NULL AS VARCHAR) AS q_subcategory, 'src' || CAST(item_id % 20 AS VARCHAR) AS q_product FROM benchmark")
    else:
        q = ("SELECT item_id AS query_id, " + S.norm("text") + " AS q_text, CAST(NULL AS VARCHAR) AS q_category, "
             "CAST(NULL AS VARCHAR) AS q_subcategory, CAST(NULL AS VARCHAR) AS q_product FROM benchmark")
    fdocs = f"""fdocs AS (
  SELECT id AS doc_id, {S.norm('subject')} || ' ' || {S.norm('description')} || ' ' || '' AS text,
         {S.norm('subject')} AS title, substring({S.norm('description')}, 1, 200) AS content,
         product, category, subcategory,
         0.7::DOUBLE * (CASE WHEN coalesce(resolution_helpful, true) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
           + 0.3::DOUBLE * (coalesce(satisfaction_score, 4.0::DOUBLE) / 5.0::DOUBLE) AS success_rate
  FROM v_text)"""
    ctes = [fdocs, f"q AS ({q})"]
    ctes += S.tfidf_ctes("fx", "fdocs", "doc_id", "text", cfg)
    ctes += S.query_vec_cte("fx", "q", cfg)
    ctes += [
        """kw AS (SELECT query_id, doc_id, sum(qw * weight) AS s FROM fx_qv JOIN fx_w USING (term)
  GROUP BY query_id, doc_id HAVING sum(qw * weight) > 0.01)""",
        f"""dent AS (SELECT DISTINCT doc_id, e.value AS value FROM (
  SELECT doc_id, unnest({S.entity_list_unicode('text', pats)}) AS e FROM fdocs))""",
        f"""qent AS (SELECT query_id, e.type AS type, e.value AS value FROM (
  SELECT query_id, unnest({S.entity_list_unicode('q_text', pats)}) AS e FROM q))""",
        """ent0 AS (SELECT query_id, doc_id, CAST(count(*) AS DOUBLE) AS s FROM qent JOIN dent USING (value)
  GROUP BY query_id, doc_id)""",
        """ent AS (SELECT e.query_id, doc_id, s / mx AS s FROM ent0 e
  JOIN (SELECT query_id, max(s) AS mx FROM ent0 GROUP BY query_id) m ON e.query_id = m.query_id)""",
        """cat AS (SELECT query_id, doc_id, sum(b) AS s FROM (
    SELECT q.query_id, d.doc_id, 0.5::DOUBLE AS b FROM q JOIN fdocs d ON d.category = q.q_category
    UNION ALL
    SELECT q.query_id, d.doc_id, 0.3::DOUBLE AS b FROM q
      JOIN (SELECT DISTINCT product, category FROM fdocs) pc ON pc.product = q.q_product
      JOIN fdocs d ON d.category = pc.category) GROUP BY query_id, doc_id)""",
        """m AS (SELECT query_id, doc_id, coalesce(sum(k), 0.0) AS keyword_score, coalesce(sum(e), 0.0) AS entity_score,
         coalesce(sum(c), 0.0) AS category_score FROM (
    SELECT query_id, doc_id, s AS k, NULL::DOUBLE AS e, NULL::DOUBLE AS c FROM kw
    UNION ALL SELECT query_id, doc_id, NULL, s, NULL FROM ent
    UNION ALL SELECT query_id, doc_id, NULL, NULL, s FROM cat) GROUP BY query_id, doc_id)""",
        """r AS (SELECT m.*, round(0.6::DOUBLE * keyword_score + 0.25::DOUBLE * entity_score
                         + 0.15::DOUBLE * category_score, 6) AS relevance_score,
         d.title, d.content, d.product, d.category, d.subcategory, d.success_rate,
         q.q_category, q.q_subcategory, q.q_product
  FROM m JOIN fdocs d USING (doc_id) JOIN q USING (query_id))""",
        """flt AS (SELECT * FROM r WHERE (q_category IS NULL OR lower(category) = lower(q_category))
  AND (q_subcategory IS NULL OR lower(subcategory) = lower(q_subcategory))
  AND (q_product IS NULL OR lower(product) = lower(q_product)))""",
    ]
    ctes.append("""cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, doc_id)
  AS pre FROM flt QUALIFY pre <= 10)""")
    ctes += list(extra)
    body = body or """SELECT query_id,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * relevance_score + 0.3::DOUBLE * success_rate, 6) DESC,
                     pre ASC, doc_id) AS BIGINT) AS rank,
  doc_id, title, content, relevance_score, round(success_rate, 6) AS success_rate, category, subcategory, product,
  round(keyword_score, 6) AS keyword_score, round(entity_score, 6) AS entity_score,
  round(category_score, 6) AS category_score
FROM cand"""
    return S.with_views(body, *ctes)


def _fast_index(spark, sf_dir, write_entities=True):
    """The fast index; its entities are the reference's and the corpus's long words."""
    return R.build_index(v_text(spark, sf_dir), "fast", patterns=T.ENTITY_PATTERNS_FAST | T.LONG_WORDS, write_entities=write_entities)


def _rank_long(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


@query("search_fast", _fast_sql(False))
def search_fast(spark, sf_dir):
    """K15 flagship: every benchmark passage as a query over every document."""
    return _rank_long(R.search_fast(_fast_index(spark, sf_dir), benchmark_queries(spark, sf_dir), LIMIT))


@query("search_category_boost", _fast_sql(True))
def search_category_boost(spark, sf_dir):
    """K6 + F4 inside K15: queries carry a category and product filter (derived from item_id)."""
    return _rank_long(R.search_fast(_fast_index(spark, sf_dir), benchmark_queries(spark, sf_dir, True), LIMIT))


@query("topk_filter_first", _fast_sql(True, body="SELECT query_id, count(*) AS n, max(relevance_score) AS best FROM cand GROUP BY query_id"))
def topk_filter_first(spark, sf_dir):
    """The filter comes before the cut, so every query with matching documents is answered."""
    found = R.search_fast(_fast_index(spark, sf_dir), benchmark_queries(spark, sf_dir, True), LIMIT)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("relevance_score").alias("best"))
