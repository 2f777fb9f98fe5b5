"""Retrieval building blocks as queries: channels, merges, ranks, graph, TF-IDF tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph as H
from tessera.operators import retrieval as R
from tessera.operators import sampling as P
from tessera.operators.tfidf import CONFIGS, fit_transform
from tessera.plans import sqlparts as S
from tessera.plans.registry import query
from tessera.sources.tables import benchmark_queries, conversation_queries, table, v_event, v_text

FULL = T.ENTITY_PATTERNS_FULL
FAST = T.ENTITY_PATTERNS_FAST


def _docs_cte(name: str, view: str) -> str:
    return f"""{name} AS (
  SELECT id AS doc_id, {S.norm('subject')} || ' ' || {S.norm('description')} || ' ' || '' AS text,
         product, category, subcategory FROM {view})"""


def _q_cte(name: str = "q", filters: bool = False) -> str:
    txt = "text"
    if filters:
        f = ("(['de','en','es','fr'])[CAST(item_id % 4 AS INTEGER) + 1] AS q_category, "
             "CAST(NULL AS VARCHAR) AS q_subcategory, 'src' || CAST(item_id % 20 AS VARCHAR) AS q_product")
    else:
        f = "CAST(NULL AS VARCHAR) AS q_category, CAST(NULL AS VARCHAR) AS q_subcategory, CAST(NULL AS VARCHAR) AS q_product"
    return f"{name} AS (SELECT item_id AS query_id, {S.norm(txt)} AS q_text, {f} FROM benchmark)"


CONV_Q = ("qc AS (SELECT conv_id * 1000 + turn AS query_id, "
          + S.norm("text") + " AS q_text FROM conversations)")


def _ents_cte(name: str, src: str, id_col: str, text_col: str, pats: dict) -> str:
    return f"""{name} AS (SELECT {id_col}, e.type AS type, e.value AS value FROM (
  SELECT {id_col}, unnest({S.entity_list_unicode(text_col, pats)}) AS e FROM {src}))"""


#: The reference's patterns and the corpus's long words, which the passages and documents share.
PATTERNS, PATTERNS_SQL = FULL | T.LONG_WORDS, S.UNICODE_FULL | S.UNICODE_LONG


def _full_index(spark, sf):
    return R.build_index(v_text(spark, sf), "full", patterns=PATTERNS)


# ---------------------------------------------------------------- K1 / J2, G16, X1, X8
def _kw_sql(cfg_name: str) -> str:
    cfg = CONFIGS[cfg_name]
    ctes = [_docs_cte("docs", "v_text"), _q_cte()] + S.tfidf_ctes("t", "docs", "doc_id", "text", cfg) + \
        S.query_vec_cte("t", "q", cfg)
    return S.with_views("""SELECT query_id, doc_id, round(sum(qw * weight), 6) AS keyword_score
FROM t_qv JOIN t_w USING (term) GROUP BY query_id, doc_id""", *ctes)


@query("search_keyword", _kw_sql("full"))
def search_keyword(spark, sf):
    idx = R.build_index(v_text(spark, sf), "full", write_entities=False)
    kw = R.keyword_scores(idx, R.prepare_queries(benchmark_queries(spark, sf)))
    return kw.select("query_id", "doc_id", R.r6(F.col("keyword_score")).alias("keyword_score"))


@query("tfidf_vocab", S.with_views("SELECT term, df, round(idf, 6) AS idf FROM t_vocab",
                                   _docs_cte("docs", "v_text"),
                                   *S.tfidf_ctes("t", "docs", "doc_id", "text", CONFIGS["vocabulary"])))
def tfidf_vocab(spark, sf):
    docs = R.prepare_solutions(v_text(spark, sf), "full")
    m = fit_transform(docs, "doc_id", "text", CONFIGS["vocabulary"])
    return m.vocab.select("term", "df", R.r6(F.col("idf")).alias("idf"))


def _weights_sql(cfg_name: str) -> str:
    cfg = CONFIGS[cfg_name]
    return S.with_views("SELECT doc_id, term, tf, round(weight, 6) AS weight FROM t_w",
                        "d AS (SELECT id AS doc_id, description AS text FROM v_text)",
                        *S.tfidf_ctes("t", "d", "doc_id", "text", cfg))


@query("tfidf_weights", _weights_sql("feature_store"))
def tfidf_weights(spark, sf):
    """Feature-store TF-IDF of the ticket descriptions (long sparse table)."""
    m = fit_transform(v_text(spark, sf).select(F.col("id").alias("doc_id"), F.col("description").alias("text")),
                      "doc_id", "text", CONFIGS["feature_store"])
    return m.weights.select("doc_id", "term", "tf", R.r6(F.col("weight")).alias("weight"))


@query("tfidf_sublinear", _weights_sql("notebook_sublinear"))
def tfidf_sublinear(spark, sf):
    """1 + ln(tf) variant."""
    m = fit_transform(v_text(spark, sf).select(F.col("id").alias("doc_id"), F.col("description").alias("text")),
                      "doc_id", "text", CONFIGS["notebook_sublinear"])
    return m.weights.select("doc_id", "term", "tf", R.r6(F.col("weight")).alias("weight"))


# ---------------------------------------------------------------- J1, U2, K4
ENT_CTES = [_docs_cte("docs", "v_text"), CONV_Q,
            _ents_cte("de", "docs", "doc_id", "text", PATTERNS_SQL), _ents_cte("qe", "qc", "query_id", "q_text", PATTERNS_SQL)]


@query("join_entity_probe", S.with_views("""
SELECT query_id, doc_id, count(*) AS n FROM qe JOIN (SELECT DISTINCT doc_id, value FROM de) de USING (value)
GROUP BY query_id, doc_id""", *ENT_CTES))
def join_entity_probe(spark, sf):
    """Entities of conversation turns probe the document entity postings (join on value)."""
    idx = _full_index(spark, sf)
    qe = R.query_entities(R.prepare_queries(conversation_queries(spark, sf)), PATTERNS)
    post = idx.entities.select("doc_id", "value").distinct()
    return qe.join(post, "value").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("intersect_entities", S.with_views("""
SELECT DISTINCT query_id, doc_id, value FROM qe JOIN (SELECT DISTINCT doc_id, value FROM de) de USING (value)""",
    *ENT_CTES))
def intersect_entities(spark, sf):
    """The entity values a conversation turn shares with each document."""
    idx = _full_index(spark, sf)
    qe = R.query_entities(R.prepare_queries(conversation_queries(spark, sf)), PATTERNS)
    return H.shared_values(qe, idx.entities)


@query("search_entity", S.with_views("""
SELECT query_id, doc_id, round(n / max(n) OVER (PARTITION BY query_id), 6) AS entity_score FROM (
  SELECT query_id, doc_id, CAST(count(*) AS DOUBLE) AS n FROM qe JOIN de USING (value) GROUP BY query_id, doc_id)""",
    *ENT_CTES))
def search_entity(spark, sf):
    """K4: full pattern set; a document value counts once per entity type it was found under."""
    idx = _full_index(spark, sf)
    s = R.entity_scores(idx, R.prepare_queries(conversation_queries(spark, sf)))
    return s.select("query_id", "doc_id", R.r6(F.col("entity_score")).alias("entity_score"))


# ---------------------------------------------------------------- K5, H1-H5, G17, J9, J7
GRAPH_SQL_CTES = [_docs_cte("docs", "v_text"), _q_cte(filters=True),
                  _ents_cte("de", "docs", "doc_id", "text", PATTERNS_SQL), _ents_cte("qe", "q", "query_id", "q_text", PATTERNS_SQL)]


@query("search_graph", S.with_views("""
SELECT query_id, doc_id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS graph_score FROM (
  SELECT query_id, doc_id, sum(w) AS s FROM (
    SELECT qe.query_id, de.doc_id, 1.0 AS w FROM qe JOIN de ON qe.type = de.type AND qe.value = de.value
    UNION ALL SELECT q.query_id, d.doc_id, 0.6 FROM q JOIN docs d ON d.category = q.q_category
    UNION ALL SELECT q.query_id, d.doc_id, 0.8 FROM q JOIN docs d ON d.product = q.q_product)
  GROUP BY query_id, doc_id)""", *GRAPH_SQL_CTES))
def search_graph(spark, sf):
    idx = _full_index(spark, sf)
    s = R.graph_scores(idx, R.prepare_queries(benchmark_queries(spark, sf, True)))
    return s.select("query_id", "doc_id", R.r6(F.col("graph_score")).alias("graph_score"))


EDGES_SQL = """edges AS (
  SELECT DISTINCT src, dst, relation FROM (
    SELECT 'solution_' || CAST(doc_id AS VARCHAR) AS src, type || '_' || value AS dst, 'contains' AS relation FROM de
      WHERE length(trim(value)) > 0
    UNION ALL SELECT 'solution_' || CAST(doc_id AS VARCHAR), 'product_' || product, 'belongs_to' FROM docs
    UNION ALL SELECT 'solution_' || CAST(doc_id AS VARCHAR), 'category_' || category, 'categorized_as' FROM docs
    UNION ALL SELECT DISTINCT 'product_' || product, 'category_' || category, 'has_issues_in' FROM docs))"""
NODES_SQL = """nodes AS (
  SELECT DISTINCT node, type FROM (
    SELECT 'solution_' || CAST(doc_id AS VARCHAR) AS node, 'solution' AS type FROM docs
    UNION ALL SELECT type || '_' || value, type FROM de WHERE length(trim(value)) > 0
    UNION ALL SELECT 'product_' || product, 'product' FROM docs
    UNION ALL SELECT 'category_' || category, 'category' FROM docs))"""


def _graph(spark, sf):
    idx = _full_index(spark, sf)
    return idx, H.edges(idx.docs, idx.entities), H.nodes(idx.docs, idx.entities)


@query("graph_edges", S.with_views("SELECT src, dst, relation FROM edges", *GRAPH_SQL_CTES, EDGES_SQL))
def graph_edges(spark, sf):
    return _graph(spark, sf)[1]


@query("graph_stats", S.with_views("""
SELECT 'node' AS kind, type AS label, count(*) AS n FROM nodes GROUP BY type
UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY relation""", *GRAPH_SQL_CTES, EDGES_SQL, NODES_SQL))
def graph_stats(spark, sf):
    _, e, n = _graph(spark, sf)
    return H.stats(n, e)


QNODES_SQL = """qnodes AS (
  SELECT query_id, type || '_' || value AS node FROM qe
  UNION ALL SELECT query_id, 'category_' || q_category FROM q WHERE q_category IS NOT NULL
  UNION ALL SELECT query_id, 'product_' || q_product FROM q WHERE q_product IS NOT NULL)"""


def _query_nodes(spark, sf, idx):
    q = R.prepare_queries(benchmark_queries(spark, sf, True))
    qe = R.query_entities(q, idx.patterns)
    return qe.select("query_id", H.entity_node(F.col("type"), F.col("value")).alias("node")).unionByName(
        q.where(F.col("q_category").isNotNull()).select("query_id", F.concat(F.lit("category_"), "q_category").alias("node"))
    ).unionByName(
        q.where(F.col("q_product").isNotNull()).select("query_id", F.concat(F.lit("product_"), "q_product").alias("node")))


@query("graph_neighbours", S.with_views("""
SELECT query_id, node, neighbour, relation FROM (
  SELECT qn.query_id, qn.node, u.dst AS neighbour, u.relation FROM qnodes qn JOIN (
    SELECT src, dst, relation FROM edges UNION ALL SELECT dst, src, relation FROM edges) u ON qn.node = u.src)""",
    *GRAPH_SQL_CTES, EDGES_SQL, QNODES_SQL))
def graph_neighbours(spark, sf):
    idx, e, _ = _graph(spark, sf)
    return H.neighbours(e, _query_nodes(spark, sf, idx))


@query("semi_known_nodes", S.with_views("""
SELECT query_id, node FROM qnodes WHERE node IN (SELECT node FROM nodes)""", *GRAPH_SQL_CTES, NODES_SQL, QNODES_SQL))
def semi_known_nodes(spark, sf):
    idx, _, n = _graph(spark, sf)
    return H.known_nodes(_query_nodes(spark, sf, idx), n)


@query("graph_taxonomy", S.with_views("""
SELECT DISTINCT category AS src, subcategory AS dst, 'has_subcategory' AS relation FROM v_text
UNION ALL SELECT subcategory, 'solution_' || CAST(id AS VARCHAR), 'has_solution' FROM v_text"""))
def graph_taxonomy(spark, sf):
    return H.taxonomy_edges(v_text(spark, sf).withColumnRenamed("id", "doc_id"))


COOC_SQL = """WITH de AS (SELECT DISTINCT doc_id, e.type AS type, e.value AS value FROM (
  SELECT doc_id, unnest(""" + S.entity_list("text", FAST) + """) AS e FROM documents)),
n AS (SELECT type, value, count(*) AS df FROM de GROUP BY type, value)
"""


@query("join_cooccurrence", COOC_SQL + """SELECT doc_id, type, value, df, CAST(df * (df - 1) / 2 AS BIGINT) AS pairs FROM de JOIN n USING (type, value)""")
def join_cooccurrence(spark, sf):
    """Documents that share entities of any pattern, as membership rows with df and pairs."""
    return H.cooccurrence(R.doc_entities(table(spark, sf, "documents"), FAST))


@query("cooccurrence_anchors", COOC_SQL + """SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS common
FROM de a JOIN de b ON a.type = b.type AND a.value = b.value AND a.doc_id <> b.doc_id WHERE a.doc_id % 20 = 0 GROUP BY ALL""")
def cooccurrence_anchors(spark, sf):
    """J7 for a query set (ids divisible by 20) against all documents."""
    docs = table(spark, sf, "documents")
    return H.anchor_pairs(R.doc_entities(docs, FAST), docs.where("doc_id % 20 = 0"))


# ---------------------------------------------------------------- G14, G15, J8, J10
@query("product_categories", S.with_views("SELECT DISTINCT product, category FROM v_text"))
def product_categories(spark, sf):
    return v_text(spark, sf).select("product", "category").distinct()


@query("posting_lists", S.with_views("""
SELECT kind, key, count(*) AS n_docs, min(id) AS first_id, max(id) AS last_id FROM (
  SELECT 'category' AS kind, category AS key, id FROM v_text UNION ALL SELECT 'product', product, id FROM v_text
  UNION ALL SELECT 'subcategory', subcategory, id FROM v_text) GROUP BY kind, key"""))
def posting_lists(spark, sf):
    """The (kind, key) -> documents posting table, summarised per key."""
    v = v_text(spark, sf)
    long = v.select(F.lit("category").alias("kind"), F.col("category").alias("key"), "id").unionByName(
        v.select(F.lit("product").alias("kind"), F.col("product").alias("key"), "id")).unionByName(
        v.select(F.lit("subcategory").alias("kind"), F.col("subcategory").alias("key"), "id"))
    return long.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_id"),
                                           F.max("id").alias("last_id"))


@query("join_product_category", S.with_views("""
SELECT q.query_id, d.id AS doc_id FROM q
JOIN (SELECT DISTINCT product, category FROM v_text) pc ON pc.product = q.q_product
JOIN v_text d ON d.category = pc.category""", _q_cte(filters=True)))
def join_product_category(spark, sf):
    """Two hops, query product -> its categories -> documents in them."""
    q = R.prepare_queries(benchmark_queries(spark, sf, True))
    v = v_text(spark, sf)
    cats = q.select("query_id", F.col("q_product").alias("product")).join(v.select("product", "category").distinct(),
                                                                            "product")
    return cats.join(v.select(F.col("id").alias("doc_id"), "category"), "category").select("query_id", "doc_id")


@query("anti_unseen_labels", S.with_views("""
, sp AS (SELECT id, product, CASE WHEN r < floor(0.7 * n) THEN 'train' WHEN r < floor(0.7 * n) + floor(0.15 * n)
           THEN 'val' ELSE 'test' END AS split
         FROM (SELECT id, product, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM v_order))
SELECT id, product FROM sp WHERE split = 'test' AND product NOT IN (SELECT product FROM sp WHERE split = 'train')"""))
def anti_unseen_labels(spark, sf):
    """Test rows whose product was never seen in the train split (left anti join)."""
    from tessera.sources.tables import v_order
    sp = P.split_ordered(v_order(spark, sf).select("id", "product"), "id")
    train = sp.where(F.col("split") == "train").select("product").distinct()
    return sp.where(F.col("split") == "test").join(train, "product", "left_anti").select("id", "product")


@query("anti_unseen_customers", """
WITH sp AS (SELECT o_orderkey AS id, o_custkey AS customer, CASE WHEN r < floor(0.7 * n) THEN 'train' WHEN r < floor(0.7 * n) + floor(0.15 * n) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders))
SELECT id, customer FROM sp WHERE split = 'test' AND customer NOT IN (SELECT customer FROM sp WHERE split = 'train')""")
def anti_unseen_customers(spark, sf):
    """J10 for a label of many values: test orders of customers that the train split has not seen."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    sp = P.split_ordered(o, "id")
    train = sp.where(F.col("split") == "train").select("customer").distinct()
    return sp.where(F.col("split") == "test").join(train, "customer", "left_anti").select("id", "customer")


# ---------------------------------------------------------------- K10, K13, K17, K18
@query("success_rate", S.with_views("""
SELECT id, 0.7 * (CASE WHEN coalesce(resolution_helpful, true) THEN 1.0 ELSE 0.0 END)
         + 0.3 * (coalesce(satisfaction_score, 4.0) / 5.0) AS success_fast,
       0.7 * (CASE WHEN coalesce(resolution_helpful, true) THEN 1.0 ELSE 0.0 END)
         + 0.3 * (CASE WHEN coalesce(satisfaction_score, 4.0) > 0 THEN coalesce(satisfaction_score, 4.0) / 5.0
                  ELSE 0.8 END) AS success_full FROM v_text"""))
def success_rate(spark, sf):
    v = v_text(spark, sf)
    return v.select("id", R.success_rate(F.col("resolution_helpful"), F.col("satisfaction_score"), "fast").alias("success_fast"),
                    R.success_rate(F.col("resolution_helpful"), F.col("satisfaction_score"), "full").alias("success_full"))


@query("rerank_resolution", S.with_views("""
SELECT category, id, score, adjusted, rank FROM (
  SELECT category, id, score, adjusted,
         row_number() OVER (PARTITION BY category ORDER BY adjusted DESC, id) AS rank FROM (
    SELECT category, id, round(satisfaction_score / 5.0, 6) AS score,
           round(CASE WHEN resolution_time_hours < 10 THEN satisfaction_score / 5.0 * 1.2
                      WHEN resolution_time_hours > 50 THEN satisfaction_score / 5.0 * 0.8
                      ELSE satisfaction_score / 5.0 END, 6) AS adjusted FROM v_event))
WHERE rank <= 10"""))
def rerank_resolution(spark, sf):
    """x1.2 under 10 h, x0.8 over 50 h, then top 10 per category (score = satisfaction / 5)."""
    e = v_event(spark, sf).select("category", "id", "satisfaction_score", "resolution_time_hours")
    score = F.col("satisfaction_score") / 5.0
    x = e.select("category", "id", R.r6(score).alias("score"), R.r6(R.resolution_adjusted(score, F.col("resolution_time_hours"))).alias("adjusted")).withColumn("query_id", F.col("category"))
    x = x.withColumnRenamed("id", "doc_id")
    out = R.top_k(x, 10, [F.col("adjusted").desc()], "rank")
    return out.select("category", F.col("doc_id").alias("id"), "score", "adjusted", F.col("rank").cast("long").alias("rank"))


@query("dedupe_queries", """
SELECT fingerprint, count(*) AS n_queries, min(query_id) AS query_id FROM (
  SELECT item_id AS query_id, md5(concat_ws('_', text, 'None', 'None', '10')) AS fingerprint FROM benchmark
  UNION ALL
  SELECT item_id, md5(concat_ws('_', text, (['de','en','es','fr'])[CAST(item_id % 4 AS INTEGER) + 1],
                                'src' || CAST(item_id % 20 AS VARCHAR), '10')) FROM benchmark)
GROUP BY fingerprint""")
def dedupe_queries(spark, sf):
    """A batch (plain + filtered queries) deduplicated on the request fingerprint; each
    distinct request is answered once and joined back by fingerprint."""
    b = benchmark_queries(spark, sf).unionByName(benchmark_queries(spark, sf, True))
    fp = T.fingerprint(F.col("query"), F.col("category"), F.col("product"), F.lit(10))
    return b.select("query_id", fp.alias("fingerprint")).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n_queries"), F.min("query_id").alias("query_id"))


@query("query_kinds", """
SELECT kind, count(*) AS n FROM (
  SELECT 'general' AS kind FROM benchmark UNION ALL SELECT 'categorized' FROM benchmark) GROUP BY kind""")
def query_kinds(spark, sf):
    """Categorised vs general requests in a batch (plain + filtered benchmark queries)."""
    b = benchmark_queries(spark, sf).unionByName(benchmark_queries(spark, sf, True))
    kind = F.when(F.col("category").isNotNull(), "categorized").otherwise("general")
    return b.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
