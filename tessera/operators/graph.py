"""Knowledge graph as node and edge DataFrames.

The reference keeps an in-memory graph; here nodes are ``(node, type, value)`` and edges are
``(src, dst, relation, weight)`` with one row per undirected pair (src < dst is not required,
edges are symmetric when traversed through ``undirected``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def solution_node(doc_id: Column) -> Column:
    return F.concat(F.lit("solution_"), doc_id.cast("string"))


def entity_node(etype: Column, value: Column) -> Column:
    return F.concat(etype, F.lit("_"), value)


def edges(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """H1 + H2: contains (solution-entity), belongs_to (solution-product), categorized_as
    (solution-category) and has_issues_in (product-category) edges, distinct."""
    contains = entities.where(F.length(F.trim(F.col("value"))) > 0).select(
        solution_node(F.col("doc_id")).alias("src"), entity_node(F.col("type"), F.col("value")).alias("dst"),
        F.lit("contains").alias("relation"))
    belongs = docs.select(solution_node(F.col("doc_id")).alias("src"),
                          F.concat(F.lit("product_"), F.col("product")).alias("dst"), F.lit("belongs_to").alias("relation"))
    categorized = docs.select(solution_node(F.col("doc_id")).alias("src"),
                              F.concat(F.lit("category_"), F.col("category")).alias("dst"),
                              F.lit("categorized_as").alias("relation"))
    issues = docs.select("product", "category").distinct().select(
        F.concat(F.lit("product_"), F.col("product")).alias("src"),
        F.concat(F.lit("category_"), F.col("category")).alias("dst"), F.lit("has_issues_in").alias("relation"))
    return contains.unionByName(belongs).unionByName(categorized).unionByName(issues).distinct()


def nodes(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(node, type) for solutions, entities, products and categories, distinct."""
    sol = docs.select(solution_node(F.col("doc_id")).alias("node"), F.lit("solution").alias("type"))
    ent = entities.where(F.length(F.trim(F.col("value"))) > 0).select(
        entity_node(F.col("type"), F.col("value")).alias("node"), F.col("type"))
    prod = docs.select(F.concat(F.lit("product_"), F.col("product")).alias("node"), F.lit("product").alias("type"))
    cat = docs.select(F.concat(F.lit("category_"), F.col("category")).alias("node"), F.lit("category").alias("type"))
    return sol.unionByName(ent).unionByName(prod).unionByName(cat).distinct()


def undirected(e: DataFrame) -> DataFrame:
    """Both directions of every edge, for one-hop traversal."""
    return e.select("src", "dst", "relation").unionByName(
        e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))


def neighbours(e: DataFrame, query_nodes: DataFrame) -> DataFrame:
    """H5: (query_id, node, neighbour, relation) one hop from each query node."""
    u = undirected(e)
    return query_nodes.join(u, query_nodes["node"] == u["src"]).select(
        "query_id", "node", F.col("dst").alias("neighbour"), "relation")


def known_nodes(query_nodes: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Query nodes that exist in the graph (left semi join)."""
    return query_nodes.join(all_nodes.select("node"), "node", "left_semi")


def entity_df(entities: DataFrame) -> DataFrame:
    """Document frequency of each (type, value)."""
    return entities.select("doc_id", "type", "value").distinct().groupBy("type", "value").agg(
        F.count(F.lit(1)).alias("df"))


def cooccurrence(entities: DataFrame) -> DataFrame:
    """The co-occurrence relation without listing it: (doc_id, type, value, df, pairs).

    All documents with the same (type, value) co-occur, so the membership rows with the number of
    documents df and of document pairs df(df-1)/2 state the relation exactly, however hot the value.
    """
    ent = entities.select("doc_id", "type", "value").distinct()
    return ent.join(entity_df(ent), ["type", "value"]).select(
        "doc_id", "type", "value", "df", (F.col("df") * (F.col("df") - 1) / 2).cast("long").alias("pairs"))


def anchor_pairs(entities: DataFrame, anchors: DataFrame, block: int = 10_000) -> DataFrame:
    """J7 for a query set: (doc_a, doc_b, common) of each anchor document (column doc_id) with every
    other document that shares entities. The members of a value are dealt to blocks of about
    ``block`` documents, so a hot value is many join keys."""
    ent = entities.select("doc_id", "type", "value").distinct()
    member = ent.join(entity_df(ent).select("type", "value", F.ceil(F.col("df") / block).alias("_nb")), ["type", "value"])
    a = member.join(anchors.select("doc_id").distinct(), "doc_id", "left_semi").select(
        F.col("doc_id").alias("doc_a"), "type", "value", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)).alias("_b"))
    b = member.select(F.col("doc_id").alias("doc_b"), "type", "value", F.pmod(F.xxhash64("doc_id"), F.col("_nb")).alias("_b"))
    return a.join(b, ["type", "value", "_b"]).where(F.col("doc_a") != F.col("doc_b")).groupBy("doc_a", "doc_b").agg(
        F.count(F.lit(1)).alias("common"))


def stats(n: DataFrame, e: DataFrame) -> DataFrame:
    """Node counts by type and edge counts by relation."""
    return n.groupBy(F.lit("node").alias("kind"), F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        e.groupBy(F.lit("edge").alias("kind"), F.col("relation").alias("label")).agg(F.count(F.lit(1)).alias("n")))


def taxonomy_edges(docs: DataFrame) -> DataFrame:
    """H4: category - subcategory and subcategory - solution edges, distinct."""
    cs = docs.select(F.col("category").alias("src"), F.col("subcategory").alias("dst"),
                     F.lit("has_subcategory").alias("relation")).distinct()
    ss = docs.select(F.col("subcategory").alias("src"), solution_node(F.col("doc_id")).alias("dst"),
                     F.lit("has_solution").alias("relation"))
    return cs.unionByName(ss)


def shared_values(query_entities: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, doc_id, value), distinct. Both sides are distinct before they meet, so the pairs, which grow with the
    product of both sides, stream out of the join and are never held to be compared with each other."""
    return query_entities.select("query_id", "value").distinct().join(entities.select("doc_id", "value").distinct(), "value").select("query_id", "doc_id", "value")
