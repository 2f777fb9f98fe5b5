"""Exact keyword top-k on impact-ordered postings (J2 / K1): hot terms are read only as far as they can matter.

A term's postings are ordered by weight, the largest first, and cut into blocks; a block knows its
largest weight. For a query of T terms:

1. The first blocks of its terms give partial scores; the k-th largest is a threshold that the k-th
   best document reaches for sure.
2. A document all of whose postings lie in blocks with query weight * block maximum < threshold / T
   scores less than the threshold. So candidates are the documents of the other blocks only.
3. Candidates get their whole score from the postings of their terms, by document blocks, and the best k are ranked.

Scores are rounded before they are ranked, so the threshold is lowered by the rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.products import block_scores
from tessera.operators.sampling import row_index
from tessera.sources.files import materialise

BLOCK = 128
ROUND = 6
SLACK = 2e-6


def impact_blocks(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """(term, block, top, docs) of postings (doc_id, term, weight); docs are structs (doc_id, weight). A hot term's
    postings are ranked by ranges, not in one task."""
    placed = row_index(postings.select("term", "doc_id", "weight", (-F.col("weight")).alias("less")), ["term", "less", "doc_id"])
    first = placed.groupBy("term").agg(F.min("row_idx").alias("_first"))
    block = F.floor((F.col("row_idx") - F.col("_first")) / size)
    return placed.join(first, "term").groupBy("term", block.alias("block")).agg(
        F.max("weight").alias("top"), F.collect_list(F.struct("doc_id", "weight")).alias("docs"))


def block_plan(blocks: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, term, qw, block): the blocks whose documents can be among the best k of a query (terms: query_id, term, qw)."""
    heads = terms.join(blocks.where("block = 0"), "term")
    partial = heads.select("query_id", "qw", F.explode("docs").alias("d")).groupBy("query_id", F.col("d.doc_id").alias("doc_id")).agg(F.sum(F.col("qw") * F.col("d.weight")).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "doc_id")
    # fewer than k partial scores: every document can still be among the best
    kth = partial.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == k).select("query_id", F.col("s").alias("threshold"))
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms")).join(kth, "query_id", "left")
    limit = F.coalesce((F.col("threshold") - SLACK) / F.col("terms"), F.lit(0.0))
    return terms.join(sizes, "query_id").join(blocks.select("term", "block", "top"), "term").where(F.col("qw") * F.col("top") >= limit).select("query_id", "term", "qw", "block")


def keyword_top_k(postings: DataFrame, blocks: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, keyword_score, rank): the k documents of the largest summed products, ties by id."""
    plan = materialise(block_plan(blocks, terms, k), "plan")
    found = plan.join(blocks, ["term", "block"]).select("query_id", F.explode("docs.doc_id").alias("doc_id")).distinct()
    found = materialise(found, "candidates")
    scored = block_scores(postings.select("doc_id", "term", "weight"), terms.select("query_id", "term", F.col("qw").alias("weight")), float("-inf"), pairs=found, k=k)
    scored = scored.select("query_id", "doc_id", F.round("score", ROUND).alias("keyword_score"))
    w = Window.partitionBy("query_id").orderBy(F.col("keyword_score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
