"""Keyword scores by document block (K1 / K2, J2): every query's products with the postings of a block's documents.

All postings of a document lie in one block, so a score is whole when it leaves the task and the (query, document)
pairs are never shuffled by term. Filters of the queries, given pairs and a cut to the best k are applied there too.

    postings, sums of squares, documents' fields --hash of doc_id--> block
    query vectors, queries' filters (repeated for every block) --> block + vectors --> (query_id, doc_id, score)

A block has about ``ROWS`` postings; a batch of more than ``TERMS`` query terms is split by query, every part meeting
every block. A task sums the products of a few documents at a time (``CELLS``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, TERMS, CELLS = 500_000, 1_000_000, 4_000_000
#: Scores are ranked after rounding to 6 digits: so much below the k-th best is still sent on.
SLACK = 2e-6


def _passing(docs: pa.Table, at: np.ndarray, n_docs: int, queries: pa.Table, who: np.ndarray, n_queries: int, fields: Sequence[str]):
    """By field: the documents' and the queries' values as numbers (absent query value: -1), and the document of each row."""
    d_codes, q_codes = [], []
    for f in fields:
        values = pc.unique(queries[f].combine_chunks()).drop_null()
        d_codes.append(pc.fill_null(pc.index_in(docs[f].combine_chunks(), value_set=values, skip_nulls=True), -2).to_numpy(zero_copy_only=False))
        q = np.full(n_queries, -1, np.int64)
        q[who] = pc.fill_null(pc.index_in(queries[f].combine_chunks(), value_set=values, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        q_codes.append(q)
    order = np.argsort(at, kind="stable")
    return [d[order] for d in d_codes], q_codes, np.searchsorted(at[order], np.arange(n_docs + 1))


def _score_block(floor: float, fields: Sequence[str] | None, marked: bool, k: int | None):
    """A block's rows and the queries' rows to (query_id, doc_id, score) with a score above ``floor``."""
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        of_query = asked["query_id"].combine_chunks()
        queries = pc.unique(of_query)
        names = pc.unique(block["doc_id"].combine_chunks())
        n_q, n_d = len(queries), len(names)
        at = pc.index_in(block["doc_id"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        who = pc.index_in(of_query, value_set=queries).to_numpy(zero_copy_only=False).astype(np.int64)

        square = block["s"].to_numpy()
        has = np.flatnonzero(~np.isnan(square))
        norm = np.sqrt(np.bincount(at[has], square[has], n_d))
        norm[norm == 0] = 1.0  # postings that come normalised have no sums

        is_vector = np.flatnonzero(pc.is_valid(asked["term"].combine_chunks()).to_numpy(zero_copy_only=False))
        terms = pc.unique(asked["term"].combine_chunks()).drop_null()
        t = pc.index_in(asked["term"].combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False)[is_vector].astype(np.int64)
        order = np.argsort(t, kind="stable")
        q_of, q_weight = who[is_vector][order], asked["weight"].to_numpy()[is_vector][order]
        q_start = np.searchsorted(t[order], np.arange(len(terms) + 1))

        p_term = pc.fill_null(pc.index_in(block["term"].combine_chunks(), value_set=terms, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hit = np.flatnonzero(p_term >= 0)
        hit = hit[np.argsort(at[hit], kind="stable")]
        d_of, p_term, p_weight = at[hit], p_term[hit], block["weight"].to_numpy()[hit]
        many = q_start[p_term + 1] - q_start[p_term]  # products of a posting
        p_start = np.searchsorted(d_of, np.arange(n_d + 1))
        work = np.concatenate([[0], np.cumsum(many)])[p_start]  # products before each document

        if fields is not None:
            rows = np.flatnonzero(block["kind"].to_numpy() == 1)
            own = np.flatnonzero(asked["kind"].to_numpy() == 1)
            d_codes, q_codes, f_start = _passing(block.take(pa.array(rows)), at[rows], n_d, asked.take(pa.array(own)), who[own], n_q, fields)
        if marked:
            rows = np.flatnonzero(block["kind"].to_numpy() == 2)
            m_who = pc.fill_null(pc.index_in(block["query_id"].combine_chunks(), value_set=queries, skip_nulls=True), -1).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            m_at, m_who = at[rows][m_who >= 0], m_who[m_who >= 0]
            order = np.argsort(m_at, kind="stable")
            m_at, m_who = m_at[order], m_who[order]

        out_d, out_q, out_s = [], [], []
        lo = 0
        while lo < n_d:
            hi = min(lo + max(1, CELLS // max(n_q, 1)), int(np.searchsorted(work, work[lo] + CELLS, "right")) - 1)
            hi = min(max(hi, lo + 1), n_d)
            a, b = p_start[lo], p_start[hi]
            n = many[a:b]
            first = np.cumsum(n) - n
            product = np.arange(n.sum()) - np.repeat(first - q_start[p_term[a:b]], n)
            cell = np.repeat(d_of[a:b] - lo, n) * n_q + q_of[product]
            score = np.bincount(cell, np.repeat(p_weight[a:b], n) * q_weight[product], (hi - lo) * n_q).reshape(hi - lo, n_q) / norm[lo:hi, None]
            good = score > floor
            if fields is not None:
                part = slice(f_start[lo], f_start[hi])
                ok = np.ones((part.stop - part.start, n_q), bool)
                for d, q in zip(d_codes, q_codes):
                    ok &= (q < 0)[None, :] | (d[part][:, None] == q[None, :])
                any_ok = np.zeros((hi - lo, n_q), bool)
                there = np.flatnonzero(np.diff(f_start[lo:hi + 1]))
                if len(there):  # a document may have several rows
                    any_ok[there] = np.logical_or.reduceat(ok, f_start[lo:hi][there] - f_start[lo], axis=0)
                good &= any_ok
            if marked:
                x, y = np.searchsorted(m_at, [lo, hi])
                chosen = np.zeros((hi - lo, n_q), bool)
                chosen[m_at[x:y] - lo, m_who[x:y]] = True
                good &= chosen
            if k is not None and hi - lo > k:
                kth = np.partition(np.where(good, score, -np.inf), hi - lo - k, axis=0)[hi - lo - k]
                good &= score >= kth - SLACK
            d, q = np.nonzero(good)
            out_d.append(d + lo)
            out_q.append(q)
            out_s.append(score[d, q])
            lo = hi
        d, q, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_d, out_q, out_s))
        return pa.Table.from_arrays([queries.take(pa.array(q)), names.take(pa.array(d)), pa.array(s, pa.float64())], names=["query_id", "doc_id", "score"])
    return run


def block_scores(postings: DataFrame, vectors: DataFrame, floor: float = 0.0, docs: DataFrame | None = None, filters: DataFrame | None = None,
                 pairs: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): the summed products of vectors (query_id, term, weight) and postings (doc_id, term, weight), above ``floor``.

    Postings may have ``s``, a part of the document's sum of squares (term null), by whose root its scores are divided.
    ``docs`` (doc_id, fields): only these documents, and with ``filters`` (query_id, the same fields) those with the query's
    values, null passing everything. ``pairs`` (query_id, doc_id): only these. ``k``: each query's best k of the rows are among those
    returned. Written tables should be given, since both are counted."""
    fields = [c for c in docs.columns if c != "doc_id"] if docs is not None else None
    kinds = {"doc_id": postings.schema["doc_id"].dataType, "query_id": vectors.schema["query_id"].dataType}
    rows = postings.select("doc_id", "term", "weight", *(["s"] if "s" in postings.columns else [F.lit(None).cast("double").alias("s")]), F.lit(0).alias("kind"))
    asked = vectors.select("query_id", "term", "weight", F.lit(0).alias("kind"))
    blocks, parts = -(-postings.count() // ROWS) or 1, -(-vectors.count() // TERMS) or 1
    if docs is not None:
        rows = rows.unionByName(docs.select(F.col("doc_id").cast(kinds["doc_id"]).alias("doc_id"), *fields, F.lit(1).alias("kind")), allowMissingColumns=True)
    if filters is not None:
        asked = asked.unionByName(filters.select("query_id", *fields, F.lit(1).alias("kind")), allowMissingColumns=True)
    if pairs is not None:
        rows = rows.unionByName(pairs.select(F.col("doc_id").cast(kinds["doc_id"]).alias("doc_id"), "query_id", F.lit(2).alias("kind")), allowMissingColumns=True)
    block, part = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) * parts, F.pmod(F.xxhash64("query_id"), F.lit(parts))
    dealt = rows.withColumn("block", block) if parts == 1 else rows.withColumn("block", F.explode(F.sequence(block, block + parts - 1)))
    every = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long") * parts + part)
    schema = f"query_id {kinds['query_id'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}, score double"
    return dealt.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_score_block(floor, fields, pairs is not None, k), schema)
