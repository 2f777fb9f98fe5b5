"""Substring dedup (7): recompression.

Words are named by a 64-bit hash, so equal words have equal names everywhere. Rounds then compress:
round 0 names runs of a repeated word, rounds 1 and 2 name pairs (a name's hash bit, drawn anew each
round, splits the names into left and right halves; a left symbol directly before a right one merges
with it). A pair's name is a function of its parts, so equal substrings get equal interior symbols
in every document. The round in which the boundary between two words disappears depends on three
words to either side only, so the parse of a shared window is the same wherever it stands.

1. Every 13-word window chooses, among its interior boundaries with three words on both sides, the
   one that survives the most rounds (ties by name, then leftmost). Equal windows choose alike. The
   chosen boundaries (about two in nine) are anchors, named by the six words around them.
2. Anchor names that occur in two documents are the shared high-level symbols: one aggregation.
3. Documents whose whole word sequence is a copy of an earlier one's (the symbol of the whole text)
   are done: every word goes. The others that hold shared anchors are written with their positions.
4. Only windows at shared anchors are verified: by 128-bit names of their thirteen words, of which the
   smallest document id is found; a window whose name starts in a smaller id covers its words.

Defined cases: null texts have no words; fewer than 13 words have no window; a null id is larger than
every id; rows that repeat an id are not earlier than each other; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.registry import query, table
from tessera.llm.words import U, Chunk, chunks, combine, joined, mix

WINDOW = 13
#: Words that decide a boundary's level, to either side.
RADIUS = 3
CHOICES = WINDOW - 2 * RADIUS + 1
LAST = (1 << 63) - 1


def levels(w: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The round (0, 1, 2) in which the boundary before each word disappears, 3 if none; ``head`` marks first words of texts.

    Boundaries with fewer than ``RADIUS`` words of the text on either side are not meaningful.
    """
    n = len(w)
    same = np.zeros(n, bool)  # as the word before, in the same text
    same[1:] = (w[1:] == w[:-1]) & ~head[1:]
    run = same.copy()
    run[:-1] |= same[1:]
    bit = (mix(w ^ U(0xA5A5A5A5)) & U(1)).astype(bool)
    free = ~run
    merge = np.zeros(n, bool)  # round 1: with the word before
    merge[1:] = free[1:] & free[:-1] & bit[1:] & ~bit[:-1] & ~head[1:]
    pair = np.zeros(n, U)
    pair[1:] = combine(w[:-1], w[1:])
    ends = np.where(merge, pair, w)  # name of the symbol that ends at each word
    starts = w.copy()  # and of the one that starts there
    starts[:-1] = np.where(merge[1:], pair[1:], w[:-1])
    left = (mix(ends ^ U(0x5A5A5A5A)) & U(1)).astype(bool)
    right = (mix(starts ^ U(0x5A5A5A5A)) & U(1)).astype(bool)
    second = np.zeros(n, bool)
    second[1:] = free[1:] & free[:-1] & ~merge[1:] & right[1:] & ~left[:-1] & ~head[1:]
    return np.where(same, 0, np.where(merge, 1, np.where(second, 2, 3)))


class Parse:
    """Words, window starts and anchors of a chunk."""

    def __init__(self, c: Chunk):
        self.w = w = c.hashes()
        head = np.zeros(len(w), bool)
        count = c.counts()
        head[c.row0[:-1][count > 0]] = True
        left = np.repeat(c.row0[1:], count) - np.arange(len(w))  # words to the end of the text
        self.start = np.flatnonzero(left >= WINDOW)
        if not len(self.start):
            self.chosen = self.start
            return
        n = len(w) - 2 * RADIUS + 1
        name = w[:n]
        for d in range(1, 2 * RADIUS):
            name = combine(name, w[d:d + n])
        # name[i] and rank[i] belong to the boundary before word i + RADIUS
        self.name = name
        rank = (levels(w, head)[RADIUS:RADIUS + n].astype(U) << U(62)) | (mix(name) >> U(2))
        best = rank[self.start]
        for d in range(1, CHOICES):
            best = np.maximum(best, rank[self.start + d])
        at = np.full(len(self.start), CHOICES - 1)
        for d in range(CHOICES - 2, -1, -1):
            at = np.where(rank[self.start + d] == best, d, at)
        self.chosen = self.start + at  # index into name, for each window

    def windows(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the windows that start at these words."""
        one, two = np.full(len(start), 1, U), np.full(len(start), 2, U)
        for d in range(WINDOW):
            x = self.w[start + d]
            one, two = combine(one, x), combine(two, mix(x + U(77)))
        return one, two


def _facts(batches):
    """Of each text: number of words, 128-bit name of the word sequence, digest of the words joined by a space."""
    for b in batches:
        out = [[], [], [], []]
        for c in chunks(b.column(2)):
            w, text = c.hashes(), c.rows()
            at = (np.arange(len(w)) - np.repeat(c.row0[:-1], c.counts())).astype(U)
            for k, seed in enumerate((1, 2)):
                total = np.zeros(c.n, U)
                np.add.at(total, text, mix(combine(w + U(seed), at)))
                out[k + 1].append(total)
            out[0].append(c.counts())
            data, start, end = joined(c)
            view = memoryview(data)
            out[3] += [hashlib.sha256(view[int(start[i]):int(end[j - 1])] if j > i else b"").digest() for i, j in zip(c.row0[:-1], c.row0[1:], strict=True)]
        if out[0]:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(out[0])), *[pa.array(np.concatenate(out[k]).view(np.int64)) for k in (1, 2)], pa.array(out[3], pa.binary())],
                                             names=["id", "th", "n_words", "s1", "s2", "sha"])


def _anchors(positions: bool):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(b.column(1)):
                p = Parse(c)
                if not len(p.start):
                    continue
                at = np.unique(p.chosen)
                text = np.searchsorted(c.row0, at, side="right") - 1
                name, doc = p.name[at].view(np.int64), ids[c.first + text].astype(np.int64)
                if positions:
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(doc), pa.array((at - c.row0[text]).astype(np.int32))], names=["name", "id", "at"])
                else:
                    order = np.lexsort((doc, name))
                    name, doc = name[order], doc[order]
                    new = np.ones(len(name), bool)
                    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(name[new]), pa.array(doc[new])], names=["name", "id"])
    return run


def _flat(column: pa.Array, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row (0..n-1) and value of each element of a list column's rows first..first+n."""
    part = column.slice(first, n)
    size = part.value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(n), size), part.flatten().to_numpy(zero_copy_only=False)


def _windows(batches):
    for b in batches:
        ids, ths = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for c in chunks(b.column(2)):
            p = Parse(c)
            if not len(p.start):
                continue
            row, at = _flat(b.column(3), c.first, c.n)
            fits = at < c.counts()[row]
            shared = np.zeros(len(p.w) + 1, bool)
            shared[c.row0[row[fits]] + at[fits]] = True
            start = p.start[shared[p.chosen]]
            one, two = p.windows(start)
            text = np.searchsorted(c.row0, start, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(ids[c.first + text].astype(np.int64)), pa.array(ths[c.first + text].astype(np.int64)), pa.array((start - c.row0[text]).astype(np.int32))],
                                             names=["w1", "w2", "id", "th", "start"])


def _cut(batches):
    """Digest of what is left, and the spans of words that go."""
    for b in batches:
        n, shas, spans = [], [], []
        for c in chunks(b.column(2)):
            row, start = _flat(b.column(3), c.first, c.n)
            mark = np.zeros(len(c.start) + 1, np.int64)
            np.add.at(mark, c.row0[row] + start, 1)
            np.add.at(mark, c.row0[row] + start + WINDOW, -1)
            gone = np.cumsum(mark)[:-1] > 0
            view = memoryview(c.data)
            for i, j in zip(c.row0[:-1].tolist(), c.row0[1:].tolist(), strict=True):
                g = gone[i:j]
                left = np.flatnonzero(~g) + i
                shas.append(hashlib.sha256(b" ".join([bytes(view[int(c.start[k]):int(c.end[k])]) for k in left.tolist()])).digest())
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                n.append(int(g.sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(shas, pa.binary()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
                                         names=["id", "th", "n_removed", "left", "spans"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, spans (removed word ranges lo..hi), kept_sha256."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("t"))
    facts = stage(rows.select("id", "th", "t").mapInArrow(_facts, "id long, th long, n_words long, s1 long, s2 long, sha binary"))
    same = facts.groupBy("s1", "s2", "n_words").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi and n_words >= %d" % WINDOW)
    copies = stage(facts.join(same, ["s1", "s2", "n_words"]).where("id > lo").select("id", "th").distinct())

    names = rows.select("id", "t").mapInArrow(_anchors(False), "name long, id long")
    repeated = stage(names.groupBy("name").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("name"))
    held = rows.select("id", "t").mapInArrow(_anchors(True), "name long, id long, at int").join(repeated, "name", "left_semi")
    held = stage(held.groupBy("id").agg(F.collect_list("at").alias("at")))
    # texts that hold shared anchors and are no copies
    work = rows.select("id", "th", "t").join(held, "id").join(copies, ["id", "th"], "left_anti")
    work = stage(work.select("id", "th", "t", "at"))

    windows = "w1 long, w2 long, id long, th long, start int"
    first = stage(work.mapInArrow(_windows, windows).groupBy("w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("w1", "w2", "lo"))
    found = work.mapInArrow(_windows, windows).join(first, ["w1", "w2"]).where("id > lo")
    starts = stage(found.groupBy("id", "th").agg(F.collect_list("start").alias("starts")))
    cut = work.select("id", "th", "t").join(starts, ["id", "th"]).select("id", "th", "t", "starts")
    cut = cut.mapInArrow(_cut, "id long, th long, n_removed long, left binary, spans array<struct<lo:int,hi:int>>").dropDuplicates(["id", "th"])

    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("n_words").cast("int").alias("hi")))
    out = facts.select("id", "th", "n_words", "sha").join(cut, ["id", "th"], "left").join(copies.withColumn("copy", F.lit(True)), ["id", "th"], "left")
    is_copy = F.coalesce("copy", F.lit(False))
    kind = dict(docs.select(id_col).dtypes)[id_col]
    return out.select(F.when(F.col("id") != LAST, F.col("id")).cast(kind).alias(id_col), "n_words",
                      F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                      F.when(is_copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>"))).alias("spans"),
                      F.when(is_copy, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("left", "sha")))).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT s, min(doc_id) AS lo FROM x GROUP BY s),
g AS (SELECT DISTINCT x.doc_id, unnest(range(i, i + {WINDOW})) AS p FROM x JOIN f USING (s) WHERE lo < x.doc_id),
u AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT u.doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS kept FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.p = g.p GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query("op7_substring_dedup", ORACLE)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")
