"""Quality rules (13): repetition inside a text, measured with a suffix array over its words.

1. The words of a batch of texts get names; the suffixes of each text are sorted by prefix doubling.
   A round re-sorts only suffixes that still share their first k words with another one.
2. Kasai's scan gives the longest common prefix (LCP) of neighbours in that order. It starts where
   neighbours share two words; shorter LCPs are known from the round that parted them.
3. Intervals of the LCP array are the right-maximal repeated substrings; those whose occurrences
   have different words before them are the maximal repeats. Each position's longest repeat is the
   larger of its two LCPs, so the union of all occurrences of all maximal repeats of ``min_repeat``
   or more words is the union of ``[i, i + longest(i))``.
4. A text is kept if that union covers at most ``max_covered`` of its words, the longest repeat has
   at most ``max_longest`` words, and the base rules hold (``MIN_WORDS``, words in repeated
   three-word windows, which are the positions of LCP three and more).

A text is one row and is solved in the task that reads it; texts are never cut, and nothing is
shuffled. Memory is a constant number of arrays of the words of one chunk (1 MB of texts, or one
longer text).

Defined cases: a null text has no words and fails the base rules, as an empty one does; every row
of a repeated id is judged by itself; a null id is carried through; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.registry import query, table
from tessera.llm.words import Chunk, chunks, split, sums

#: Words of the shortest repeat whose spans count as covered.
MIN_REPEAT = 8
#: Share of the words that repeats may cover.
MAX_COVERED = 0.4
#: Words of the longest repeat a text may hold.
MAX_LONGEST = 50
MIN_WORDS = 50
#: Per cent of the words that repeated three-word windows may hold.
MAX_REPEAT_WORDS = 50
WINDOW = 3

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def suffix_order(names: np.ndarray, rows: np.ndarray, row0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by (text, words), and for each place how many words it surely shares with the one before it.

    The second array is exact below 2 and a lower bound (a power of two) from 2 on.
    """
    n = len(names)
    low = np.zeros(n, np.int64)
    if n == 0:
        return np.zeros(0, np.int64), low
    _, word = np.unique(names, return_inverse=True)
    key = rows.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    stop = row0[1:][rows]
    open_ = ~(new & np.concatenate((new[1:], [True])))  # places in groups of two and more
    places = np.flatnonzero(open_)
    same = ~new  # shares its first k words with the place before
    k = 1
    while len(places):
        low[places[same[places]]] = k
        suffix = order[places]
        after = np.minimum(suffix + k, n - 1)
        second = np.where(suffix + k < stop[suffix], rank[after] + 1, 0)
        pair = rank[suffix] * (n + 2) + second
        by = np.argsort(pair, kind="stable")
        suffix, pair = suffix[by], pair[by]
        order[places] = suffix
        first = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[suffix] = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
        same[places] = ~first
        places = places[~(first & np.concatenate((first[1:], [True])))]
        k *= 2
    return order, low


def common_prefixes(names: np.ndarray, stop: np.ndarray, order: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Words that each place of the order shares with the one before it (Kasai, in text order)."""
    lcp = low.copy()
    places = np.flatnonzero(low >= 2)
    if not len(places):
        return lcp
    here = order[places]
    by = np.argsort(here)
    places, here = places[by], here[by]
    before = order[places - 1]
    word = names.tolist()
    found = []
    h = last = 0
    for i, j, end_i, end_j, least in zip(here.tolist(), before.tolist(), stop[here].tolist(), stop[before].tolist(), low[places].tolist(), strict=True):
        h = max(h - (i - last), least)
        most = min(end_i - i, end_j - j)
        while h < most and word[i + h] == word[j + h]:
            h += 1
        found.append(h)
        last = i
    lcp[places] = found
    return lcp


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, length) of the LCP intervals of ``least`` and more words."""
    places = np.flatnonzero(lcp >= least)
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (first place, length), lengths ascending
    last = -1
    for p, h in zip(places.tolist(), lcp[places].tolist(), strict=True):
        if p != last + 1:
            out.extend((a, last, n) for a, n in stack)
            stack = []
        first = p - 1
        while stack and stack[-1][1] > h:
            first, n = stack.pop()
            out.append((first, p - 1, n))
        if not stack or stack[-1][1] < h:
            stack.append((first, h))
        last = p
    out.extend((a, last, n) for a, n in stack)
    got = np.array(out, np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


def left_maximal(names: np.ndarray, start: np.ndarray, order: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Intervals whose occurrences do not all have the same word before them (a text's begin counts as its own)."""
    edge = order == start[order]
    before = names[np.maximum(order - 1, 0)]
    differs = np.zeros(len(order) + 1, np.int64)
    differs[1:-1] = (before[1:] != before[:-1]) | edge[1:] | edge[:-1]
    run = np.cumsum(differs)
    return run[last] > run[first]


def covered(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n words lie in any of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


class Repeats:
    """Longest repeat at every word of a chunk of texts, and the maximal repeats of ``least`` and more words."""

    def __init__(self, c: Chunk, least: int):
        names, rows = c.hashes(), c.rows()
        order, low = suffix_order(names, rows, c.row0)
        lcp = common_prefixes(names, c.row0[1:][rows], order, low)
        self.longest = np.zeros(len(names), np.int64)
        self.longest[order] = np.maximum(lcp, np.append(lcp[1:], 0)) if len(lcp) else lcp
        first, last, length = intervals(lcp, least)
        keep = left_maximal(names, c.row0[:-1][rows], order, first, last) if len(first) else np.zeros(0, bool)
        self.order = order
        self.first, self.last, self.length = first[keep], last[keep], length[keep]


def duplicate_lines(c: Chunk) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of the text."""
    lines = split(c.first, c.data, c.bounds, NEWLINE)
    has_word = np.searchsorted(c.start, lines.end) > np.searchsorted(c.start, lines.start)
    rows = lines.rows()[has_word].astype(np.uint64)
    keys = np.stack([rows, lines.hashes(1)[has_word], (lines.end - lines.start)[has_word].astype(np.uint64)], axis=1)
    out = np.bincount(rows.astype(np.int64), minlength=c.n)
    if len(keys):
        out = out - np.bincount(np.unique(keys, axis=0)[:, 0].astype(np.int64), minlength=c.n)
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_maximal_repeats")


def measure(c: Chunk, least: int) -> list[np.ndarray]:
    """The ``COLUMNS`` of each text of a chunk."""
    rows, n = c.rows(), len(c.start)
    points = np.concatenate(([0], np.cumsum((c.data & 0xC0) != 0x80)))  # bytes that begin a code point
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[c.data])))
    r = Repeats(c, least)
    again = np.flatnonzero(r.longest >= WINDOW)
    window = covered(n, again, np.full(len(again), WINDOW))
    long = np.flatnonzero(r.longest >= least)
    spans = covered(n, long, r.longest[long])
    longest = np.zeros(c.n, np.int64)
    np.maximum.at(longest, rows, r.longest)
    return [c.counts(), sums(points[c.end] - points[c.start], c.row0), symbols[c.bounds[1:]] - symbols[c.bounds[:-1]], duplicate_lines(c),
            sums(window.astype(np.int64), c.row0), sums(spans.astype(np.int64), c.row0), longest, np.bincount(rows[r.order[r.first]], minlength=c.n)]


def _measured(least: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                ids = b.column(0).slice(c.first, c.n)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x.astype(np.int64)) for x in measure(c, least)]], names=["_id", *COLUMNS])
    return run


def _listed(least: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                r = Repeats(c, least)
                at = r.order[r.first]
                row = c.rows()[at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + c.first)), pa.array(at - c.row0[row]), pa.array(r.length), pa.array(r.last - r.first + 1)],
                                                 names=["_id", "start", "length", "occurrences"])
    return run


def _input(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return read, dict(read.dtypes)["_id"]


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """One row per maximal repeat of a text: id, start (word number of one occurrence), length in words, occurrences."""
    read, kind = _input(docs, id_col, text_col)
    return read.mapInArrow(_listed(min_repeat), f"_id {kind}, start long, length long, occurrences long").withColumnRenamed("_id", id_col)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT,
                  max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of ``docs``: id, the ``COLUMNS``, base_failed, kept."""
    read, kind = _input(docs, id_col, text_col)
    out = read.mapInArrow(_measured(min_repeat), f"_id {kind}, " + ", ".join(f"{x} long" for x in COLUMNS))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_WORDS * F.col("n_words"))
    repeats = (F.col("n_covered") <= F.lit(max_covered) * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", base).withColumn("kept", ~base & repeats).withColumnRenamed("_id", id_col)


#: A word is covered by repeats of k or more words where a window of k words that occurs again covers it.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
g AS (SELECT doc_id, i, n,
        string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS g3,
        string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g8,
        string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING) AS g51 FROM w),
r AS (SELECT doc_id, i, i + 2 <= n AND count(*) OVER (PARTITION BY doc_id, i + 2 <= n, g3) > 1 AS r3,
        i + 7 <= n AND count(*) OVER (PARTITION BY doc_id, i + 7 <= n, g8) > 1 AS r8,
        i + 50 <= n AND count(*) OVER (PARTITION BY doc_id, i + 50 <= n, g51) > 1 AS r51 FROM g),
c AS (SELECT doc_id, bool_or(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
        bool_or(r8) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8, r51 FROM r),
k AS (SELECT doc_id, count(*) FILTER (c3) AS n3, count(*) FILTER (c8) AS n8, bool_or(r51) AS too_long FROM c GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
b AS (SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n3, 0) AS n_repeat_words, coalesce(n8, 0) AS n_covered, coalesce(too_long, false) AS too_long
      FROM d JOIN l USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * n_covered <= 4 * n_words AND NOT too_long AS kept
FROM b
"""


@query("op13_quality_rules", ORACLE)
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, words covered by long repeats, and the verdict, for every document."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat", "n_maximal_repeats")
