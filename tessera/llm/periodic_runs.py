"""Periodic runs (11): maximal stretches of words that repeat with one period, found on tiles scaled to the period.

A run has smallest period q, at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` words, and no neighbouring
word continues it. Where words i and i + q are equal, i is a match of q; a run of q is a stretch of
at least ``MIN_LENGTH - q`` and ``(MIN_EXPONENT - 1) * q`` matches.

1. Octave k holds the periods 2^k .. 2^(k+1) - 1. A long enough stretch of matches holds a whole
   block of about 2^(k+1) words that begins at a multiple of 2^k (a boundary), and the same block
   stands one period further on. Block hashes of boundaries and of the places one period on are
   compared; pairs whose period is a multiple of a smaller one there are left to the lower octave.
2. Each document is cut into overlapping tiles per octave, about 2^(k+3) words apart. The tiles that
   hold such a boundary are exploded into rows (word numbers of the tile, its boundaries and periods).
3. Tiles are dealt to all tasks and solved independently: from a boundary b, the Z-function of the
   words from b on and the one of the reversed words before b tell how far the matches of each
   period reach to either side. A tile gives fragments (document, period, first match, end).
4. Fragments are shuffled by document and period, and overlapping ones are stitched. Neighbouring
   tiles overlap by more than a block and a period, so the parts of one run always overlap.
5. Documents without tiles are finished where they were read. Only the texts that have some travel
   to their runs; each is collapsed (a word goes if a run holds it after the run's first q words).

A document's runs come together in one row; there are fewer of them than it has words.

Defined cases: a null text has no words; every row of a repeated id is judged by itself (rows carry
their own key from the first written table on); a null id is carried through; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stage
from tessera.llm.registry import query, table
from tessera.llm.words import Chunk, chunks, combine, joined

MIN_EXPONENT = 4
MIN_LENGTH = 6


def block(k: int) -> int:
    """Words of the block of octave k. Period 1 needs five matches, so its block may be longer than 2^(k+1)."""
    return 4 if k == 0 else 2 << k


def stride(k: int) -> int:
    """Words between the beginnings of tiles of octave k, a multiple of 2^k."""
    return max(64, 8 << k)


@lru_cache(maxsize=4)
def smallest_factors(limit: int) -> np.ndarray:
    """The smallest prime factor of every number below ``limit``."""
    out = np.arange(limit)
    for i in range(2, math.isqrt(limit) + 1):
        if out[i] == i:
            multiples = out[i * i::i]
            multiples[multiples == np.arange(i * i, limit, i)] = i
    return out


class Grams:
    """Hashes of the 2^m words from every word on, of texts laid end to end; a gram is used only inside its text."""

    def __init__(self, names: np.ndarray, row0: np.ndarray):
        self.row, self.count = np.arange(len(row0) - 1), np.diff(row0)
        self.levels = {0: names}
        self.row0 = row0

    def level(self, m: int) -> np.ndarray:
        if m not in self.levels:
            below, half = self.level(m - 1), 1 << (m - 1)
            out = below.copy()
            out[:-half] = combine(below[:-half], below[half:]) if half < len(below) else out[:-half]
            self.levels[m] = out
        return self.levels[m]

    def shrink(self, least: int, lowest: int) -> None:
        """Forget the texts of fewer than ``least`` words once they are half of all, and the levels below ``lowest``."""
        self.levels = {m: g for m, g in self.levels.items() if m >= lowest}
        keep = self.count >= least
        if 2 * self.count[keep].sum() < self.row0[-1]:
            words = np.repeat(keep, self.count)
            self.levels = {m: g[words] for m, g in self.levels.items()}
            self.row, self.count = self.row[keep], self.count[keep]
            self.row0 = np.concatenate(([0], np.cumsum(self.count)))


def equal_blocks(g: Grams, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, boundary, period) of octave k where the block at a boundary stands again one period on."""
    size, step = block(k), 1 << k
    marks = g.level(int(math.log2(size)))
    many = np.maximum((g.count - size - step) // step + 1, 0)  # boundaries whose block fits once more behind the smallest period
    text = np.repeat(np.arange(len(many)), many)
    rel = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * step
    at = g.row0[:-1][text] + rel
    last = g.row0[1:][text] - size  # where a block may begin
    own = marks[at]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(at) >= step:
        marks = np.concatenate((marks, np.zeros(2 * step, marks.dtype)))
        for p in range(step, 2 * step):
            hit = np.flatnonzero(marks[at + p] == own)
            found.append((hit, np.full(len(hit), p)))
    else:
        for i, b in enumerate(at.tolist()):
            hit = np.flatnonzero(marks[b + step:b + 2 * step] == own[i])
            found.append((np.full(len(hit), i), hit + step))
    which = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.int64)
    period = np.concatenate([p for _, p in found]) if found else which
    inside = at[which] + period <= last[which]
    which, period = which[inside], period[inside]
    return text[which], rel[which], period


def primitive(g: Grams, k: int, text: np.ndarray, rel: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Pairs whose period is not a multiple of a smaller one of the ``period`` words at the boundary."""
    keep = np.ones(len(period), bool)
    if k == 0:
        return keep
    at = g.row0[text] + rel
    least = smallest_factors(2 << k)
    rest = period.copy()
    while True:
        more = np.flatnonzero(rest > 1)
        if not len(more):
            return keep
        f = least[rest[more]]
        d = period[more] // f
        span = period[more] - d  # words that equal those d later if d is a period; 2^(k-1) at least
        m = np.where(span >= 1 << k, k, k - 1)
        for level in (k - 1, k):
            of = np.flatnonzero(m == level)
            h, b, s = g.level(level), at[more[of]], span[of]
            tail = b + s - (1 << level)
            keep[more[of]] &= ~((h[b] == h[b + d[of]]) & (h[tail] == h[tail + d[of]]))
        rest[more] //= f
        while (again := rest[more] % f == 0).any():
            rest[more[again]] //= f[again]


def octave_tiles(c: Chunk, names: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(text, octave, first word, words, pairs) of the tiles that may hold a run; pairs are (boundary in the tile, period)."""
    g = Grams(names, c.row0)
    longest = int(c.counts().max(initial=0))
    k = 0
    while max(MIN_LENGTH, MIN_EXPONENT << k) <= longest:
        text, rel, period = equal_blocks(g, k)
        keep = primitive(g, k, text, rel, period)
        text, rel, period = text[keep], rel[keep], period[keep]
        wide, step = stride(k), 1 << k
        by = np.lexsort((period, rel, text))
        text, rel, period = text[by], rel[by], period[by]
        tile = rel // wide
        cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(tile) != 0)) + 1
        for i, j in zip(np.concatenate(([0], cut)).tolist(), [*cut.tolist(), len(text)], strict=True):
            if i == j:
                continue
            lo = max(0, int(tile[i]) * wide - step)
            hi = min(int(g.count[text[i]]), int(tile[i]) * wide + wide + 2 * step - 1 + block(k))
            row = int(g.row[text[i]])
            words = names[c.row0[row] + lo:c.row0[row] + hi]
            yield row, k, lo, np.unique(words, return_inverse=True)[1].astype("<i4"), np.stack([rel[i:j] - lo, period[i:j]], axis=1).astype("<i4")
        k += 1
        g.shrink(MIN_EXPONENT << k, k - 1)


def z_function(s: list[int], upto: int) -> list[int]:
    """For shifts 0..upto: how many words from there on equal the words from the beginning on."""
    n = len(s)
    upto = min(upto, n - 1)
    z = [0] * (upto + 1)
    z[0] = n
    left = right = 0
    for i in range(1, upto + 1):
        h = min(right - i, z[i - left]) if i < right else 0
        if i + h >= right:
            while i + h < n and s[h] == s[i + h]:
                h += 1
            left, right = i, i + h
        z[i] = h
    return z


def boundary_matches(words: list[int], b: int, most: int) -> tuple[list[int], list[int]]:
    """For every period up to ``most``: matches from boundary b on, and matches right before it."""
    forward = z_function(words[b:], most)
    before = words[:b][::-1]
    reach = min(most, len(words) - b)
    mirrored = z_function([*before, -1, *words[:b + reach][::-1]], len(before) + 1 + reach)
    at = len(before) + 1 + reach
    return forward, [mirrored[at - p] if at - p < len(mirrored) else 0 for p in range(reach + 1)]


def solve_tile(words: np.ndarray, pairs: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(period, first match, end of the matches) around the boundaries of a tile."""
    out: list[tuple[int, int, int]] = []
    reached: dict[int, int] = {}
    x = words.tolist()
    solved = None
    for b, p in pairs.tolist():
        if b < reached.get(p, 0):
            continue
        if solved != b:
            forward, backward = boundary_matches(x, b, (2 << k) - 1)
            solved = b
        out.append((p, b - backward[p], b + forward[p]))
        reached[p] = b + forward[p]
    return out


def _read(batches) -> Iterator[pa.RecordBatch]:
    """A row per document (with its text if it has tiles) and a row per tile."""
    for b in batches:
        kind = b.column(1).type
        for c in chunks(b.column(2)):
            names = c.hashes()
            tiles = list(octave_tiles(c, names))
            has = np.zeros(c.n, bool)
            has[[t[0] for t in tiles]] = True
            data, start, end = joined(c)
            view = memoryview(data)
            sha = [hashlib.sha256(view[start[i]:end[j - 1]] if j > i else b"").hexdigest() for i, j in zip(c.row0[:-1], c.row0[1:], strict=True)]
            keys = b.column(0).slice(c.first, c.n)
            texts = b.column(2).take(pa.array(np.arange(c.first, c.first + c.n), mask=~has)).cast(pa.string())
            nothing = lambda t, n=c.n: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([keys, b.column(1).slice(c.first, c.n), pa.array(c.counts()), pa.array(sha),
                                              texts, nothing(pa.int32()), nothing(pa.int64()), nothing(pa.binary()), nothing(pa.binary())], names=READ)
            for i in range(0, len(tiles), 1024):
                part = tiles[i:i + 1024]
                n = len(part)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([t[0] for t in part])), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
                                                  pa.array([t[1] for t in part], pa.int32()), pa.array([t[2] for t in part], pa.int64()),
                                                  pa.array([t[3].tobytes() for t in part], pa.binary()), pa.array([t[4].tobytes() for t in part], pa.binary())], names=READ)


READ = ["_key", "_id", "n_words", "sha", "text", "octave", "at", "words", "pairs"]


def _solve(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for key, k, at, words, pairs in zip(*[x.to_pylist() for x in b.columns], strict=True):
            for p, lo, hi in solve_tile(np.frombuffer(words, "<i4"), np.frombuffer(pairs, "<i4").reshape(-1, 2), k):
                out.append((key, p, at + lo, at + hi))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["_key", "period", "lo", "hi"])


def stitch(fragments: DataFrame) -> DataFrame:
    """Runs (_key, start, length, period) of fragments (_key, period, lo, hi): overlapping ones are parts of one run."""
    w = Window.partitionBy("_key", "period").orderBy("lo", "hi")
    reached = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("lo") <= F.col("reached"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = fragments.withColumn("reached", reached).withColumn("part", part).groupBy("_key", "period", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    runs = runs.select("_key", "start", (F.col("hi") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.where((F.col("length") >= MIN_LENGTH) & (F.col("length") >= MIN_EXPONENT * F.col("period")))


def _solved(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written document rows, and the runs of their keys."""
    rows = docs.select(F.monotonically_increasing_id().alias("_key"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    read = stage(rows.mapInArrow(_read, f"_key long, _id {kind}, n_words long, sha string, text string, octave int, at long, words binary, pairs binary"))
    tiles = read.where("octave is not null").select("_key", "octave", "at", "words", "pairs")
    tiles = tiles.repartition(F.col("_key"), F.col("octave"), F.col("at"))  # a long document's tiles go to many tasks
    fragments = tiles.mapInArrow(_solve, "_key long, period long, lo long, hi long")
    return read.where("octave is null").select("_key", "_id", "n_words", "sha", "text"), stitch(fragments)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: id, start (word number from 0), length, period (words)."""
    read, runs = _solved(docs, id_col, text_col)
    return read.where("text is not null").join(runs, "_key").select(F.col("_id").alias(id_col), "start", "length", "period")


def highest(runs: list[dict]) -> dict:
    """The run with the greatest length / period, compared exactly; runs come by start, then period."""
    best = runs[0]
    for r in runs[1:]:
        if r["length"] * best["period"] > best["length"] * r["period"]:
            best = r
    return best


def _collapse(batches) -> Iterator[pa.RecordBatch]:
    """Texts without the repeats of their runs, and what the runs amount to."""
    for b in batches:
        found = b.column(3).to_pylist()
        for c in chunks(b.column(2)):
            gone = np.zeros(len(c.start) + 1, np.int64)
            rows = []
            for i in range(c.n):
                runs = found[c.first + i] or []
                for r in runs:
                    gone[c.row0[i] + r["start"] + r["period"]] += 1
                    gone[c.row0[i] + r["start"] + r["length"]] -= 1
                best = highest(runs) if runs else dict.fromkeys(("start", "length", "period"))
                listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                rows.append((len(runs), best["start"], best["length"], best["period"], hashlib.sha256(listed.encode()).hexdigest()))
            kept = np.cumsum(gone[:-1]) == 0
            row0 = np.concatenate(([0], np.cumsum(kept)))[c.row0]
            data, start, end = joined(Chunk(c.first, c.n, c.data, c.bounds, c.start[kept], c.end[kept], row0))
            texts = [data[start[i]:end[j - 1]].tobytes() if j > i else b"" for i, j in zip(row0[:-1], row0[1:], strict=True)]
            columns = [pa.array(x, pa.string() if k == 4 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), b.column(1).slice(c.first, c.n), *columns, pa.array(texts, pa.binary()).cast(pa.string())],
                                             names=["_id", "n_words", "n_runs", "start", "length", "period", "runs_sha256", "collapsed"])


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_runs, start, length, period and exponent_milli of the highest run,
    runs_sha256, collapsed_sha256, and collapsed: the kept words of a text with runs (null where nothing goes)."""
    read, runs = _solved(docs, id_col, text_col)
    lists = runs.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    some = read.where("text is not null").join(lists, "_key", "left").select("_id", "n_words", "text", "runs")
    kind = dict(read.dtypes)["_id"]
    solved = some.mapInArrow(_collapse, f"_id {kind}, n_words long, n_runs long, start long, length long, period long, runs_sha256 string, collapsed string")
    solved = solved.withColumn("collapsed_sha256", F.sha2("collapsed", 256)).withColumn("collapsed", F.when(F.col("n_runs") > 0, F.col("collapsed")))
    none = F.lit(None).cast("long")
    plain = read.where("text is null").select("_id", "n_words", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"),
                                              F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), F.lit(None).cast("string").alias("collapsed"), F.col("sha").alias("collapsed_sha256"))
    out = solved.unionByName(plain)
    return out.select(F.col("_id").alias(id_col), "n_words", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256", "collapsed")


def with_repeats(text: Column, doc_id: Column) -> Column:
    """The text of the query: every tenth document (by checksum) ends in a stretch that repeats."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))))

    planted = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(WORD), planted).otherwise(text)


#: crc32 of the decimal id, byte by byte; then periods whose multiples match three times, their stretches of matches, and the smallest period of each.
ORACLE = r"""
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) AS h FROM documents, t),
p AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS yes, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a, h // 10 AS g FROM h),
o AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM p),
s AS (SELECT doc_id, i, CASE WHEN yes AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END AS src FROM o JOIN p USING (doc_id)),
w AS MATERIALIZED (SELECT s.doc_id, s.i, o.word FROM s JOIN o ON o.doc_id = s.doc_id AND o.i = s.src),
q AS (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM p),
b AS (SELECT doc_id, q, unnest(range(0, n - 3 * q, q)) AS b FROM q),
c AS (SELECT DISTINCT b.doc_id, q FROM b JOIN w w0 ON w0.doc_id = b.doc_id AND w0.i = b JOIN w w1 ON w1.doc_id = b.doc_id AND w1.i = b + q AND w1.word = w0.word
      JOIN w w2 ON w2.doc_id = b.doc_id AND w2.i = b + 2 * q AND w2.word = w0.word),
m AS (SELECT c.doc_id, c.q, x.i, x.i - row_number() OVER (PARTITION BY c.doc_id, c.q ORDER BY x.i) AS island
      FROM c JOIN w x ON x.doc_id = c.doc_id JOIN w y ON y.doc_id = c.doc_id AND y.i = x.i + c.q AND y.word = x.word),
l AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM m GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, n, min(q) AS q FROM l GROUP BY doc_id, s, n),
best AS (SELECT doc_id, s, n, q FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n / q DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q)) AS sha FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),
kept AS (SELECT w.doc_id, sha256(string_agg(word, ' ' ORDER BY w.i)) AS sha FROM w ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
       coalesce(listed.sha, sha256('')) AS runs_sha256, coalesce(kept.sha, sha256('')) AS collapsed_sha256
FROM p LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op11_periodic_runs", ORACLE)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return collapse_runs(docs.withColumn("text", with_repeats(F.col("text"), F.col("doc_id")))).drop("n_words", "collapsed")
