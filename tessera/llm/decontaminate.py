"""Benchmark decontamination (4), native: winnowing.

Words are k-gram hashed and every window of w consecutive hashes keeps its smallest (the leftmost of
equals). Two texts that share a span of k + w - 1 words hold the same window there, hence the same
kept fingerprint: with k = 5 and w = 6 no shared span of ``span`` = 10 words is missed. Test and
training fingerprints are joined; a hit is extended word by word to both sides, comparing the words
themselves, and counts if the run reaches 10 words. As every shared span contains a kept hit within
five words of either end, extending by five words to each side finds every covered word.
Items of fewer than 10 words are one window: all n-grams of the few lengths that occur (1 to 9)
are probed for them.

The benchmark's fingerprints are written and counted; up to ``BROADCAST_ROWS`` they are sent to the
scan, where they are probed without a shuffle of the documents; beyond, the fingerprints are joined by a shuffle.
A fingerprint carries the few words that extending needs. All steps are built-in expressions.

Defined cases: null texts and texts without words have no hit; items without words have no window;
rows that repeat an id are judged each on its own text; a null id is an id; empty tables give empty
results (no document, or no hit); other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stage
from tessera.llm.registry import query, table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
K = 5
W = SPAN - K + 1
REACH = SPAN - K
BROADCAST_ROWS = 1_000_000


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORDS), F.lit(0))


def gram(hashes: str, i: Column, n: int) -> Column:
    """Hash of the n word hashes from position i (0-based)."""
    return F.xxhash64(F.lit(n), *[F.get(F.col(hashes), i + d) for d in range(n)])


def fingerprints(words: DataFrame, shorts: list[int], short_items: bool = False) -> DataFrame:
    """Adds ``grams``, an array of (fp, pos, n, near): winnowed k-grams, and all n-grams of the lengths ``shorts`` (these with -n).

    ``near`` are the words that extending may reach: ``REACH`` to each side of a k-gram. They travel
    with the gram, as the text must not: a row's grams leave an explode together.

    With ``short_items`` the texts of fewer than ``SPAN`` words give their one whole-text gram only.
    """
    h = words.withColumn("_h", F.transform("words", lambda x: F.xxhash64(x))).withColumn("_n", F.size("words"))

    def struct(fp: Column, pos: Column, n: int, reach: int = 0) -> Column:
        near = F.transform(F.sequence(pos - reach, pos + (n + reach - 1)), lambda j: F.get(F.col("words"), j))
        return F.struct(fp.alias("fp"), pos.cast("int").alias("pos"), F.lit(n if reach else -n).alias("n"), near.alias("near"))

    def span(last: Column) -> Column:
        return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    none = F.array().cast("array<struct<fp:bigint,pos:int,n:int,near:array<string>>>")
    h = h.withColumn("_g", F.transform(span(F.col("_n") - K), lambda i: gram("_h", i, K)))
    # the smallest hash of each window, then the leftmost position that holds it (no slices: each would copy the whole array)
    h = h.withColumn("_m", F.transform(span(F.col("_n") - SPAN), lambda i: F.least(*[F.get(F.col("_g"), i + d) for d in range(W)])))

    def leftmost(m: Column, i: Column) -> Column:
        at = F.lit(W - 1)
        for d in range(W - 2, -1, -1):
            at = F.when(F.get(F.col("_g"), i + d) == m, F.lit(d)).otherwise(at)
        return i + at
    kept = F.array_distinct(F.transform("_m", leftmost))
    long_grams = F.transform(kept, lambda p: struct(F.get(F.col("_g"), p), p, K, REACH))
    if short_items:
        whole = none
        for n in range(1, SPAN):
            whole = F.when(F.col("_n") == n, F.array(struct(gram("_h", F.lit(0), n), F.lit(0), n))).otherwise(whole)
        grams = F.when(F.col("_n") >= SPAN, long_grams).otherwise(whole)
    else:
        parts = [F.when(F.col("_n") >= SPAN, long_grams).otherwise(none)]
        def every(n: int) -> Column:
            return F.transform(span(F.col("_n") - n), lambda i: struct(gram("_h", i, n), i, n))
        parts += map(every, shorts)
        grams = F.concat(*parts)
    return h.withColumn("grams", grams).drop("_h", "_g", "_m")


def item_index(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """(fp, n, item, around) of the items, laid out like the documents' grams, and the lengths below ``SPAN`` that occur."""
    words = items.select(F.col(id_col).cast("string").alias("item"), split_words(F.col(text_col)).alias("words"))
    # explode_outer: plain explode infers a filter on the array's size, which is pushed below and evaluates everything again
    g = fingerprints(words, [], short_items=True).select("item", "words", F.explode_outer("grams").alias("g")).where("g.fp is not null")
    index = stage(g.select(F.col("g.fp").alias("fp"), F.col("g.n").alias("n"), "item", F.col("g.near").alias("around")).distinct())
    shorts = [-r.n for r in index.where("n < 0").select("n").distinct().orderBy("n").collect()]  # at most nine
    return index, sorted(shorts)


def hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """Written rows: (_id, _th, kind): one marker a document row (n_words), one a verified hit (item, lo, hi)."""
    index, shorts = item_index(items, item_id, item_text)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"), split_words(F.col(text_col)).alias("words"))
    # a marker gram in every row, so that one row a document leaves the probe
    marker = F.array(F.struct(F.lit(0).cast("long").alias("fp"), F.lit(-1).alias("pos"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("near")))
    probes = fingerprints(base, shorts).select("_id", "_th", "_n", F.explode_outer(F.concat(marker, F.col("grams"))).alias("g"))
    probes = probes.select("_id", "_th", F.col("_n").alias("n_words"), F.col("g.fp").alias("fp"), F.col("g.pos").alias("pos"), F.col("g.n").alias("n"), F.col("g.near").alias("near"))
    one = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("fp"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("item"), F.array().cast("array<string>").alias("around"))
    if index.count() <= BROADCAST_ROWS:
        found = probes.join(F.broadcast(index.unionByName(one)), ["fp", "n"])
    else:
        found = probes.where("n <> 0").join(index, ["fp", "n"]).unionByName(probes.where("n = 0").join(F.broadcast(one), ["fp", "n"]))
    # equal words around the hit, position by position; beyond either text is unequal
    found = found.withColumn("_same", F.transform("near", lambda x, i: F.coalesce(F.get(F.col("around"), i) == x, F.lit(False)))).drop("near", "around")
    off, size = F.when(F.col("n") > 0, REACH).otherwise(0), F.abs("n")

    def run(flags: Column) -> Column:
        """Length of the leading run of true."""
        stop = F.array_position(flags, False)
        return F.when(stop == 0, F.size(flags)).otherwise(stop - 1).cast("int")

    left = run(F.reverse(F.slice("_same", F.lit(1), off)))
    right = run(F.slice("_same", off + size + 1, F.lit(SPAN)))
    core = F.forall(F.slice("_same", off + 1, size), lambda x: x)
    found = found.withColumns({"_l": left, "_r": right, "_core": core})
    good = F.col("_core") & ((F.col("n") < 0) | (F.col("_l") + size + F.col("_r") >= SPAN))
    found = found.where((F.col("n") == 0) | good)
    return stage(found.select("_id", "_th", "n_words", "item", (F.col("n") == 0).alias("marker"), (F.col("pos") - F.col("_l")).alias("lo"), (F.col("pos") + size + F.col("_r")).alias("hi")))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted item ids), spans (covered word spans), _th (hash of the text)."""
    found = hits(docs, items, id_col, text_col, item_id, item_text)
    key = ["_id", "_th"]
    rows = found.where("marker").groupBy(*key).agg(F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("_rows"))
    real = found.where("not marker")
    spans = real.groupBy(*key, "lo").agg(F.max("hi").alias("hi")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_spans"))
    named = real.select(*key, "item").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    facts = spans.join(named, on=[spans["_id"].eqNullSafe(named["_id"]), spans["_th"] == named["_th"]]).select(
        spans["_id"].alias("_hid"), spans["_th"].alias("_hth"), "_spans", "items")
    out = rows.join(facts, F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_th") == F.col("_hth")), "left")
    # merge overlapping spans: (lo, hi) in order, each counted from the furthest end so far
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    merged = F.aggregate("_spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["hi"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(a["end"], s["lo"]))).alias("n")))
    out = out.withColumn("n_hit", F.coalesce(merged["n"], F.lit(0)).cast("long"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    return out.select(F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_hit",
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("_spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"), "_th")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns."""
    bad = stage(decontaminate(docs, items, id_col, text_col).where("n_hit > 0").select(F.col(id_col).alias("__t_bid"), F.col("_th").alias("__t_bth")).distinct())
    th = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.withColumn("__t_th", th).join(bad, F.col(id_col).eqNullSafe(F.col("__t_bid")) & (F.col("__t_th") == F.col("__t_bth")), "left_anti").drop("__t_th")


ORACLE = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM benchmark),
bx AS (SELECT item_id, least(len(w), {SPAN}) AS n, unnest(range(1, greatest(len(w) - {SPAN}, 0) + 2)) AS i, w FROM bw WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM bx),
dx AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
m AS (SELECT dx.doc_id, dx.i, dx.n, g.item_id FROM dx JOIN g ON g.n = dx.n AND g.s = array_to_string(dx.w[dx.i : dx.i + dx.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op4_decontaminate", ORACLE)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
