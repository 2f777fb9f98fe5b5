"""Secret scans (6), native: rules, then character Markov models compared by log-likelihood ratio.

1. One scan takes every text's rule spans (kinds ``assign``, ``access``, ``hex``) and its candidate
   runs: at least ``MIN_RUN`` characters of ``RUN``, not digits alone, that no rule span overlaps. Only these few
   strings, with code-point positions, are written on.
2. Labelled samples: the values that the rules found are random strings, candidate runs without
   a digit are ordinary identifiers (runs with digits carry no label); of each at most ``SAMPLE`` distinct ones, in the order of a hash. Their character
   transitions are counted (at most 2 x 128 x 128 numbers), smoothed, and turned into one table of
   log-likelihood ratios.
3. A candidate whose ratio per transition is at least ``THRESHOLD`` is a span of kind ``markov``.

All steps are built-in expressions; the table of ratios is a constant of the second plan.

Defined cases: null and empty texts have no span; without samples of both labels no candidate is
reported; rows that repeat an id are scanned each by itself; a null id is an id; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.registry import query, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Same spans as [0-9a-f]+ of 24 or more: a run is maximal from its first character either way.
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]"
MIN_RUN = 16
KINDS = ("assign", "access", "hex", "markov")
SAMPLE = 20_000
THRESHOLD = 0.7
SMOOTH = 0.5
ALPHABET = 128


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, stop, value), in code points; cheap where there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(found.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("v"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        stop = begin + F.length(x["m"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), stop.alias("stop"), x["v"].alias("value")))).alias("out"))
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(none)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, base, runs): rule spans (start, kind, stop, value) in order, and candidate runs (start, stop, value)."""
    t = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    t = t.select("_id", matches(F.col("_t"), ASSIGN, 2).alias("a"), matches(F.col("_t"), ACCESS).alias("k"), matches(F.col("_t"), HEX).alias("h"), matches(F.col("_t"), RUN + "{%d,}" % MIN_RUN).alias("r"))

    def kind(column: str, number: int, shortest: int) -> Column:
        kept = F.filter(column, lambda x: F.length(x["value"]) >= shortest)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["stop"].alias("stop"), x["value"].alias("value")))
    t = t.select("_id", F.array_sort(F.concat(kind("a", 0, 6), kind("k", 1, 20), kind("h", 2, 24))).alias("base"), "r")
    free = F.filter("r", lambda c: F.rlike(c["value"], F.lit("[^0-9]")) & ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    return t.select("_id", "base", free.alias("runs"))


def codes(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c))


def train(scanned: DataFrame, sample: int = SAMPLE) -> list[float] | None:
    """Log-likelihood ratios, random over ordinary, of each transition (row-major); None without both labels."""
    def some(values: Column) -> DataFrame:
        v = scanned.select(F.explode_outer(values).alias("v")).where("v is not null").distinct()
        return v.orderBy(F.xxhash64("v"), "v").limit(sample)
    both = some(F.col("base")["value"]).withColumn("label", F.lit(1)).union(some(F.filter(F.col("runs")["value"], lambda v: ~F.rlike(v, F.lit("[0-9]")))).withColumn("label", F.lit(0)))
    c = both.select("label", codes(F.col("v")).alias("c"))
    pairs = c.select("label", F.explode_outer(F.transform(F.sequence(F.lit(0), F.greatest(F.size("c") - 2, F.lit(0))), lambda i: F.get(F.col("c"), i) * ALPHABET + F.get(F.col("c"), i + 1))).alias("t"))
    counts = pairs.where("t is not null").groupBy("label", "t").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * 128 * 128 rows
    if {r.label for r in counts} != {0, 1}:
        return None
    logs = []
    for label in (1, 0):
        n = {r.t: r.n for r in counts if r.label == label}
        rows = [sum(n.get(a * ALPHABET + b, 0) for b in range(ALPHABET)) for a in range(ALPHABET)]
        logs.append([math.log((n.get(t, 0) + SMOOTH) / (rows[t // ALPHABET] + SMOOTH * ALPHABET)) for t in range(ALPHABET * ALPHABET)])
    return [round(a - b, 6) for a, b in zip(*logs, strict=True)]


def ratio(value: Column, table_: Column) -> Column:
    """Log-likelihood ratio per transition of a string."""
    c = codes(value)
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["last"] < 0
        return F.struct((acc["sum"] + F.when(first, F.lit(0.0)).otherwise(F.get(table_, acc["last"] * ALPHABET + x))).alias("sum"), x.alias("last"), (acc["n"] + F.when(first, 0).otherwise(1)).alias("n"))
    return F.aggregate(c, zero, step, lambda acc: acc["sum"] / F.greatest(acc["n"], F.lit(1)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: id, base and found: arrays of (start, kind, stop), by start, then kind (see ``KINDS``)."""
    scanned = stage(scan(docs, id_col, text_col))
    ratios = train(scanned, sample)
    spans = "array<struct<start:int,kind:int,stop:int>>"
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    if ratios is None:
        extra = F.array().cast(spans)
    else:
        table_ = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
        hot = F.filter("runs", lambda r: ratio(r["value"], table_) >= threshold)
        extra = F.transform(hot, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["stop"].alias("stop")))
    return scanned.select(F.col("_id").alias(id_col), base.alias("base"), F.array_sort(F.concat(base, extra)).alias("found"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


@query("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[counted(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
