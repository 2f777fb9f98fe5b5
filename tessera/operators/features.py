"""Feature engineering (X3-X11) and classification metrics.

Fitted state is kept as small tables (label index, moments, vocabulary) that are joined to the
data; each is bounded by a cardinality or a parameter, which is what makes broadcasting it safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens


# ---------------------------------------------------------------- X3 / M3
def fit_label_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): sorted distinct values -> 0-based code per column; null counts as 'unknown'.

    The window runs over the distinct (column, value) table, whose size is the columns'
    cardinality, not the row count."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])).alias("p")
    ).select("p.column", "p.value").distinct()
    return pairs.withColumn("code", (F.dense_rank().over(Window.partitionBy("column").orderBy("value")) - 1).cast("long"))


def apply_label_index(df: DataFrame, index: DataFrame, columns: Sequence[str], unseen: int = -1) -> DataFrame:
    """Code columns ``<col>_code``; values missing from the index get ``unseen`` (T8: per row)."""
    out = df
    for c in columns:
        m = index.where(F.col("column") == c).select(F.col("value").alias(f"_{c}_v"), F.col("code").alias(f"{c}_code"))
        out = out.join(m, F.coalesce(out[c].cast("string"), F.lit("unknown")) == m[f"_{c}_v"], "left").drop(f"_{c}_v")
        out = out.withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(unseen).cast("long")))
    return out


# ---------------------------------------------------------------- X4
def fit_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population std per column (zero std -> 1, T5)."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"),
                 F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}__std")]
    return df.agg(*aggs)


def apply_scaling(df: DataFrame, moments: DataFrame, columns: Sequence[str]) -> DataFrame:
    j = df.crossJoin(F.broadcast(moments))  # one row
    for c in columns:
        j = j.withColumn(f"{c}_scaled", (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std"))
    return j.drop(*[x for x in moments.columns])


# ---------------------------------------------------------------- X9 / X10
def word_index(docs: DataFrame, text_col: str, num_words: int = 10000) -> DataFrame:
    """(word, code): codes from 2 by count desc, word asc; only codes < num_words (1 = OOV)."""
    w = docs.select(F.explode_outer(tokens(F.col(text_col))).alias("word")).where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = w.orderBy(F.col("n").desc(), F.col("word")).limit(max(num_words - 2, 0))  # bounded by num_words
    return top.select("word", (F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("word"))) + 1)
                      .cast("long").alias("code"))


def to_sequences(docs: DataFrame, id_col: str, text_col: str, index: DataFrame, oov: int = 1) -> DataFrame:
    """(id, pos, code) for every token, OOV -> ``oov`` (a long table instead of lists)."""
    ex = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(tokens(F.col(text_col))).alias("pos", "word")).where("word is not null")
    j = ex.join(F.broadcast(index), "word", "left")
    return j.select("id", F.col("pos").cast("long").alias("pos"),
                    F.coalesce(F.col("code"), F.lit(oov).cast("long")).alias("code"))


def pad_sequences(seq: DataFrame, maxlen: int = 100, value: int = 0) -> DataFrame:
    """Keep the last ``maxlen`` codes (long ones lose the front), pad at the end with
    ``value`` to exactly ``maxlen`` positions."""
    n = seq.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    cut = seq.join(n, "id").where(F.col("pos") >= F.col("_n") - maxlen).select(
        "id", (F.col("pos") - F.greatest(F.col("_n") - maxlen, F.lit(0))).alias("pos"), "code")
    pads = n.where(F.col("_n") < maxlen).select("id", F.explode(F.sequence(F.col("_n"), F.lit(maxlen - 1))).alias("pos")) \
        .select("id", F.col("pos").cast("long").alias("pos"),
                                             F.lit(value).cast("long").alias("code"))
    return cut.select("id", F.col("pos").cast("long").alias("pos"), "code").unionByName(pads)


# ---------------------------------------------------------------- rule classifier (for metrics)
# Marker words of the rule-based language classifier used to produce predictions without a
# trained model (fixed values).
LANG_MARKERS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "und", "das"),
    "en": ("the", "and", "of", "is"),
    "es": ("los", "las", "el", "que"),
    "fr": ("les", "le", "et", "des"),
}


def _member(words: tuple[str, ...]):
    def f(t: Column) -> Column:  # one parameter: a second one would receive the index
        return t.isin(*words)
    return f


def rule_language(text: Column, markers: Mapping[str, Sequence[str]] = LANG_MARKERS) -> Column:
    """Language with the most marker-word tokens; ties to the alphabetically first; none -> 'en'.

    Expression form (tokenises once per language); prefer ``with_rule_language`` on frames."""
    toks = tokens(text)
    return _argmax_language({lang: F.size(F.filter(toks, _member(tuple(ws)))) for lang, ws in markers.items()})


def _argmax_language(counts: Mapping[str, Column]) -> Column:
    langs = sorted(counts)
    best = F.greatest(*[counts[lg] for lg in langs])
    expr = None
    for lg in langs:
        cond = counts[lg] == best
        expr = F.when(cond, F.lit(lg)) if expr is None else expr.when(cond, F.lit(lg))
    return F.when(best == 0, F.lit("en")).otherwise(expr)


def with_rule_language(df: DataFrame, text_col: str, out: str, id_col: str = "id",
                       markers: Mapping[str, Sequence[str]] = LANG_MARKERS) -> DataFrame:
    """Rule-based language column, relationally: tokens are exploded and joined to the marker
    table (a few words, broadcast), counted per (row, language), and the arg-max is joined back.
    Only marker hits are shuffled; rows without any hit get 'en'."""
    spark = df.sparkSession
    mk = spark.createDataFrame([(w, lang) for lang, ws in markers.items() for w in ws], "word string, lang string")
    hits = (df.select(F.col(id_col).alias("_rl_id"), F.explode_outer(tokens(F.col(text_col))).alias("word"))
            .join(F.broadcast(mk), "word").groupBy("_rl_id", "lang").agg(F.count(F.lit(1)).alias("_c")))
    # arg-max per row: highest count, ties to the alphabetically first language
    best = hits.groupBy("_rl_id").agg(F.min_by("lang", F.struct((-F.col("_c")).alias("c"), F.col("lang"))).alias("_lang"))
    j = df.join(best, df[id_col] == best["_rl_id"], "left")
    return j.withColumn(out, F.coalesce(F.col("_lang"), F.lit("en"))).drop("_rl_id", "_lang")


# ---------------------------------------------------------------- G12, G13
def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label"), F.col(pred).cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class precision / recall / f1 / support, then macro, weighted and micro averages and
    accuracy (zero denominators -> 0), from the confusion table only."""
    cm = confusion(df, label, pred)
    tp = cm.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    pc = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    cls = sup.join(pc, "cls", "full").join(tp, "cls", "left").select(
        "cls", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("predicted", F.lit(0)).alias("predicted"),
        F.coalesce("tp", F.lit(0)).alias("tp"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = cls.select("cls", p.alias("precision"), r.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(F.lit(0.0)))
    tot = per.agg(F.sum("support").alias("N"), F.sum("tp").alias("TP"), F.count(F.lit(1)).alias("K"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = F.col("TP") / F.col("N")
    avgs = tot.select(F.explode(F.array(
        F.struct(F.lit("macro avg").alias("cls"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("N").alias("support")),
        F.struct(F.lit("weighted avg").alias("cls"), (F.col("wp") / F.col("N")).alias("precision"),
                 (F.col("wr") / F.col("N")).alias("recall"), (F.col("wf") / F.col("N")).alias("f1"),
                 F.col("N").alias("support")),
        F.struct(F.lit("micro avg").alias("cls"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 F.col("N").alias("support")),
        F.struct(F.lit("accuracy").alias("cls"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 F.col("N").alias("support")),
    )).alias("s")).select("s.*")
    return per.select("cls", "precision", "recall", "f1", "support").unionByName(avgs)


def selection_status(metrics: DataFrame, score: str = "f1", threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """M9: selected if score > threshold (>= when inclusive), rejected otherwise, failed if missing."""
    s = F.col(score)
    passed = (s >= threshold) if inclusive else (s > threshold)
    return metrics.withColumn("status", F.when(s.isNull(), "failed").when(passed, "selected").otherwise("rejected"))


def selected_models(report: DataFrame) -> DataFrame:
    """The report rows whose status is 'selected'."""
    return report.where(F.col("status") == "selected")


def model_status(report: DataFrame, wanted: DataFrame, target: str = "target") -> DataFrame:
    """For each wanted target its report row, nulls where there is none, and ``is_selected``."""
    return wanted.select(target).distinct().join(report, target, "left").withColumn(
        "is_selected", F.coalesce(F.col("status") == "selected", F.lit(False)))
