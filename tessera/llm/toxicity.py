"""Toxicity (5): class-conditional Kneser-Ney word models, compared by length-normalised log-likelihood.

Two interpolated bigram models, one of toxic and one of ordinary texts, are fitted on a bounded
sample of the labelled rows (``SAMPLE_ROWS`` of each class, in the order of a hash of their ids):

    p_c(w | v) = max(n_c(vw) - D, 0) / n_c(v) + g_c(v) * p_c(w)
    p_c(w)     = max(N_c(.w) - D, 0) / N_c(..) + g_c * p(w)
    p(w)       = N(w) / (N + 1)

N_c(.w) counts the distinct contexts of a word in a class (so copies add nothing), g is the mass that
the discount D frees. The last level is shared: N(w) counts the classes that know the word, so an
expression with no more than D contexts says nothing, and what both classes know cancels out. D is
chosen among ``DISCOUNTS`` by the likelihood of the part of the sample that the models have not seen.
A token's log-likelihood ratio is the sum of three table entries (word, context, pair); the tables
are bounded by the sample and are sent to the tasks.

A text's evidence is its ratio per word over the whole text and the largest over its windows of 1, 4
and 16 words and the mean of its three largest, so a few expressions in a long text are not diluted. A logistic function fitted on a
quarter of the sample, which the models have not seen, orders the texts. The same quarter sets the
point that counts as .5: it catches ``RECALL`` of its toxic rows, unless that would flag more than
``FALSE`` of its ordinary ones. Every row and every word of ``documents`` is scored, whatever its length.

Defined cases: null and empty texts have no evidence and score low; a null id
is never held out (crc32 of null is null) and never trains; label rows with a null label or id or
without a document are left out; repeated label rows count once; with no sample of one class every
score is 0; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.registry import query, table
from tessera.llm.words import IS_PUNCT, U, Chunk, chunks, combine

#: Bound of the training sample: labelled rows of each class.
SAMPLE_ROWS = 2500
#: Share of the toxic calibration rows that score .5 and more, and the largest share of the ordinary ones that may.
RECALL, FALSE = 0.985, 0.01
WINDOWS = (1, 4, 16)
TOP = 3
WIDTH = len(WINDOWS) + 3
#: Absolute discounts to choose from; the held-back part of the sample decides.
DISCOUNTS = (1.0, 3.0, 6.0, 12.0, 25.0, 50.0)
START = U(0x5374617274)  # context of a text's first word


def pairs_of(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of the word before it (START at the beginning of a text)."""
    w = c.hashes()
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[c.row0[:-1][c.counts() > 0]] = START
    return v, w


def _count(batches):
    for b in batches:
        toxic = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for c in chunks(b.column(1), IS_PUNCT, lower=True):
            v, w = pairs_of(c)
            kind = np.repeat(toxic[c.first:c.first + c.n], c.counts())
            for k in (0, 1):
                both = np.stack([v[kind == k], w[kind == k]], axis=1)
                seen, n = np.unique(both, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(seen[:, 0].view(np.int64)), pa.array(seen[:, 1].view(np.int64)), pa.array(n)], names=["toxic", "v", "w", "n"])


class Counts:
    """Class-wise counts of the training sample: distinct contexts of a word, uses of a context, repeated pairs."""

    def __init__(self, words, contexts, pairs):
        """Three Arrow tables: (toxic, w, n), (toxic, v, n), (toxic, v, w, n)."""
        self.words, self.spread = self._table(words, [words["w"]])
        self.contexts, self.used = self._table(contexts, [contexts["v"]])
        keys = combine(self._hash(pairs["v"]), self._hash(pairs["w"]))
        self.pairs, first, of = np.unique(keys, return_index=True, return_inverse=True)
        self.pair_v = np.searchsorted(self.contexts, self._hash(pairs["v"])[first])
        self.pair_w = np.searchsorted(self.words, self._hash(pairs["w"])[first])
        self.count = np.zeros((2, len(self.pairs)))
        self.count[pairs["toxic"].to_numpy(), of] = pairs["n"].to_numpy()

    @staticmethod
    def _hash(column) -> np.ndarray:
        return column.to_numpy().view(U)

    def _table(self, table_, keys) -> tuple[np.ndarray, np.ndarray]:
        names, of = np.unique(self._hash(keys[0]), return_inverse=True)
        out = np.zeros((2, len(names)))
        out[table_["toxic"].to_numpy(), of] = table_["n"].to_numpy()
        return names, out


class Ratios:
    """Log-likelihood ratios (toxic over ordinary) by word, context and pair, as sorted hash tables."""

    def __init__(self, c: Counts, discount: float):
        shared = (c.spread > 0).sum(0).astype(float)  # classes that know the word
        total = shared.sum() + 1
        p_word, g_context, p_pair, unknown = [], [], [], []
        for k in (1, 0):
            kept = np.maximum(c.spread[k] - discount, 0)
            tokens = max(1.0, c.spread[k].sum())
            back = 1 - kept.sum() / tokens
            p1 = kept / tokens + back * shared / total
            unknown.append(np.log(back / total))
            seen = np.maximum(c.count[k] - discount, 0)
            used = np.maximum(c.used[k], 1)
            gamma = 1 - np.bincount(c.pair_v, weights=seen, minlength=len(c.contexts)) / used
            lower = gamma[c.pair_v] * p1[c.pair_w]
            p_word.append(np.log(p1))
            g_context.append(np.log(gamma))
            p_pair.append(np.log(seen / used[c.pair_v] + lower) - np.log(lower))
        self.unknown = np.float32(unknown[0] - unknown[1])
        self.words, self.word = self._kept(c.words, p_word, self.unknown)
        self.contexts, self.context = self._kept(c.contexts, g_context, 0)
        self.pairs, self.pair = self._kept(c.pairs, p_pair, 0)

    @staticmethod
    def _kept(keys: np.ndarray, logs: list[np.ndarray], other: float) -> tuple[np.ndarray, np.ndarray]:
        """Without the entries that say what an unknown one says."""
        ratio = (logs[0] - logs[1]).astype(np.float32)
        told = ratio != np.float32(other)
        return (keys[told], ratio[told]) if told.any() else (np.zeros(1, U), np.full(1, other, np.float32))

    @staticmethod
    def look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, other: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], np.float32(other))

    def tokens(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (self.look(self.words, self.word, w, self.unknown) + self.look(self.contexts, self.context, v, 0)
                + self.look(self.pairs, self.pair, combine(v, w), 0)).astype(np.float64)

    def evidence(self, c: Chunk) -> np.ndarray:
        """A row a text: ratio per word, the largest over each window width, mean of the largest single ones, log of the length."""
        out = np.zeros((c.n, WIDTH))
        count = c.counts()
        has = np.flatnonzero(count > 0)
        if not len(has):
            return out
        v, w = pairs_of(c)
        ratio = self.tokens(v, w)
        run = np.concatenate(([0.0], np.cumsum(ratio)))
        out[has, 0] = (run[c.row0[has + 1]] - run[c.row0[has]]) / count[has]
        stop = np.repeat(c.row0[1:], count)
        start = np.repeat(c.row0[:-1], count)
        at = np.arange(len(w))
        for k, width in enumerate(WINDOWS):
            last = np.minimum(at + width, stop)
            first = np.maximum(last - width, start)  # a window at the end reaches back, a short text is one window
            out[has, k + 1] = np.maximum.reduceat((run[last] - run[first]) / (last - first), c.row0[has])
        # the TOP largest single ratios, averaged: one odd word does not make a text toxic
        order = np.lexsort((-ratio, c.rows()))
        top = np.minimum(count[has], TOP)
        best = np.concatenate(([0.0], np.cumsum(ratio[order])))
        out[has, -2] = (best[c.row0[has] + top] - best[c.row0[has]]) / top
        out[has, -1] = np.log1p(count[has])
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression; returns weights and intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * len(x) / 100)
    penalty[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


class Model:
    def __init__(self, ratios: Ratios, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray, shift: float):
        self.ratios, self.mean, self.scale, self.beta, self.shift = ratios, mean, scale, beta, shift

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.beta[:-1] + self.beta[-1] + self.shift, -500, 500)))


def _evidence(shared):
    def run(batches):
        for b in batches:
            tried = shared.value
            parts = [np.hstack([r.evidence(c) for r in tried]) for c in chunks(b.column(1), IS_PUNCT, lower=True)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(tried) * WIDTH))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, k]) for k in range(x.shape[1])]], names=["toxic", *[f"x{k}" for k in range(x.shape[1])]])
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits on ``labels`` (only ids and labels are read) and the texts of the sampled rows; None without both classes."""
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("toxic")).where("_lid is not null and toxic in (0, 1)").distinct()
    share = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        return None
    picked = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("_lid"), "_lid").limit(rows) for k in (0, 1)]
    sample = picked[0].union(picked[1])  # at most 2 * rows ids
    texts = stage(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), F.col("_id") == F.col("_lid"))
                  .select("toxic", "text", (F.pmod(F.xxhash64(F.lit("calibrate"), "_id"), F.lit(4)) == 0).alias("second")))
    counts = texts.where("not second").select("toxic", "text").mapInArrow(_count, "toxic int, v long, w long, n long")
    counts = stage(counts.groupBy("toxic", "v", "w").agg(F.sum("n").alias("n")))
    words = counts.groupBy("toxic", "w").agg(F.count(F.lit(1)).alias("n")).toArrow()
    contexts = counts.groupBy("toxic", "v").agg(F.sum("n").alias("n")).toArrow()
    if len(set(words["toxic"].to_pylist())) < 2:
        return None
    table_ = Counts(words, contexts, counts.where(F.col("n") > min(DISCOUNTS)).toArrow())  # a pair counted less has no mass of its own
    tried = [Ratios(table_, d) for d in DISCOUNTS]
    del table_, words, contexts
    shared = spark.sparkContext.broadcast(tried)
    width = WIDTH
    names = [f"x{j}" for j in range(width * len(tried))]
    seen = texts.where("second").select("toxic", "text").mapInArrow(_evidence(shared), "toxic int, " + ", ".join(f"{x} double" for x in names)).toArrow()
    y = seen["toxic"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    best = None
    for k, ratios in enumerate(tried):
        x = np.stack([seen[n].to_numpy() for n in names[k * width:(k + 1) * width]], axis=1)
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        beta = fit_logistic((x - mean) / scale, y)
        z = np.clip(((x - mean) / scale) @ beta[:-1] + beta[-1], -30, 30)
        loss = float(np.log1p(np.exp(-np.where(y > 0, z, -z))).sum())
        if best is None or loss < best[0]:
            best = loss, Model(ratios, mean, scale, beta, -cut_off(z, y))
    return best[1]


def cut_off(z: np.ndarray, y: np.ndarray, recall: float = RECALL, false: float = FALSE) -> float:
    """The evidence from which on a text is called toxic."""
    return float(max(np.quantile(z[y > 0], 1 - recall, method="lower"), np.quantile(z[y == 0], 1 - false)))


def _score(shared):
    def run(batches):
        for b in batches:
            m = shared.value
            parts = [np.zeros(c.n) if m is None else m.score(m.ratios.evidence(c)) for c in chunks(b.column(1), IS_PUNCT, lower=True)]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p)], names=["_id", "_th", "score"])
    return run


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, _th (hash of the raw text). Labels of held-out rows are not read."""
    model = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_col).cast("string")
    asked = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"))
    out = asked.mapInArrow(_score(shared), f"_id {dict(asked.dtypes)['_id']}, _th long, score double")
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "_th")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns."""
    bad = stage(score_toxicity(docs, labels, id_col, text_col, rows=rows).where("predicted = 1").select(F.col(id_col).alias("__t_bid"), F.col("_th").alias("__t_bth")).distinct())
    th = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.withColumn("__t_th", th).join(bad, F.col(id_col).eqNullSafe(F.col("__t_bid")) & (F.col("__t_th") == F.col("__t_bth")), "left_anti").drop("__t_th")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_th")
