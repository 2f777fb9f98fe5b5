"""Toxicity: ratios against direct Kneser-Ney sums, held-out accuracy, defined cases."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as T
from tessera.llm.words import IS_PUNCT, U, chunks


def make(n=600, seed=4):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 3000}"
    rows, labels = [], []
    for k in range(n):
        toxic = r.random() < 0.25
        w = [word() for _ in range(r.randint(20, 200))]
        if toxic:
            for _ in range(max(2, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(["Vile", "nasty,", "vile!", "foul"])
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def hashes(*names):
    return np.concatenate([c.hashes() for c in chunks(pa.array([" ".join(names)]), IS_PUNCT)])


def test_ratios_against_direct_sums():
    r = random.Random(1)
    names = "abcdefgh"
    h = dict(zip(names, hashes(*names), strict=True))
    pairs = {(k, v, w): r.choice([0, 1, 2, 9]) for k in (0, 1) for v in names for w in names}
    pairs = {x: n for x, n in pairs.items() if n}
    for d in (1.0, 3.0):
        def prob(k, v, w):
            spread = {x: sum(1 for (kk, _, ww) in pairs if kk == k and ww == x) for x in names}
            total, kept = sum(spread.values()), sum(max(n - d, 0) for n in spread.values())
            classes = {x: sum(any((kk, y, x) in pairs for y in names) for kk in (0, 1)) for x in names}
            low = max(spread[w] - d, 0) / total + (1 - kept / total) * classes[w] / (sum(classes.values()) + 1)
            used = sum(n for (kk, vv, _), n in pairs.items() if (kk, vv) == (k, v))
            free = 1 - sum(max(n - d, 0) for (kk, vv, _), n in pairs.items() if (kk, vv) == (k, v)) / max(used, 1)
            return max(pairs.get((k, v, w), 0) - d, 0) / max(used, 1) + free * low
        as_long = lambda xs: pa.array(np.array(xs, U).view(np.int64))
        full = pa.table({"toxic": [k for k, _, _ in pairs], "v": as_long([h[v] for _, v, _ in pairs]), "w": as_long([h[w] for _, _, w in pairs]), "n": list(pairs.values())})
        words = pa.table({"toxic": [k for k in (0, 1) for _ in names], "w": as_long([h[x] for _ in (0, 1) for x in names]), "n": [sum(1 for (kk, _, w) in pairs if (kk, w) == (k, x)) for k in (0, 1) for x in names]})
        contexts = pa.table({"toxic": [k for k in (0, 1) for _ in names], "v": as_long([h[x] for _ in (0, 1) for x in names]), "n": [sum(n for (kk, v, _), n in pairs.items() if (kk, v) == (k, x)) for k in (0, 1) for x in names]})
        ratios = T.Ratios(T.Counts(words, contexts, full), d)
        got = ratios.tokens(np.array([h[v] for v in names for _ in names], U), np.array([h[w] for _ in names for w in names], U))
        assert got == pytest.approx([math.log(prob(1, v, w) / prob(0, v, w)) for v in names for w in names], abs=1e-5)


def test_held_out_accuracy(spark, docs):
    rows, labels = make()
    df = docs(rows).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.score_toxicity(df, lab).collect()}
    truth = {k: t for k, _, t in labels}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) for k in truth)
    assert all(got[k].predicted == (got[k].score >= 0.5) and 0 <= got[k].score <= 1 for k in truth)
    assert sum(got[k].predicted == truth[k] for k in held) >= 0.95 * len(held)
    # labels of held-out rows are not read
    turned = spark.createDataFrame([(k, q, t if k not in set(held) else 1 - t) for k, q, t in labels], lab.schema)
    assert {k: r.score for k, r in got.items()} == pytest.approx({r.doc_id: r.score for r in T.score_toxicity(df, turned).collect()})
    kept = {r.doc_id for r in T.drop_toxic(df, lab).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_cut_off_catches_the_share_it_promises():
    r = np.random.default_rng(2)
    y = np.concatenate([np.ones(400), np.zeros(4000)])
    z = np.concatenate([r.normal(6, 1, 400), r.normal(0, 1, 4000)])
    cut = T.cut_off(z, y, 0.985, 0.01)
    assert (z[y > 0] >= cut).mean() >= 0.985 and (z[y == 0] >= cut).mean() <= 0.01
    mixed = np.concatenate([r.normal(1, 1, 400), r.normal(0, 1, 4000)])  # classes that overlap: the ordinary ones decide
    assert (mixed[y == 0] >= T.cut_off(mixed, y, 0.985, 0.01)).mean() <= 0.0101


def test_held_out_recall_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = T.score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    ordinary = [r.predicted for r in got if r.toxic == 0]
    assert len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic)
    assert sum(ordinary) <= 0.04 * len(ordinary)


def test_defined_cases(spark, docs):
    rows, labels = make(120)
    rows += [(1000, None), (1001, ""), (None, "vile"), (5, rows[7][1]), (1002, "w1 " * 50000)]
    lab = spark.createDataFrame(labels + [(1, 0, None), (None, 0, 1), (7777, 1, 1), (3, 1, labels[3][2])], "doc_id long, quality int, toxic int")
    got = T.score_toxicity(docs(rows), lab).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    none = lab.where("toxic = 0")
    assert {r.score for r in T.score_toxicity(docs(rows), none).collect()} == {0.0}
    assert T.score_toxicity(docs([]), lab).count() == 0
