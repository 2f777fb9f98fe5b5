"""Substring dedup against a plain table of all windows."""

import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import substring_dedup as S


def brute(rows):
    place = lambda i: S.LAST if i is None else i
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, place(i)), place(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < place(i):
                gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def make(seed, vocabulary):
    r = random.Random(seed)
    word = lambda: r.choice(vocabulary)
    pool = [[word() for _ in range(r.choice([8, 12, 13, 14, 20, 60]))] for _ in range(12)]
    rows = []
    for k in range(90):
        t = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            t += [word() for _ in range(r.randint(0, 15))] + (p[a:a + r.choice([10, 13, 16, 80])] if r.random() < 0.8 else [word()] * r.randint(1, 30))
        rows.append((r.randrange(1000), r.choice([" ", "\n", " \t"]).join(t)))
    rows += [(2000, None), (2001, ""), (None, rows[3][1]), (2002, rows[3][1]), (2002, rows[3][1]), (2003, "the " * 4000), (2004, "the " * 40 + "X"), (2005, "é ß " * 500)]
    return rows


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_against_all_windows(spark, docs):
    for seed, vocabulary in ((1, [f"w{k}" for k in range(500)]), (2, ["a", "b", "A", "é"])):
        rows = make(seed, vocabulary)
        df = docs(rows).withColumn("th", F.lit(1)).withColumn("name", F.lit("clash"))
        assert got(S.dedup_substrings(df)) == brute(rows)


def test_empty(spark, docs):
    assert S.dedup_substrings(docs([])).count() == 0


def test_whole_table(spark):
    from conftest import SMOKE
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    assert got(S.op7_substring_dedup(spark, SMOKE)) == brute(rows)
