"""Winnowed decontamination against a plain search for windows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.select("doc_id", "n_words", "n_hit", "items").collect()), key=repr)


def make(seed=2):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "Ü", "é1", "and", "x", "Ab", "zz9"])
    items = [(k, " ".join(word() for _ in range(r.choice([0, 1, 3, 5, 9, 10, 11, 25, 40])))) for k in range(14)] + [(50, None), (51, "the the the the the the the the the the the the")]
    items = [(i, t) for i, t in items if i > 50 or len(words(t)) != 1]
    rows = []
    for k in range(60):
        t = [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randrange(len(w) + 1)
            t[(at := r.randrange(len(t) + 1)):at] = w[a:a + r.choice([4, 9, 10, 12, 30])]
        rows.append((k, r.choice([" ", ", ", "-"]).join(t)))
    rows += [(None, rows[1][1]), (3, rows[1][1]), (3, rows[1][1]), (70, None), (71, ""), (72, "the " * 3000), (73, "?!")]
    return rows, items


def test_against_brute_force(spark, docs):
    rows, items = make()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    df = docs(rows).withColumn("fp", F.lit("clash")).withColumn("item", F.lit(1))
    expected = brute(rows, items)
    assert rows_of(D.decontaminate(df, bench)) == expected
    kept = sorted(D.drop_contaminated(df, bench).select("doc_id").collect(), key=repr)
    assert [r.doc_id for r in kept] == [e[0] for e in expected if not e[2]]


def test_without_broadcast(spark, docs, monkeypatch):
    rows, items = make(4)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert rows_of(D.decontaminate(docs(rows), spark.createDataFrame(items, "item_id long, text string"))) == brute(rows, items)


def test_empty(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(D.decontaminate(docs([(1, "a b")]), bench)) == [(1, 2, 0, [])]
    assert D.decontaminate(docs([]), bench).count() == 0


def test_digest():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
