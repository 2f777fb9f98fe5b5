"""Periodic runs (11) against brute force over every period and position."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.periodic_runs import boundary_matches, collapse_runs, periodic_runs, smallest_factors, stitch, with_repeats, z_function

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every maximal stretch of a smallest period q with max(6, 4q) and more words, as (start, length, period)."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        match = [words[i] == words[i + q] for i in range(n - q)] + [False]
        first = None
        for i, same in enumerate(match):
            if same and first is None:
                first = i
            if not same and first is not None:
                length = i - first + q
                run = words[first:i + q]
                if length >= max(6, 4 * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                    out.append((first, length, q))
                first = None
    return sorted(out)


def report(words):
    runs = sorted((s, q, n) for s, n, q in brute(words))
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = None
    for s, q, n in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(words), len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts(seed=3, many=40):
    r = random.Random(seed)
    out = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x y z " * 30 + "x y"]
    for _ in range(many):
        n, letters = r.choice([7, 20, 60, 150, 400]), r.choice(["ab", "abc", "abcdefgh"])
        w = [r.choice(letters) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            a, p = r.randrange(n), r.randint(1, max(1, n // 6))
            for i in range(a + p, min(n, a + r.randint(3 * p, 6 * p + 3))):
                w[i] = w[i - p]
        out.append("".join(x + r.choice([" ", "\t", "  \n"]) for x in w))
    return out


FIELDS = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_reports_and_runs_against_brute_force(spark, docs):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in collapse_runs(docs(rows)).collect()}
    listed = {i: [] for i, _ in rows}
    for r in periodic_runs(docs(rows)).collect():
        listed[r.doc_id].append((r.start, r.length, r.period))
    for i, text in rows:
        words = WORD.findall(text or "")
        assert tuple(got[i][f] for f in FIELDS) == report(words), text
        assert sorted(listed[i]) == brute(words)
        if got[i].collapsed is not None:
            assert hashlib.sha256(got[i].collapsed.encode()).hexdigest() == got[i].collapsed_sha256


def test_query_input_repeats_the_tail(spark, docs):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(r.choice([1, 5, 40, 300])))) for i in range(300)] + [(7, None), (10**12, ""), (-5, " ")]
    frame = docs(rows).withColumn("text", with_repeats(F.col("text"), F.col("doc_id")))
    assert sorted(r.doc_id for r in frame.collect()) == sorted(i for i, _ in rows)
    got = sorted((r.doc_id, *(r[f] for f in FIELDS)) for r in collapse_runs(frame).collect())
    assert got == sorted((i, *report(planted(i, t))) for i, t in rows)
    assert sum(r[2] for r in got) > 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 1]), min_size=1, max_size=60), st.data())
def test_boundary_z_functions(words, data):
    b = data.draw(st.integers(0, len(words) - 1))
    forward, backward = boundary_matches(words, b, len(words))
    for p in range(1, len(words) - b):
        ahead = next((j for j in range(len(words)) if b + p + j >= len(words) or words[b + j] != words[b + p + j]))
        behind = next((j for j in range(b + 1) if j == b or words[b - 1 - j] != words[b + p - 1 - j]))
        assert (forward[p], backward[p]) == (ahead, behind)


def test_z_function_stops_at_the_asked_shift():
    assert z_function([1, 1, 1, 2, 1, 1], 4) == [6, 2, 1, 0, 2]


def test_smallest_factors():
    assert smallest_factors(64)[2:].tolist() == [next(d for d in range(2, n + 1) if n % d == 0) for n in range(2, 64)]


def test_fragments_of_many_tiles_become_one_run(spark):
    parts = [(1, 3, 0, 70), (1, 3, 60, 130), (1, 3, 130, 140), (1, 3, 142, 160), (2, 3, 5, 30), (1, 4, 0, 3)]
    got = stitch(spark.createDataFrame(parts, "_key long, period long, lo long, hi long")).collect()
    assert sorted((r["_key"], r.start, r.length, r.period) for r in got) == [(1, 0, 143, 3), (1, 142, 21, 3), (2, 5, 28, 3)]


@pytest.mark.parametrize("words, want", [(["same"] * 200_000, (0, 200_000, 1)), ([str(i % 30_011) for i in range(150_000)], (0, 150_000, 30_011)), (["x" * 500_000] * 6, (0, 6, 1))])
def test_very_long_texts(spark, docs, words, want):
    r = collapse_runs(docs([(1, " ".join(words))])).collect()[0]
    assert (r.n_runs, r.start, r.length, r.period) == (1, *want)
    assert r.collapsed == " ".join(words[:want[2]])


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    schema = "text string, doc_id string, _key int, n_words int, start string"
    rows = [("a a a a a a b", "k", 1, 1, "s")] * 2 + [("a b", "k", 2, 2, "s"), ("c c c c c c c", None, 3, 3, None), (None, None, None, None, None)]
    got = collapse_runs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or "", r.n_words, r.n_runs, r.length or 0) for r in got) == [("", 0, 0, 0), ("", 7, 1, 7), ("k", 2, 0, 0), ("k", 7, 1, 6), ("k", 7, 1, 6)]
    empty = spark.createDataFrame([], schema)
    assert collapse_runs(empty).collect() == [] and periodic_runs(empty).collect() == []
