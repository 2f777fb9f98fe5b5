"""Spelling variants (12) against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm.spelling import letter_runs, near_pairs, roots, variant_forms, with_slips

SCHEMA = "word string, n long"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def slipped(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def collect(df):
    return sorted(tuple(r) for r in df.collect())


def vocabulary(seed, letters, many, sizes):
    r = random.Random(seed)
    base = {"".join(r.choice(letters) for _ in range(r.randint(*sizes))) for _ in range(many)}
    words = dict.fromkeys(base, 1)
    for w in sorted(base):
        for _ in range(2):
            i = r.randrange(len(w))
            words.setdefault(r.choice([w[:i] + w[i + 1:], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1:]]), 1)
    return {w: r.choice([2, 3, 30, 400, 5000]) for w in words}


@pytest.mark.parametrize("letters, sizes", [("ab", (7, 11)), ("abcdefgh", (7, 9)), ("abéÿ×", (7, 14)), ("a", (7, 12))])
def test_forms_against_all_pairs(spark, letters, sizes):
    counts = vocabulary(4, letters, 120, sizes)
    got = collect(variant_forms(spark.createDataFrame(list(counts.items()), SCHEMA)))
    assert got == brute(counts)


def test_words_of_any_length_and_short_ones(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdef") for _ in range(20_000))
    words = [long, long[:9_000] + long[9_001:], "z" + long, long[:-1] + "z", "a", "b", "ab", "abc", "", "x" * 5_000, "x" * 5_001, "x" * 5_003]
    got = collect(near_pairs(spark.createDataFrame([(w, 5) for w in words], SCHEMA)).select("word", "near"))
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_chains_of_forms(spark):
    chain = [("w0", "w1"), ("w1", "w2"), ("w2", "w3"), ("w3", "w4"), ("w4", "w5"), ("u0", "w2"), ("u1", "w2"), ("x", "y")]
    got = dict(collect(roots(spark.createDataFrame(chain, "word string, form string"))))
    assert got == {**{f"w{i}": "w5" for i in range(5)}, "u0": "w5", "u1": "w5", "x": "y"}


def test_query_from_texts(spark, docs):
    r = random.Random(8)
    words = ["Straßenbahn", "programme", "PROGRAMME", "organise", "organize", "colours", "naïveté", "ÀÉÎÕÜàÿ", "short", "a×b÷cdefgh", "zzzzzzzz"]
    rows = [(i, " ".join(r.choices(words, [1, 9, 9, 30, 1, 9, 3, 3, 9, 2, 9], k=120))) for i in range(60)] + [(3, None), (None, "programme programm programm"), (61, ""), (62, "y" * 30_000 + " " + "y" * 30_000)]
    counts = slipped(rows)
    assert collect(with_slips(letter_runs(docs(rows)))) == sorted(counts.items())
    got = collect(variant_forms(with_slips(letter_runs(docs(rows)))))
    assert got == brute(counts)
    assert any(x[1] is not None for x in got)


def test_empty_tables_and_clashing_columns(spark, docs):
    assert collect(variant_forms(with_slips(letter_runs(docs([]))))) == []
    assert collect(variant_forms(with_slips(letter_runs(docs([(1, "no long one"), (2, None)]))))) == []
    clash = spark.createDataFrame([("abcdefgh abcdefgh", 5, "r", 1, 2, 3)], "text string, doc_id long, run string, id int, word int, node int")
    assert collect(variant_forms(with_slips(letter_runs(clash)))) == [("abcdefgh", None, "abcdefgh", 2, 0, None)]
    extra = spark.createDataFrame([("abcdefgh", 20, "x", 1), ("abcdefg", 2, "y", 2)], "word string, n int, near string, path int")
    assert collect(variant_forms(extra)) == [("abcdefg", "abcdefgh", "abcdefgh", 2, 1, 20), ("abcdefgh", None, "abcdefgh", 20, 1, None)]
