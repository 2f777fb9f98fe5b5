"""Exact dedup against plain grouping; the quotient filter against counting."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup as E


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    out, seen = [], set()
    ids = {}
    for i, t in rows:
        ids.setdefault(norm(t), []).append(i)
    for i, t in rows:
        n = norm(t)
        known = [x for x in ids[n] if x is not None]
        keep = min(known) if known else None
        kept = i == keep and (i, n) not in seen
        seen.add((i, n))
        out.append((i, keep, len(ids[n]), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def make():
    r = random.Random(1)
    base = ["", " ", "a b", "a  b", "a\tb", "a b", "é", "x " * 40000] + [f"text {k}" for k in range(20)]
    rows = [(k, r.choice(base)) for k in range(300)]
    return rows + [(1000, None), (None, "a b"), (None, "only here"), (None, "only here"), (3, rows[3][1]), (3, rows[3][1])]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_against_grouping(spark, docs, monkeypatch):
    df = docs(make()).withColumn("keep_id", F.lit("clash")).withColumn("block", F.lit(1))
    assert got(E.exact_dedup(df)) == brute(make())
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0)
    assert got(E.exact_dedup(df)) == brute(make())


def test_equal_fingerprints_of_different_texts_part(spark, docs, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(E.F, "xxhash64", lambda c: real(F.substring(c, 1, 1)))
    assert got(E.exact_dedup(docs(make()))) == brute(make())


def test_drop_copies(spark, docs):
    kept = E.drop_copies(docs(make()).withColumn("__x", F.lit(1)))
    assert kept.columns[-1] == "__x"
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((b[0] for b in brute(make()) if b[3]), key=repr)


def test_empty(spark, docs):
    assert E.exact_dedup(docs([])).count() == 0
    assert E.drop_copies(docs([])).count() == 0


@pytest.mark.parametrize("bits", [1, 8, 24])
def test_filters_merge_without_loss(bits):
    r = np.random.default_rng(2)
    parts = [r.integers(0, 2**64, 300, dtype=np.uint64) >> np.uint64(56) << np.uint64(56) | r.integers(0, 3, 300, dtype=np.uint64) for _ in range(4)]
    filters = [E.QuotientFilter(bits, p) for p in parts]
    blocks = {}
    for f in filters:
        for k, keys, counts in f.blocks(min(bits, 4)):
            blocks.setdefault(k, []).append((keys, counts))
    total = Counter()
    for b in blocks.values():
        m = E.QuotientFilter.merge(bits, b)
        total.update(dict(zip(m.fingerprints().tolist(), m.counts.tolist())))
    assert total == Counter(np.concatenate(parts).tolist())
