"""SimHash near-dedup against brute force: fingerprints by the xxhash library, links by all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import stage

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    words = (text or "").encode().translate(UPPER).split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [(i, brute_fp(t)) for i, t in rows]
    label = {k: k for k in range(len(fps))}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                label[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return sorted(((i, f"{fp:016x}", best.get(find(k))) for k, (i, fp) in enumerate(fps)), key=repr)


def texts(n, seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéfgHIJß") for _ in range(r.randint(1, 13)))
    out = []
    for k in range(n):
        if k % 3 and out:
            words = r.choice(out).split(" ")
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = word()
            out.append(" ".join(words))
        else:
            out.append(" ".join(word() for _ in range(r.randint(1, 400))))
    return out


def result(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id").collect()), key=repr)


def test_against_brute_force(spark, docs):
    rows = list(enumerate(texts(150)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "One two"), (None, rows[3][1]), (905, rows[3][1]), (905, rows[3][1]), (906, "x " * 20000)]
    df = docs(rows).withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    assert result(simhash.near_dedup(df)) == brute_components(rows)


def test_empty(spark, docs):
    assert simhash.near_dedup(docs([])).count() == 0
    assert simhash.drop_near_copies(docs([])).count() == 0


def test_keys_share_within_three_bits():
    r = np.random.default_rng(1)
    for _ in range(300):
        x = int(r.integers(0, 2**63))
        y = x
        for b in r.choice(64, r.integers(0, 4), replace=False):
            y ^= 1 << int(b)
        keys = []
        for z in (x, y):
            import pyarrow as pa
            batch = pa.RecordBatch.from_arrays([pa.array(np.array([z], np.uint64).view(np.int64))], names=["fp"])
            keys.append([{k for out in f([batch]) for k in out.column(0).to_pylist()} for f in (simhash._own, simhash._keys)])
        assert keys[0][0] & keys[1][1] and keys[1][0] & keys[0][1]


def test_one_document_of_each_group_stays(spark, docs):
    rows = list(enumerate(texts(60)))
    kept = {r.doc_id for r in simhash.drop_near_copies(docs(rows)).collect()}
    assert kept == {c for _, _, c in brute_components(rows)}


def test_whole_table(spark):
    from conftest import SMOKE
    df = spark.read.parquet(f"{SMOKE}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, SMOKE).collect()), key=repr) == brute_components(rows)


def test_keys_are_not_broadcast(spark, docs):
    """The planner sizes the 84 keys of a fingerprint by the table of fingerprints, which may be under the broadcast limit."""
    nodes = stage(simhash.fingerprints(docs(list(enumerate(texts(60))))).select("fp").distinct())
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
