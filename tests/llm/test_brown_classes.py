"""Every head word chooses its class: gains against whole likelihoods, words beyond the seeds in their neighbours' classes."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import brown_lm as B


def test_gain_is_the_change_of_the_likelihood():
    r = np.random.default_rng(3)
    words, classes = 24, 4
    n = r.integers(0, 4, (words + 2, words + 2)) * (r.random((words + 2, words + 2)) < 0.5)  # the last two are the end and rare words
    units = np.append(r.integers(1, classes + 1, words), [B.END_UNIT, B.RARE])
    units[:3] = B.UNPLACED

    def pairs(of):
        a = np.zeros((B.UNITS, B.UNITS), np.int64)
        np.add.at(a, (of[:, None], of[None, :]), n)
        return a
    into, out, own = np.zeros((words, B.UNITS)), np.zeros((words, B.UNITS)), np.diag(n)[:words]
    for w in range(words):
        np.add.at(into[w], np.delete(units, w), np.delete(n[:, w], w))
        np.add.at(out[w], np.delete(units, w), np.delete(n[w], w))
    got = B.choose(pairs(units), units[:words], into, out, own, classes)
    for w in range(words):
        value = []
        for k in range(1, classes + 1):
            other = units.copy()
            other[w] = k
            value.append(B.likelihood(pairs(other)))
        assert value[got[w] - 1] >= max(value) - 1e-6


def rows(n=6000):
    """Names follow one word, verbs another; there are more of them than seeds."""
    r = random.Random(5)
    return [(k, " ".join(f"{a} {x}{r.randrange(500)}" for a, x in (r.choice((("the", "n"), ("to", "v"))) for _ in range(6)))) for k in range(n)]


def test_words_beyond_the_seeds_get_their_neighbours_class(spark, docs):
    import pyarrow as pa

    from tessera.llm.words import chunks
    df = docs(rows()).withColumn("h", F.lit(1))
    model, _ = B.fit(df, "text", 100000)
    assert len(model.head.h) > B.CLUSTERED
    unit = {}
    for x in "nv":
        h = np.concatenate([c.hashes() for c in chunks(pa.array([f"{x}{k}" for k in range(500)]))])
        unit[x] = model.head.look(h)[1]
        assert ((unit[x] >= 1) & (unit[x] <= B.CLASSES)).all()  # no word is left in a band
    assert not set(unit["n"].tolist()) & set(unit["v"].tolist())


def test_words_ranked_beyond_two_to_the_eighteenth_are_in_the_head():
    assert B.HEAD >= 1 << 20  # the head decides which words get classes of their own choice; it was cut to pass a limit once
