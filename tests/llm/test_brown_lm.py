"""Class-based LM against plain counting; the model is a probability; clustering raises the likelihood."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import brown_lm as B

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def toks(t):
    return [*(t or "").encode().translate(UPPER).split(), None]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def make(n=80, seed=1):
    r = random.Random(seed)
    groups = [["der", "die", "das"], ["Haus", "tür", "hund"], ["the", "a"], ["house", "DOOR", "dog"]]
    rows = []
    for k in range(n):
        g = r.choice([0, 2])
        rows.append((k, " ".join(w for _ in range(r.randint(0, 40)) for w in (r.choice(groups[g]), r.choice([*groups[g + 1], f"w{r.randrange(400)}"])))))
    return rows + [(500, None), (501, " \n"), (None, "the house"), (3, rows[4][1]), (3, rows[4][1]), (502, "x" * 9 + " the" * 20000)]


def plain(rows, model, head):
    c = Counter(t for i, x in rows if not out(i) for t in toks(x))
    n, v = sum(c.values()), len(c)
    rare_total = sum(x for w, x in c.items() if w is not None and w not in head)
    rare_types = sum(1 for w in c if w is not None and w not in head)
    unit = lambda w: 0 if w is None else head[w] if w in head else B.RARE
    cls = model.cls
    pair, size = Counter(), Counter()
    for i, x in rows:
        if not out(i):
            prev = None
            for t in toks(x):
                pair[cls[unit(prev)], cls[unit(t)]] += 1
                size[cls[unit(t)]] += 1
                prev = t
    left = Counter()
    for (a, _), m in pair.items():
        left[a] += m
    res = []
    for i, x in rows:
        ts, base, score, prev = toks(x), 0.0, 0.0, None
        for t in ts:
            base += math.log10((c[t] + 1) / (n + v + 1))
            a, k = cls[unit(prev)], cls[unit(t)]
            p = (pair[a, k] + (size[k] + (k == cls[B.RARE])) / (n + 1)) / (left[a] + 1)
            p *= (c[t] + 1) / (rare_total + rare_types + 1) if unit(t) == B.RARE else c[t] / size[k]
            score += math.log10(p)
            prev = t
        res.append((i, out(i), len(ts), sum(c[t] > 0 for t in ts), n, base, score))
    return sorted(res, key=repr)


@pytest.mark.parametrize("head", [30, 100000])
def test_against_plain_counting(spark, docs, head, monkeypatch):
    rows = make()
    df = docs(rows).withColumn("h", F.lit(1)).withColumn("uid", F.lit(2))
    model, counts = B.fit(df.where(~B.held_out("doc_id")), "text", head)
    # words of the head by their hashes
    import pyarrow as pa
    from tessera.llm.words import chunks
    names = sorted({t for _, x in rows for t in toks(x) if t is not None})
    hashes = np.concatenate([c.hashes() for c in chunks(pa.array([w.decode() for w in names]))])
    place, unit = model.head.look(hashes)
    units = {w: int(u) for w, u in zip(names, unit) if u != B.RARE}
    got = sorted((tuple(r) for r in B.score_lm(df, head=head).collect()), key=repr)
    for g, e in zip(got, plain(rows, model, units), strict=True):
        assert g[:5] == e[:5]
        assert g[5:] == pytest.approx(e[5:], rel=1e-9)
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])  # better than the base on held-out texts


def test_exchange_raises_likelihood():
    r = np.random.default_rng(0)
    n = r.integers(0, 5, (40, 40))
    n[:20, 20:] += 30
    movable = np.arange(40)

    def value(cls):
        a = np.zeros((2, 2))
        np.add.at(a, (cls[:, None], cls[None, :]), n)
        return B.xlogx(a).sum() - B.xlogx(a.sum(0)).sum() - B.xlogx(a.sum(1)).sum()
    best = B.exchange(n, movable, 2)
    assert value(best) > value(np.arange(40) % 2)
    for w in range(40):  # no single exchange raises it further
        other = best.copy()
        other[w] = 1 - other[w]
        assert value(other) <= value(best) + 1e-6


def test_empty(spark, docs):
    assert B.score_lm(docs([])).count() == 0
    held = next(i for i in range(100) if out(i))
    r = B.score_lm(docs([(held, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_rare_words_meet_their_counts_without_a_join(spark, docs, monkeypatch):
    """F op2: the join of (text, rare word) grew from 0.2 to 3.1 million rows where the texts grew five times."""
    rows = [(k, " ".join(f"w{(k * j) % 97}" for j in range(30))) for k in range(300)] + [(None, "w1 unknown"), (7, None)]
    df = docs(rows)
    whole = B.score_lm(df, head=20)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((tuple(r) for r in whole.collect()), key=repr)
    monkeypatch.setattr(B, "BUCKET", 5)
    got = sorted((tuple(r) for r in B.score_lm(df, head=20).collect()), key=repr)
    assert [w[:5] for w in want] == [g[:5] for g in got] and all(w[5:] == pytest.approx(g[5:]) for w, g in zip(want, got, strict=True))


def test_places_of_long_texts(monkeypatch):
    """Written places are read in pieces of whole texts; none is cut or lost."""
    import pyarrow as pa
    texts = [list(range(k, k + n)) for k, n in ((0, 1), (5, 40), (9, 3), (2, 100), (1, 1))]
    column = pa.array([np.array(t, np.int32).tobytes() for t in [[4, 4], *texts]], pa.binary()).slice(1)
    monkeypatch.setattr(B, "AT_ONCE", 10)
    got = [at[a:b].tolist() for at, edges in B.placed(column) for a, b in zip(edges, edges[1:])]
    assert got == texts
