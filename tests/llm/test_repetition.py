"""Repetition rules (13) against brute force over all pairs of positions."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.repetition import COLUMNS, MIN_REPEAT, maximal_repeats, measure, quality_rules
from tessera.llm.words import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest_at(words):
    """Longest repeat at every word: all pairs, word by word."""
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                h = 0
                while i + h < n and j + h < n and words[i + h] == words[j + h]:
                    h += 1
                out[i] = max(out[i], h)
    return out


def brute(text, least):
    words = WORD.findall(text or "")
    n, longest = len(words), longest_at(words)
    triples = [tuple(words[i:i + 3]) for i in range(n - 2)]
    again = {i + d for i, t in enumerate(triples) if triples.count(t) > 1 for d in range(3)}
    spans = {i + d for i in range(n) if longest[i] >= least for d in range(longest[i])}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return [n, sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(again), len(spans), max(longest, default=0)]


def brute_repeats(words, least):
    """{words of a maximal repeat: occurrences}."""
    n, out = len(words), {}
    for size in range(least, n):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i:i + size]), []).append(i)
        for gram, at in places.items():
            left = {words[i - 1] if i else ("begin",) for i in at}
            right = {words[i + size] if i + size < n else ("end",) for i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                out[gram] = len(at)
    return out


def texts():
    r = random.Random(5)
    out = [None, "", " \n\t ", "one", "a a", "a a a a a a a a a a a a", "x\n\nx\n x\nx\n", "é ü é ü é ü # <b> é ü", "a b c a b c a b d"]
    for size in (5, 20, 60, 150):
        for letters in ("ab", "abcde", "abcdefghijklmnop"):
            out.append("".join(r.choice(letters) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(size)))
    block = " ".join(f"w{i}" for i in range(40))
    return out + [f"{block} end {block}", f"{block}\n{block}\n{block}"]


def test_all_columns_against_all_pairs(spark, docs):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in quality_rules(docs(rows), min_repeat=4).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r, want = got[i], brute(text, 4)
        assert [r[c] for c in COLUMNS[:-1]] == want, text
        n, _, _, _, again, spans, longest = want
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        assert r.kept == (not r.base_failed and spans <= 0.4 * n and longest <= 50)
        assert r.n_maximal_repeats == len(brute_repeats(WORD.findall(text or ""), 4))


def test_maximal_repeats_are_the_brute_force_ones(spark, docs):
    rows = list(enumerate(texts()))
    found = {i: {} for i, _ in rows}
    for r in maximal_repeats(docs(rows), min_repeat=2).collect():
        words = WORD.findall(texts()[r.doc_id] or "")
        found[r.doc_id][tuple(words[r.start:r.start + r.length])] = r.occurrences
    for i, text in rows:
        assert found[i] == brute_repeats(WORD.findall(text or ""), 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=6))
def test_texts_of_one_chunk_do_not_meet(many):
    import pyarrow as pa
    column = pa.array([" ".join(w) for w in many], pa.string())
    rows = [list(x) for c in chunks(column) for x in zip(*measure(c, 3), strict=True)]
    assert [r[:7] for r in rows] == [brute(" ".join(w), 3) for w in many]


def test_rows_ids_and_extra_columns(spark):
    schema = "text string, doc_id long, _id int, kept string, n_words int"
    rows = [("a b c", 1, 7, "x", 3), ("a b c", 1, 7, "x", 3), (None, None, None, None, None)]
    got = quality_rules(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 0, False), (1, 3, False), (1, 3, False)]
    assert quality_rules(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("text", ["same " * 300_000, " ".join(map(str, range(200_000))), "x" * 1_000_000])
def test_very_long_texts(spark, docs, text):
    r = quality_rules(docs([(1, text)])).collect()[0]
    n = len(WORD.findall(text))
    repeated = len(set(WORD.findall(text))) < n
    assert (r.n_words, r.longest_repeat) == (n, n - 1 if repeated else 0)
    assert r.kept == (n >= 50 and not repeated)


def test_long_repeat_fails_where_base_rules_hold(spark, docs):
    r = random.Random(1)
    filler = [f"f{r.random()}" for _ in range(400)]
    passage = [f"p{i}" for i in range(60)]
    clean = filler[:150] + passage + filler[150:]
    twice = filler[:100] + passage + filler[100:300] + passage + filler[300:]
    got = {x.doc_id: x for x in quality_rules(docs([(1, " ".join(clean)), (2, " ".join(twice))])).collect()}
    assert (got[1].kept, got[2].base_failed, got[2].kept) == (True, False, False)
    assert got[2].n_covered == 120 and got[2].longest_repeat == 60 >= MIN_REPEAT
