"""Splits keep whole rows out of the sort and the cache; repeated and null ids keep all their rows."""

from collections import Counter

import pytest

from tessera.operators import sampling as P


def rows(spark, ids):
    return spark.createDataFrame([(i, "ab"[n % 2], f"text {n}") for n, i in enumerate(ids)], "id long, s string, text string")


@pytest.mark.parametrize("split", [lambda df: P.split_ordered(df, "id"), lambda df: P.split_stratified(df, "id", "s")])
def test_texts_are_not_cached_or_sorted(spark, split):
    plan = split(rows(spark, range(40)))._jdf.queryExecution().optimizedPlan().toString()
    cached = [x for x in plan.splitlines() if "InMemoryRelation" in x]
    assert cached and not any("text" in x for x in cached), plan


@pytest.mark.parametrize("ids", [list(range(100)), [*range(60), *[7] * 20, *[None] * 20]])
def test_every_row_gets_one_split(spark, ids):
    df = rows(spark, ids)
    for got, parts in ((P.split_ordered(df, "id"), [100]), (P.split_stratified(df, "id", "s"), [50, 50])):
        assert got.columns == ["id", "s", "text", "split"]
        found = got.collect()
        assert sorted(r.text for r in found) == sorted(r.text for r in df.collect())
        want = Counter()
        for n in parts:
            want.update({"train": int(.7 * n), "val": int(.15 * n)})
            want["test"] += n - int(.7 * n) - int(.15 * n)
        assert Counter(r.split for r in found) == want
