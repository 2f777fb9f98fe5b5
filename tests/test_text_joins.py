"""Ticket texts are read without the labels they do not use."""

from __future__ import annotations

import pytest

from tessera.sources.tables import v_text


def _tables(spark, base, labels):
    docs = [(1, "one", "en", "a", 3), (2, "two", "de", None, 3), (3, None, None, "b", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return v_text(spark, str(base))


@pytest.mark.parametrize("labels, joins", [([(1, 0, 1), (3, 1, None), (None, 1, 1), (None, 0, 0)], False), ([(1, 0, 1), (1, 1, 1)], True)])
def test_labels_are_joined_only_where_they_are_read_or_repeat(spark, tmp_path, labels, joins):
    v = _tables(spark, tmp_path, labels)
    want = {}
    for i, q, t in labels:
        want.setdefault(i, []).append((q, t))
    assert sorted((r.id, r.quality, r.toxic) for r in v.select("id", "quality", "toxic").collect() if r.id) == sorted((i, *x) for i in (1, 2, 3) for x in want.get(i, [(None, None)]))
    texts = v.select("id", "description")
    assert ("Join" in texts._jdf.queryExecution().optimizedPlan().toString()) == joins
    assert texts.count() == sum(len(want.get(i, [0])) for i in (1, 2, 3))
