"""The pipeline's stages against brute-force versions of what each keeps."""

import corpus_pipeline
from conftest import SMOKE
from tessera.llm import toxicity
from tessera.llm.registry import table

from . import test_decontaminate, test_exact_dedup, test_mixing, test_simhash


def test_stages(spark):
    docs = table(spark, SMOKE, "documents")
    left = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, SMOKE, "benchmark").collect()]
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, table(spark, SMOKE, "labels")).collect() if r.predicted}
    keep = [
        lambda rows: {i for i, _ in rows if i not in toxic},
        lambda rows: {r[0] for r in test_exact_dedup.brute(rows) if r[3]},
        lambda rows: {r[2] for r in test_simhash.brute_components(rows)},
        lambda rows: {r[0] for r in test_decontaminate.brute(rows, items) if not r[2]},
    ]
    for (name, function), kept in zip(corpus_pipeline.STAGES, keep, strict=False):
        before = docs
        docs = function(spark, docs, SMOKE)
        assert docs.columns == before.columns, name
        stay = kept(sorted(left.items()))
        left = {i: t for i, t in left.items() if i in stay}
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert rows == left, name
    last = corpus_pipeline.run(spark, SMOKE).collect()
    assert {r.doc_id: r.size for r in last} == {i: test_mixing.words(t) for i, t in left.items()}
