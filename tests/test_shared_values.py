"""Entity values that queries share with documents."""

from tessera.operators import graph as H


def test_pairs_are_distinct_without_being_compared(spark):
    """one task held its pairs in a hash table; they grow with the product of both sides."""
    q = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "a", "x"), (2, "a", "y"), (3, "a", None), (None, "a", "x")], "query_id long, type string, value string")
    e = spark.createDataFrame([(7, "a", "x"), (7, "c", "x"), (8, "a", "x"), (8, "a", "y"), (9, "a", None), (None, "b", "y")], "doc_id long, type string, value string")
    out = H.shared_values(q, e)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 7, "x"), (1, 8, "x"), (2, 8, "y"), (2, None, "y"), (None, 7, "x"), (None, 8, "x")], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # no aggregate above the join
