"""Small batches on a long chain."""

from tallyweave.streaming import ingest as T


def test_a_small_batch_goes_to_the_chain(spark):
    """Not the chain to the batch: no shuffle of what is there."""
    ours = spark.range(500).selectExpr("concat('h', id) hash", "id height")
    batch = spark.createDataFrame([("h7",), ("x",)], "hash string")
    there = T._there(ours, batch)
    assert [r.hash for r in there.collect()] == ["h7"]
    plan = there._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
