"""Tables that grow with the input are not broadcast for the size of their compressed files."""

import pytest
from pyspark.sql import functions as F

from drawlake.operators import trees as T
from drawlake.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_are_not_broadcast(spark):
    """40,000 rows of a few values are some KB in a file."""
    nodes = spark.range(40_000).select(
        (F.col("id") / 4).cast("bigint").alias("tree_id"), (F.col("id") % 4).alias("node_id"), F.when(F.col("id") % 4 > 0, F.col("id") % 4 - 1).alias("parent_id"), F.lit(0).alias("place"), F.lit("BlockReference").alias("kind")
    )
    x = T.numbered(nodes)
    assert "SortMergeJoin" in plan(x) and "BroadcastHashJoin" not in plan(x)
    assert [tuple(r) for r in x.groupBy("depth", "preorder").count().orderBy("depth").collect()] == [(i, i, 10_000) for i in range(4)]
    y = T.normalised(x)
    assert "SortMergeJoin" in plan(y) and "BroadcastHashJoin" not in plan(y)


@pytest.mark.parametrize("name", ["contour_seeds", "contour_links", "contour_loops", "outer_contours"])
def test_contours_are_not_broadcast(spark, sf_dir, name):
    got = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "SortMergeJoin" in got and "BroadcastHashJoin" not in got
