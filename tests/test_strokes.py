"""Strokes in steps are those of the one query that the SQL is made of."""

from drawlake.sources import strokes as S


def test_steps_equal_the_query(spark, sf_dir):
    whole = spark.sql(S.STROKES.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    got = S.strokes(spark, sf_dir)
    assert got.schema == whole.schema and got.rdd.getNumPartitions() == whole.rdd.getNumPartitions()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))


def test_the_jvm_compiles_every_step(spark, sf_dir):
    """It does not compile methods of more than 8000 bytes."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(S.strokes(spark, sf_dir)._jdf.queryExecution().executedPlan())
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) <= 8000
