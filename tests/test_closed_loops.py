"""Every polyline's outline counts, whatever its handle."""

from pyspark.sql import functions as F

from drawlake.plans import more
from drawlake.sources.drawings import entities


def test_loops_do_not_depend_on_handles(spark, sf_dir):
    e = entities(spark, sf_dir)
    want = sorted(map(tuple, more.closed_loops(e).collect()))
    for shift in (1, 2):
        moved = e.withColumn("handle", F.col("handle") + shift)
        assert sorted(map(tuple, more.closed_loops(moved).collect())) == want
    assert want
