"""Zones told apart by their boxes and by their members."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.operators.spatial import box_join
from drawlake.storage import drop_written, written

BOX = ("min_x", "min_y", "max_x", "max_y")
KEY = ["sheet_id", "zone_id"]


@dataclass(frozen=True)
class ZoneOptions:
    """From which overlap two zones are one. Fixed values."""

    boxes: float = 0.75  # of the union of their boxes
    members: float = 0.80  # of the members of the smaller one


def zone_conflicts(zones: DataFrame, members: DataFrame, opt: ZoneOptions = ZoneOptions()) -> DataFrame:
    """Pairs of a sheet's zones that are one: sheet_id, a, b (both ways). Boxes meet by cells,
    members by handle: a zone's distinct members are counted once."""
    a, b, c = B.box("a_"), B.box("b_"), F.col
    z = zones.select(*KEY, *BOX)
    common = B.intersection_area(a, b)
    joint = a.area + b.area - common
    by_box = box_join(z, z, 0.0, 128.0).filter((c("a_zone_id") != c("b_zone_id")) & (joint > 0) & (common >= joint * opt.boxes)).select("sheet_id", c("a_zone_id").alias("a"), c("b_zone_id").alias("b"))
    m = members.select(*KEY, "handle").filter("handle IS NOT NULL").distinct()
    sizes = m.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: m.select("sheet_id", "handle", c("zone_id").alias(s))
    shared = side("a").join(side("b"), ["sheet_id", "handle"]).filter("a <> b").groupBy("sheet_id", "a", "b").agg(F.count(F.lit(1)).alias("both"))
    of = lambda s: sizes.select("sheet_id", c("zone_id").alias(s), c("n").alias(f"{s}_n"))
    by_member = shared.join(of("a"), ["sheet_id", "a"]).join(of("b"), ["sheet_id", "b"]).filter(c("both") >= F.least("a_n", "b_n") * opt.members).select("sheet_id", "a", "b")
    return by_box.unionByName(by_member).distinct()


def distinct_zones(zones: DataFrame, members: DataFrame, opt: ZoneOptions = ZoneOptions(), most_rounds: int = 1000) -> DataFrame:
    """Zones by falling score, then by zone_id, without those that are one with a zone kept before.

    zones: sheet_id, zone_id, score and a box; members: sheet_id, zone_id, handle. A null score is
    the least; zones without a box or without members overlap nothing in that respect. What is
    kept follows from the pairs alone, so it is found in rounds over all sheets at once: a zone
    goes when one that is one with it and comes before it is kept, and is kept when all such have
    gone. The rounds are those of the longest chain of such pairs. An empty table gives no rows.
    """
    c = F.col
    order = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), c("zone_id").alias("z"))
    ranked = zones.select(*KEY, order.alias("rank"))
    side = lambda s: ranked.select("sheet_id", c("zone_id").alias(s), c("rank").alias(f"{s}_rank"))
    earlier = zone_conflicts(zones, members, opt).join(side("a"), ["sheet_id", "a"]).join(side("b"), ["sheet_id", "b"]).filter("a_rank < b_rank").select("sheet_id", "a", "b")
    earlier = written(earlier, "zone-pairs")
    state = written(zones.select(*KEY).distinct().withColumn("kept", F.lit(None).cast("boolean")), "zone-state")
    for _ in range(most_rounds):
        before = earlier.join(state.select("sheet_id", c("zone_id").alias("a"), c("kept").alias("_k")), ["sheet_id", "a"])
        told = before.groupBy("sheet_id", c("b").alias("zone_id")).agg(F.bool_or(F.coalesce("_k", F.lit(False))).alias("_beaten"), F.bool_and(~F.coalesce("_k", F.lit(True))).alias("_free"))
        after = state.join(told, KEY, "left").select(*KEY, F.coalesce("kept", F.when(c("_beaten"), False).when(F.coalesce("_free", F.lit(True)), True)).alias("kept"))
        after = written(after, "zone-state")
        drop_written(state)
        state = after
        if state.filter("kept IS NULL").isEmpty():
            return zones.join(state.filter("kept").select(*KEY), KEY, "left_semi")
    raise RuntimeError(f"zones are not told apart after {most_rounds} rounds")
