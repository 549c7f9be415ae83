"""The set of views of a sheet: which views lie in others, which are sure, which are promoted by
those, what each is a projection of, which are primary, and the role of each from its place.

Views have sheet_id, view_id, a box, initial_role (GeometryView, SparseBridge, BadgeMarker,
AnnotationLike or Unknown; null is Unknown), dimensions and geometry (counts), has_center,
has_hidden and is_bridge. Null counts are 0, null flags false. Views without a box are left out.
A sheet's views are looked at in pairs, so their number is that of views squared. Ties go to
the smaller view_id. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.operators.contours import promotions, seed_scores
from drawlake.operators.spatial import best_per
from drawlake.operators.views import projection_score, relations
from drawlake.storage import written

BOX = ("min_x", "min_y", "max_x", "max_y")
KEY = ["sheet_id", "view_id"]
#: What a position is turned round, the role of a view that lies so from the anchor,
#: and the role of one that lies so from a view with such a position.
TURNED = {"Left": "Right", "Right": "Left", "Above": "Below", "Below": "Above", "Overlapping": "Overlapping"}
ROLES = {"Above": "Top", "Below": "Bottom", "Left": "Left", "Right": "Right"}
SECOND_ROLES = {
    ("Above", "Left"): "Left", ("Above", "Right"): "Right", ("Below", "Left"): "Left", ("Below", "Right"): "Right",
    ("Left", "Above"): "Top", ("Left", "Below"): "Bottom", ("Right", "Above"): "Top", ("Right", "Below"): "Bottom",
}


def looked_up(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def seen_from_both(pairs: DataFrame) -> DataFrame:
    """Relations of unordered pairs as those of ordered ones: source, target, where the target
    lies from the source, and whether the source holds the target."""
    a, b, c = B.box("a_"), B.box("b_"), F.col
    inside = lambda child, parent: (F.when(child.area > 1e-9, c("common") / child.area).otherwise(0.0) >= 0.92) & B.contains_point(parent, child.center_x, child.center_y, 1e-6)
    same = ("relation", "in_row", "in_column", "width_like", "height_like", "area_like", "far_x", "far_y", "common")
    # A pair that holds each other is the first one's.
    a_holds, b_holds = inside(b, a), inside(a, b) & ~inside(b, a)

    def one(s: str, t: str, position: Column, holds: Column) -> DataFrame:
        boxes = [F.col(f"{p}_{x}").alias(f"{n}_{x}") for p, n in ((s, "s"), (t, "t")) for x in BOX]
        return pairs.select("sheet_id", F.col(f"{s}_view_id").alias("source"), F.col(f"{t}_view_id").alias("target"), *boxes, *same, position.alias("position"), holds.alias("holds"))

    return one("a", "b", c("position"), a_holds).unionByName(one("b", "a", looked_up(TURNED, c("position")), b_holds))


APART = "relation NOT IN ('EmbeddedFeature', 'ParentChildContainment')"


def hierarchy(views: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds parent_id and embedded (a small feature in its parent), children and top_level (no
    parent, and no bridge). The best parent holds most, is much larger, and holds the middle."""
    s, t, c = B.box("s_"), B.box("t_"), F.col
    bridges = views.filter("is_bridge").select("sheet_id", F.col("view_id").alias("source"))
    held = F.when(t.area > 1e-9, c("common") / t.area).otherwise(0.0)
    share = F.when(s.area > 1e-9, t.area / s.area).otherwise(0.0)
    score = (
        F.when(held >= 0.98, 4).when(held >= 0.95, 3).when(held >= 0.90, 2).otherwise(0) + F.when(share <= 0.10, 3).when(share <= 0.20, 2).when(share <= 0.35, 1).otherwise(0)
        + F.when(B.contains_point(s, t.center_x, t.center_y, 1e-6), 2).otherwise(0)
    )
    found = pairs.filter(f"holds AND NOT {APART}").join(bridges, ["sheet_id", "source"], "left_anti").withColumn("score", score)
    order = [c("score").desc(), F.least("source", "target"), F.greatest("source", "target")]
    best = best_per(found, ["sheet_id", "target"], order).select("sheet_id", c("target").alias("view_id"), c("source").alias("parent_id"), (c("relation") == "EmbeddedFeature").alias("embedded"))
    children = best.groupBy("sheet_id", c("parent_id").alias("view_id")).agg(F.count(F.lit(1)).alias("children"))
    v = views.join(best, KEY, "left").join(children, KEY, "left").na.fill(0, ["children"]).na.fill(False, ["embedded"])
    return v.withColumn("top_level", c("parent_id").isNull() & ~c("is_bridge"))


def sure_and_promoted(views: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds is_seed and final_role: top-level views of enough evidence are sure; others are
    promoted to geometry by the sure one that speaks most for them."""
    c = F.col
    v = seed_scores(views)
    v = v.withColumn("is_seed", c("is_seed") & c("top_level"))
    tops = v.filter("top_level")
    names = {"source": "a_view_id", "target": "b_view_id"} | {f"{p}_{x}": f"{q}_{x}" for p, q in (("s", "a"), ("t", "b")) for x in BOX}
    told = promotions(tops, pairs.withColumnsRenamed(names)).filter("promoted").select(*KEY, F.lit(True).alias("promoted"))
    v = v.join(told, KEY, "left")
    return v.withColumn("final_role", F.when(c("is_seed") | c("promoted"), "GeometryView").otherwise(c("initial_role"))).drop("promoted")


def best_sources(views: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds source_id, position and projection: the best of the other top-level views that a
    top-level view is a projection of."""
    c = F.col
    tops = views.filter("top_level").select(*KEY, (c("final_role") == "GeometryView").alias("geo"))
    side = lambda n: tops.select("sheet_id", c("view_id").alias(n), c("geo").alias(f"{n}_geo"))
    x = pairs.join(side("source"), ["sheet_id", "source"]).join(side("target"), ["sheet_id", "target"])
    score = F.round(projection_score(c("position"), F.when(c("source_geo") & c("target_geo"), 0.25).otherwise(0.0)), 9)
    best = best_per(x.withColumn("projection", score).filter("projection > 0"), ["sheet_id", "target"], [c("projection").desc(), c("source")])
    best = best.select("sheet_id", c("target").alias("view_id"), c("source").alias("source_id"), "position", "projection")
    return views.join(best, KEY, "left")


def primary_views(views: DataFrame, most: int = 3) -> DataFrame:
    """Adds primary_score (-1 for views that can't be primary, null for those in others), and is_primary:
    up to `most` views from 4 points and two fifths of the best, filled up with sure ones."""
    c, b = F.col, B.box()
    sheet = W.partitionBy("sheet_id")
    x = views.withColumns({"w": b.width, "h": b.height, "area": b.area, "mx": b.center_x, "my": b.center_y})
    tops = x.filter("top_level").withColumns({
        "most_area": F.max(F.greatest("area", F.lit(1.0))).over(sheet), "most_dim": F.max("dimensions").over(sheet), "most_span": F.max(F.greatest("w", "h")).over(sheet),
        "off": F.sqrt(F.pow(c("mx") - F.avg("mx").over(sheet), 2) + F.pow(c("my") - F.avg("my").over(sheet), 2)),
        "span": F.greatest(F.max("mx").over(sheet) - F.min("mx").over(sheet), F.max("my").over(sheet) - F.min("my").over(sheet)),
    })
    geo, dim = c("final_role") == "GeometryView", c("dimensions")
    share, short, long = c("area") / c("most_area"), F.least("w", "h"), F.greatest("w", "h")
    aspect = F.when(short > 1e-9, long / short).otherwise(F.lit(float("inf")))
    out = ~geo | ((dim == 0) & (share < 0.05))
    side = c("position").isin("Left", "Right")
    near = (
        F.when(c("position") == "Below", F.least(F.lit(3.5), 1.5 + c("projection") * 1.5)).when(c("position") == "Above", F.least(F.lit(1.5), 0.4 + c("projection") * 0.8))
        .when(side, F.least(F.lit(2.0), 0.8 + c("projection") * 0.9)).otherwise(0.0)
    )
    add = lambda test, points: F.when(test, points).otherwise(0.0)
    thin = F.when(aspect >= 20.0, F.when(dim > 0, -0.75).otherwise(-1.5)).when((aspect >= 12.0) & (short < 80.0), F.when(dim > 0, -0.5).otherwise(-2.0)).otherwise(0.0)
    score = (
        F.lit(6.0) + add(c("has_center"), 4.0) + add(c("has_hidden"), 2.5) + add(c("geometry") >= 6, 1.0) + F.when(c("most_dim") > 0, dim / c("most_dim") * 8.0).otherwise(0.0) + share * 6.0
        + long / F.greatest(F.lit(1.0), c("most_span")) * 2.0 + F.least(F.lit(3.0), c("children") * 0.75) + near
        + F.when(c("span") > 1e-6, (1.0 - F.least(F.lit(1.0), c("off") / c("span"))) * 1.5).otherwise(0.0) + thin + add((dim == 0) & ~c("has_center") & ~c("has_hidden"), -3.0)
    )
    tops = tops.withColumn("primary_score", F.when(out, -1.0).otherwise(F.round(score, 6))).withColumn("able", ~out)
    able = W.partitionBy("sheet_id", "able")
    tops = tops.withColumn("good", c("able") & (c("primary_score") >= F.greatest(F.lit(4.0), F.max("primary_score").over(able) * 0.40)))
    # Good ones first, then sure ones, each by falling score.
    rank = F.row_number().over(sheet.orderBy(c("good").desc(), (c("able") & c("is_seed")).desc(), c("primary_score").desc(), "view_id"))
    good_rank = F.row_number().over(W.partitionBy("sheet_id", "good").orderBy(c("primary_score").desc(), "view_id"))
    tops = tops.withColumns({"_g": F.sum(c("good").cast("int")).over(sheet), "_good_rank": good_rank, "_rank": rank})
    chosen = (c("good") & (c("_good_rank") <= most)) | (~c("good") & c("able") & c("is_seed") & (c("_g") < most) & (c("_rank") <= most))
    tops = tops.select(*KEY, "primary_score", chosen.alias("is_primary"))
    return x.drop("w", "h", "mx", "my").join(tops, KEY, "left").na.fill(False, ["is_primary"])


def anchors(views: DataFrame) -> DataFrame:
    """The representative of each sheet's primary views: sheet_id and anchor."""
    c, b, sheet = F.col, B.box(), W.partitionBy("sheet_id")
    used = views.filter("is_primary").groupBy("sheet_id", c("source_id").alias("view_id")).agg(F.count(F.lit(1)).alias("used"))
    p = views.filter("is_primary").withColumns({"w": b.width, "h": b.height, "mx": b.center_x, "my": b.center_y}).join(used, KEY, "left").na.fill(0, ["used"])
    edge = lambda low, high: (F.min(low).over(sheet), F.max(high).over(sheet))
    (x0, x1), (y0, y1) = edge("min_x", "max_x"), edge("min_y", "max_y")
    part = lambda m, low, high: 1.0 - F.least(F.lit(1.0), F.abs(c(m) - (low + high) * 0.5) / F.greatest(high - low, F.lit(1e-9)))
    most = lambda v, least: F.greatest(F.max(v).over(sheet), F.lit(least))
    long = F.greatest("w", "h")
    score = (
        F.lit(6.0) + F.when(c("has_center"), 2.5).otherwise(0.0) + F.when(c("has_hidden"), 1.5).otherwise(0.0) + c("dimensions") / most("dimensions", 1) * 8.0 + c("area") / most("area", 1.0) * 4.0
        + long / most(long, 1.0) * 2.0 + c("used") * 2.5 + (part("mx", x0, x1) + part("my", y0, y1)) * 0.5 * 1.5
    )
    best = best_per(p.withColumn("_score", F.round(score, 6)), ["sheet_id"], [c("_score").desc(), c("dimensions").desc(), c("area").desc(), c("view_id")])
    return best.select("sheet_id", c("view_id").alias("anchor"))


def roles(views: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds anchor and role. The anchor is the front; of the primary views on each side of it the
    best projection has that side's role; other primary views get theirs from where they lie from
    such a view, or a weak one from their own source. Views of geometry that are not primary are
    references. All others have none."""
    c = F.col
    first = anchors(views)
    prime = views.filter("is_primary").select(*KEY, "primary_score", "area")
    # All primary views are of geometry.
    scored = pairs.filter(APART).withColumn("_score", F.round(projection_score(c("position"), 0.25), 9)).filter("_score > 0")
    to = prime.select("sheet_id", c("view_id").alias("target"), c("primary_score").alias("_p"), c("area").alias("_area"))
    sides = scored.join(first, "sheet_id").filter("source = anchor AND target <> anchor").join(to, ["sheet_id", "target"]).filter(c("position").isin(*ROLES))
    direct = best_per(sides, ["sheet_id", "position"], [c("_score").desc(), c("_p").desc(), c("_area").desc(), c("target")])
    direct = written(direct.select("sheet_id", c("target").alias("view_id"), c("position").alias("base")), "direct-roles")
    # Two hops: from a view beside the anchor to one beside that.
    second = F.create_map(*[F.lit(x) for (p, q), role in SECOND_ROLES.items() for x in (f"{p}>{q}", role)])[F.concat_ws(">", "base", "position")]
    hops = scored.join(direct.select("sheet_id", c("view_id").alias("source"), "base"), ["sheet_id", "source"]).withColumn("second", second).filter(c("second").isNotNull())
    place = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(ROLES) for x in (p, i)]), c("base"))
    hops = best_per(hops, ["sheet_id", "target"], [place]).select("sheet_id", c("target").alias("view_id"), "second")
    v = views.join(first, "sheet_id", "left").join(direct, KEY, "left").join(hops, KEY, "left")
    own = looked_up(ROLES, c("position"))
    role = (
        F.when(c("anchor").isNull(), None)
        .when(c("view_id") == c("anchor"), "Front").when(c("is_primary") & c("base").isNotNull(), looked_up(ROLES, c("base"))).when(c("is_primary") & c("second").isNotNull(), c("second"))
        .when(c("is_primary"), F.coalesce(F.concat(own, F.lit("_Weak")), F.lit("Unresolved")))
        .when(c("top_level") & (c("final_role") == "GeometryView"), F.coalesce(F.concat(own, F.lit("_Reference")), F.lit("ReferenceGeometry")))
    )
    return v.withColumn("role", role).drop("base", "second")


def resolved_views(views: DataFrame) -> DataFrame:
    """The whole chain: parent_id, embedded, children, top_level, is_seed, final_role, source_id,
    position and projection (of top-level views), primary_score, is_primary, anchor and role of
    each view. Every step is a join or window of the sheet's views; pairs are written once."""
    c = F.col
    v = views.filter("min_x IS NOT NULL").na.fill(0, ["dimensions", "geometry"]).na.fill(False, ["has_center", "has_hidden", "is_bridge"]).na.fill("Unknown", ["initial_role"])
    v = v.withColumns({"is_bridge": c("is_bridge") | (c("initial_role") == "SparseBridge"), "has_dimension": c("dimensions") > 0})
    pairs = written(seen_from_both(relations(v)), "view-pairs")
    v = written(sure_and_promoted(hierarchy(v, pairs), pairs), "sure-views")
    v = written(primary_views(best_sources(v, pairs)), "primary-views")
    out = roles(v, pairs)
    return out.select(*KEY, "parent_id", "embedded", "children", "top_level", "is_seed", "final_role", "source_id", "position", "projection", "primary_score", "is_primary", "anchor", "role")
