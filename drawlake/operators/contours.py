"""Seeds of contours and views, promotion of views, masks of pixels, parts around dimensions."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.operators.grids import OUTLINES, proximity_clusters
from drawlake.operators.spatial import best_per, box_join, box_of, connected, prefixed

BOX = ("min_x", "min_y", "max_x", "max_y")


@dataclass(frozen=True)
class SeedOptions:
    """Kinds that may be seeds of strokes."""

    kinds: tuple[str, ...] = ("Line", "Polyline", "Arc", "Circle", "Ellipse", "Spline", "Hatch", "Solid", "Point", "Region")

    def without(self, *kinds: str) -> SeedOptions:
        return replace(self, kinds=tuple(k for k in self.kinds if k not in kinds))


def geometry_seeds(d: DataFrame, opt: SeedOptions = SeedOptions()) -> DataFrame:
    """Primitives of the chosen kinds with usable geometry: lines of two points, curves with a
    radius, others with a box of some size."""
    kind, c = F.col("kind"), F.col
    flat = F.coalesce((c("max_x") - c("min_x") > 0) | (c("max_y") - c("min_y") > 0), F.lit(False))
    usable = (
        F.when(kind == "Line", c("sx").isNotNull() & ~((F.abs(c("sx") - c("ex")) <= 1e-9) & (F.abs(c("sy") - c("ey")) <= 1e-9)))
        .when(kind.isin("Polyline", "Spline"), F.lit(True)).when(kind == "Circle", c("radius") > 0).when(kind == "Arc", (c("radius") > 0) & c("start_deg").isNotNull() & c("end_deg").isNotNull())
        .when(kind == "Ellipse", (c("radius") > 0) & (c("radius") * c("ratio") > 0)).otherwise(flat)
    )
    return d.filter(kind.isin(*opt.kinds) & F.coalesce(usable, F.lit(False)))


def contour_sources(d: DataFrame, view: B.Box, linetype: Column) -> DataFrame:
    """Strokes that may be on a contour: boxed, meeting the view, of six kinds, neither centre
    nor hidden lines nor on layers of titles and tables."""
    flags = K.semantic_flags(F.col("layer"), linetype)
    ok = F.col("kind").isin("Line", "Polyline", "Arc", "Circle", "Ellipse", "Face") & ~flags["is_center_line"] & ~flags["is_hidden_line"] & ~flags["is_noise"]
    return d.filter(F.col("min_x").isNotNull() & B.intersects(B.box(), view) & ok)


def outer_seeds(edges: DataFrame, share: float = 0.10, least: float = 4.0) -> DataFrame:
    """Edges that meet the bands along the four sides of their sheet's box: sheet_id, handle,
    side, score (length, 400 on contour layers, and up to 100 for lying close to the side). An
    edge may be a seed of several sides."""
    s = B.box("s_")
    band = F.greatest(F.lit(least), F.least(s.width, s.height) * share)
    sides = {
        "Top": B.Box(s.min_x, s.max_y - band, s.max_x, s.max_y), "Bottom": B.Box(s.min_x, s.min_y, s.max_x, s.min_y + band),
        "Left": B.Box(s.min_x, s.min_y, s.min_x + band, s.max_y), "Right": B.Box(s.max_x - band, s.min_y, s.max_x, s.max_y),
    }
    x = edges.join(prefixed(box_of(edges, "sheet_id").drop("n"), "s_"), "sheet_id")
    e = B.box()
    off = {"Top": s.max_y - e.max_y, "Bottom": e.min_y - s.min_y, "Left": e.min_x - s.min_x, "Right": s.max_x - e.max_x}
    close = lambda n: F.greatest(F.lit(0.0), F.lit(100.0) - F.abs(off[n]))
    hits = F.array_compact(F.array(*[F.when(B.intersects(e, b), F.struct(F.lit(n).alias("side"), close(n).alias("close"))) for n, b in sides.items()]))
    base = F.col("length") + F.when(K.mentions(K.plain(F.col("layer")), K.FLAG_CONTOUR), 400.0).otherwise(0.0)
    return x.withColumn("_hit", F.explode(hits)).select("sheet_id", "handle", "_hit.side", (base + F.col("_hit.close")).alias("score"))


# --- views ----------------------------------------------------------------------------------------


def seed_scores(views: DataFrame) -> DataFrame:
    """Adds seed_score and is_seed (0.75 and more): dimensions, centre and hidden lines, geometry."""
    c = F.col
    one = lambda test, points: F.when(test, points).otherwise(0.0)
    score = one(c("has_dimension"), 0.35) + one(c("has_center"), 0.55) + one(c("has_hidden"), 0.40) + one(c("geometry") >= 3, 0.15) + one(~c("is_bridge"), 0.10)
    return views.withColumn("seed_score", F.round(score, 9)).withColumn("is_seed", F.round(score, 9) >= 0.75)


def promotions(views: DataFrame, pairs: DataFrame, most_aspect: float = 8.0) -> DataFrame:
    """For each view that is no seed, the seed that speaks most for it: view_id, source_id, score
    and promoted (0.55 and more). pairs: relations of seeds (a) to candidates (b), from both
    sides. Views without a seed that is apart from them score 0."""
    flags = ("has_dimension", "has_center", "has_hidden", "is_seed")
    one = lambda p, which: views.filter(which).select("sheet_id", F.col("view_id").alias(f"{p}_view_id"), *[F.col(f).alias(f"{p}_{f}") for f in flags])
    x = pairs.join(one("a", "is_seed"), ["sheet_id", "a_view_id"]).join(one("b", "NOT is_seed"), ["sheet_id", "b_view_id"]).filter("relation NOT IN ('EmbeddedFeature', 'ParentChildContainment')")
    a, b, c = B.box("a_"), B.box("b_"), F.col
    add = lambda test, points: F.when(test, points).otherwise(0.0)
    same_size = (c("width_like") >= 0.45) & (c("height_like") >= 0.45) & (c("area_like") >= 0.20)
    aspect = F.when(F.least(b.width, b.height) > 0, F.greatest(b.width, b.height) / F.least(b.width, b.height)).otherwise(9999.0)
    score = (
        add(c("in_row"), 0.20) + add(c("in_column"), 0.20) + add(same_size, 0.20) + add(F.when(a.area > 1e-9, b.area / a.area).otherwise(0.0) >= 0.20, 0.15) + add(aspect <= most_aspect, 0.10)
        + add(c("b_has_center"), 0.20) + add(c("b_has_hidden"), 0.15) + add(c("a_has_center") & c("b_has_center"), 0.10) + add(c("a_has_hidden") & c("b_has_hidden"), 0.08) + add(c("b_has_dimension"), 0.15)
        + F.when(c("position") == "Below", 0.15).when(c("position") == "Above", 0.05).otherwise(0.0)
    )
    best = best_per(x.withColumn("score", F.round(score, 9)), ["sheet_id", "b_view_id"], [F.col("score").desc(), F.col("a_view_id")])
    found = best.select("sheet_id", F.col("b_view_id").alias("view_id"), F.col("a_view_id").alias("source_id"), "score", "position")
    rest = views.filter("NOT is_seed").select("sheet_id", "view_id")
    return rest.join(found, ["sheet_id", "view_id"], "left").select("sheet_id", "view_id", "source_id", F.coalesce("score", F.lit(0.0)).alias("score"), "position", F.coalesce(F.col("score") >= 0.55, F.lit(False)).alias("promoted"))


# --- zones ----------------------------------------------------------------------------------------

ZONE = "sheet_id BIGINT, zone_id BIGINT, zone_kind STRING, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, score DOUBLE, parts INT"


def merge_zone_list(zones: list[dict], least: float = 0.20) -> list[dict]:
    """Zones by kind and falling score: each joins the first one kept of its kind whose box, as
    grown so far, shares `least` of the smaller area with it."""
    kept: list[dict] = []
    for z in sorted(zones, key=lambda z: (z["zone_kind"], -z["score"], z["zone_id"])):
        for k in kept:
            w = min(k["max_x"], z["max_x"]) - max(k["min_x"], z["min_x"])
            h = min(k["max_y"], z["max_y"]) - max(k["min_y"], z["min_y"])
            small = min((x["max_x"] - x["min_x"]) * (x["max_y"] - x["min_y"]) for x in (k, z))
            if k["zone_kind"] == z["zone_kind"] and w > 0 and h > 0 and small > 0 and w * h / small >= least:
                k |= {c: (min if c.startswith("min") else max)(k[c], z[c]) for c in BOX}
                k["score"], k["parts"] = max(k["score"], z["score"]), k["parts"] + 1
                break
        else:
            kept.append(dict(z, parts=1))
    return kept


def merged_zones(zones: DataFrame, least: float = 0.20) -> DataFrame:
    """merge_zone_list of every sheet; the order of joining matters, so a sheet's zones meet in one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(merge_zone_list(rows.to_dict("records"), least))[[c.split()[0] for c in ZONE.split(", ")]]

    return zones.select("sheet_id", "zone_id", "zone_kind", *BOX, "score").groupBy("sheet_id").applyInPandas(run, ZONE)


# --- masks ----------------------------------------------------------------------------------------


PIXEL_ROW = 1 << 32  # numbers of a row's pixels


def mask_islands(pixels: DataFrame) -> DataFrame:
    """Islands of pixels (sheet_id, row, col) that touch on a side or a corner: the number of its
    first pixel (row * 2^32 + 2^31 + col), area, box in pixels (x, y, width, height) and aspect.
    Rows and columns may be of any size below 2^31, negative too."""
    nodes = pixels.select("sheet_id", "row", "col", (F.col("row").cast("bigint") * PIXEL_ROW + (F.col("col") + PIXEL_ROW // 2)).alias("handle")).distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    moved = nodes.select("*", steps.alias("s")).select("sheet_id", F.col("handle").alias("a"), (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    edges = moved.join(nodes.withColumnRenamed("handle", "b"), ["sheet_id", "row", "col"]).select("sheet_id", "a", "b")
    g = connected(nodes, edges).groupBy("sheet_id", F.col("component").alias("island")).agg(
        F.count(F.lit(1)).alias("area"), F.min("col").alias("x"), F.min("row").alias("y"), (F.max("col") - F.min("col") + 1).alias("width"), (F.max("row") - F.min("row") + 1).alias("height")
    )
    return g.withColumn("aspect", F.col("width") / F.col("height"))


def cluster_hints(clusters: DataFrame, sheet_width: Column, sheet_height: Column) -> DataFrame:
    """Adds hint and confidence: long rows, large regions, many children, or other content."""
    c = F.col
    hint = (
        F.when(c("aspect") > 3.0, "LongRowSheetCollection").when((c("width") > sheet_width * 0.4) & (c("height") > sheet_height * 0.4), "SingleOuterFrameOrFramedClusters")
        .when(c("children") >= 5, "InternalContentClusters").otherwise("InternalContentCluster")
    )
    confidence = F.when(c("aspect") > 3.0, 0.65).when(hint == "InternalContentCluster", 0.55).otherwise(0.60)
    return clusters.withColumn("hint", hint).withColumn("confidence", confidence)


# --- parts ----------------------------------------------------------------------------------------


def dimension_parts(e: DataFrame, eps_dimension: float, eps_part: float) -> DataFrame:
    """Outlines that meet the box of a cluster of near dimensions, grouped by nearness within
    it: sheet_id, dimension cluster, part (smallest member) and its members, two at least."""
    dims = proximity_clusters(e.filter(K.is_dimension(F.col("kind"))), eps_dimension)
    boxes = box_of(dims, "sheet_id", "component").drop("n")
    outlines = e.filter(F.col("kind").isin(*OUTLINES)).select("sheet_id", "handle", *BOX)
    pairs = box_join(boxes, outlines, 0.0, 128.0).select("sheet_id", F.col("a_component").alias("dimensions"), F.col("b_handle").alias("handle"), *[F.col(f"b_{c}").alias(c) for c in BOX])
    # A cluster's outlines are a graph of their own, so that two clusters may share an outline.
    found = proximity_clusters(pairs, eps_part, ("sheet_id", "dimensions")).groupBy("sheet_id", "dimensions", "component").agg(F.count(F.lit(1)).alias("n"))
    return found.filter("n >= 2").select("sheet_id", "dimensions", F.col("component").alias("part"), "n")
