"""Entities in sheets, grid cells and columns; values beside headers; loose texts and badges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.functions import primitives as P
from drawlake.operators.spatial import best_per, box_join

BOX = ("min_x", "min_y", "max_x", "max_y")


def owner_sheets(e: DataFrame, sheets: DataFrame) -> DataFrame:
    """For each entity the frame that holds its centre (the one it overlaps most, if several
    do), else the one it overlaps most, else none: adds owner. sheets: sheet_id, frame_id, box."""
    a, b = B.box("a_"), B.box("b_")
    pairs = box_join(e.select("sheet_id", "handle", *BOX), sheets.select("sheet_id", "frame_id", *BOX), 1e-6, 128.0)
    inside, area = B.contains_point(b, a.center_x, a.center_y, 1e-6), B.intersection_area(a, b)
    ok = pairs.withColumn("_in", inside.cast("int")).withColumn("_area", area).filter(inside | (area > 1e-6))
    best = best_per(ok, ["sheet_id", "a_handle"], [F.col("_in").desc(), F.col("_area").desc(), F.col("b_frame_id")])
    return e.join(best.select("sheet_id", F.col("a_handle").alias("handle"), F.col("b_frame_id").alias("owner")), ["sheet_id", "handle"], "left")


def first_sheets(e: DataFrame, sheets: DataFrame) -> DataFrame:
    """The first frame, by id, that holds an entity's centre: adds owner."""
    a, b = B.box("a_"), B.box("b_")
    pairs = box_join(e.select("sheet_id", "handle", *BOX), sheets.select("sheet_id", "frame_id", *BOX), 0.0, 128.0).filter(B.contains_point(b, a.center_x, a.center_y))
    first = pairs.groupBy("sheet_id", F.col("a_handle").alias("handle")).agg(F.min("b_frame_id").alias("owner"))
    return e.join(first, ["sheet_id", "handle"], "left")


def line_cuts(lines: DataFrame, least: float = 200.0) -> DataFrame:
    """Distinct coordinates of the ends of long lines: sheet_id, axis, cut and the next cut."""
    long = lines.filter(F.sqrt(F.pow(F.col("ex") - F.col("sx"), 2) + F.pow(F.col("ey") - F.col("sy"), 2)) > least)
    ends = F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(c).alias("cut")) for axis, c in (("x", "sx"), ("x", "ex"), ("y", "sy"), ("y", "ey"))])
    cuts = long.select("sheet_id", F.explode(ends).alias("c")).select("sheet_id", "c.*").distinct()
    return cuts.withColumn("next", F.lead("cut").over(W.partitionBy("sheet_id", "axis").orderBy("cut"))).filter("next IS NOT NULL")


def logical_cells(lines: DataFrame, least: float = 200.0, side: float = 100.0) -> DataFrame:
    """Cells between neighbouring cuts of both axes that are at least `side` wide and high:
    sheet_id, row and col (from the lowest cut) and box. Each cell is an answer."""
    cuts = line_cuts(lines, least)
    place = F.row_number().over(W.partitionBy("sheet_id", "axis").orderBy("cut")) - 1
    cuts = cuts.withColumn("place", place).filter(F.col("next") - F.col("cut") >= side)
    one = lambda axis, low, high, name: cuts.filter(F.col("axis") == axis).select("sheet_id", F.col("cut").alias(low), F.col("next").alias(high), F.col("place").alias(name))
    return one("x", "min_x", "max_x", "col").join(one("y", "min_y", "max_y", "row"), "sheet_id").select("sheet_id", "row", "col", *BOX)


def points_in_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with the points (x, y) that they hold, borders included."""
    p = points.select("sheet_id", "handle", F.col("px").alias("min_x"), F.col("py").alias("min_y"), F.col("px").alias("max_x"), F.col("py").alias("max_y"))
    pairs = box_join(p, cells, 0.0, 256.0)
    return pairs.select("sheet_id", F.col("a_handle").alias("handle"), F.col("b_row").alias("row"), F.col("b_col").alias("col"))


def grid_lines(lines: DataFrame, cells: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Lines to be left out of a cell's content: along a cut from cut to cut, or upright or
    level and longer than two mean cells. Adds is_grid."""
    cuts = cells.groupBy("sheet_id").agg(
        F.collect_set("min_x").alias("_x0"), F.collect_set("max_x").alias("_x1"), F.collect_set("min_y").alias("_y0"), F.collect_set("max_y").alias("_y1"),
        F.avg(F.col("max_x") - F.col("min_x")).alias("mean_w"), F.avg(F.col("max_y") - F.col("min_y")).alias("mean_h"),
    ).select("sheet_id", F.array_union("_x0", "_x1").alias("xs"), F.array_union("_y0", "_y1").alias("ys"), "mean_w", "mean_h")
    near = lambda cuts, v, t: F.exists(cuts, lambda c: F.abs(c - v) <= t)
    dx, dy = F.abs(F.col("ex") - F.col("sx")), F.abs(F.col("ey") - F.col("sy"))
    flat = (dy <= tolerance) & near(F.col("ys"), F.col("sy"), tolerance) & near(F.col("xs"), F.col("sx"), 2 * tolerance) & near(F.col("xs"), F.col("ex"), 2 * tolerance)
    upright = ~(dy <= tolerance) & (dx <= tolerance) & near(F.col("xs"), F.col("sx"), tolerance) & near(F.col("ys"), F.col("sy"), 2 * tolerance) & near(F.col("ys"), F.col("ey"), 2 * tolerance)
    long = ((dy < 1e-6) & (dx > F.col("mean_w") * 2.0)) | ((dx < 1e-6) & (dy > F.col("mean_h") * 2.0))
    return lines.join(cuts, "sheet_id", "left").withColumn("is_grid", F.coalesce(flat | upright | long, F.lit(False))).drop("xs", "ys", "mean_w", "mean_h")


def cell_exports(e: DataFrame, cells: DataFrame) -> DataFrame:
    """What a cell exports of each entity that meets it: block, primitive, too_large or not_local.
    Blocks must leave 5 per cent and overlap by a quarter, others by 0.6, or have their centre inside."""
    pairs = box_join(e.select("sheet_id", "handle", "kind", *BOX), cells, 0.0, 256.0)
    a, b = B.box("a_"), B.box("b_")
    block = F.col("a_kind") == "BlockReference"
    large = block & ((a.width > b.width * 0.95) | (a.height > b.height * 0.95))
    share = F.when(a.area > 0, B.intersection_area(a, b) / a.area).otherwise(0.0)
    local = B.contains_point(b, a.center_x, a.center_y) | (share >= F.when(block, 0.25).otherwise(0.60))
    verdict = F.when(large, "too_large").when(~local, "not_local").when(block, "block").otherwise("primitive")
    return pairs.select("sheet_id", F.col("a_handle").alias("handle"), F.col("b_row").alias("row"), F.col("b_col").alias("col"), verdict.alias("verdict"))


def block_attachments(blocks: DataFrame, others: DataFrame, reach: float) -> DataFrame:
    """For each entity whose centre lies in a block's widened box, the block of nearest centre."""
    b = B.box()
    p = others.select("sheet_id", "handle", b.center_x.alias("min_x"), b.center_y.alias("min_y"), b.center_x.alias("max_x"), b.center_y.alias("max_y"))
    pairs = box_join(p, blocks.select("sheet_id", "handle", *BOX), reach, 256.0)
    o = B.box("b_")
    d2 = F.pow(F.col("a_min_x") - o.center_x, 2) + F.pow(F.col("a_min_y") - o.center_y, 2)
    best = best_per(pairs.withColumn("_d", d2), ["sheet_id", "a_handle"], [F.col("_d"), F.col("b_handle")])
    return best.select("sheet_id", F.col("a_handle").alias("handle"), F.col("b_handle").alias("block"))


def outline_distance(points: DataFrame, outlines: DataFrame, within: float) -> DataFrame:
    """For each point (px, py) the nearest closed outline (array of vertices) within the
    distance, by the nearest place on any of its sides: handle, outline, distance."""
    p = points.select("sheet_id", "handle", F.col("px").alias("min_x"), F.col("py").alias("min_y"), F.col("px").alias("max_x"), F.col("py").alias("max_y"))
    pairs = box_join(p, outlines.select("sheet_id", "handle", *BOX, "vertices"), within, 256.0)
    v, x, y = F.col("b_vertices"), F.col("a_min_x"), F.col("a_min_y")

    def side(i: Column) -> Column:
        q, w = F.get(v, i), F.get(v, (i + 1) % F.size(v))
        dx, dy = w["x"] - q["x"], w["y"] - q["y"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, B.clamp01(((x - q["x"]) * dx + (y - q["y"]) * dy) / long)).otherwise(0.0)
        return F.sqrt(F.pow(q["x"] + t * dx - x, 2) + F.pow(q["y"] + t * dy - y, 2))

    near = F.array_min(F.transform(F.sequence(F.lit(0), F.size(v) - 1), side))
    ok = pairs.withColumn("distance", near).filter(F.col("distance") < within)
    best = best_per(ok, ["sheet_id", "a_handle"], [F.col("distance"), F.col("b_handle")])
    return best.select("sheet_id", F.col("a_handle").alias("handle"), F.col("b_handle").alias("outline"), "distance")


# --- loose texts and badges -----------------------------------------------------------------------


def is_badge_text(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[\p{L}\p{Nd}]{1,4}$"), F.lit(False))


def is_badge_shape(kind: Column) -> Column:
    b = B.box()
    return K.is_geometry(kind) & (b.width <= 60) & (b.height <= 35) & (b.area <= 2000)


PAIRED = "sheet_id BIGINT, badge BIGINT, text BIGINT, score DOUBLE"


def badge_candidates(shapes: DataFrame, texts: DataFrame) -> DataFrame:
    """Shapes and short texts that are close: in the widened box, within 12, or near the centre."""
    keep = ("sheet_id", "handle", *BOX, "ax", "ay")
    a, b = B.box("a_"), B.box("b_")
    pairs = box_join(shapes.select(*keep), texts.select(*keep), 90.0, 128.0)  # 1.5 times the longest side
    away = B.point_distance(F.col("b_ax"), F.col("b_ay"), a.center_x, a.center_y)
    gap = B.box_distance(a, b)
    close = B.contains_point(B.inflated(a, 10.0), F.col("b_ax"), F.col("b_ay")) | (gap <= 12.0) | (away <= F.greatest(F.lit(18.0), F.greatest(a.width, a.height) * 1.5))
    return pairs.filter(close).select("sheet_id", F.col("a_handle").alias("badge"), F.col("b_handle").alias("text"), F.round(away + gap * 0.5, 9).alias("score"))


def badge_pairs(candidates: DataFrame) -> DataFrame:
    """Each badge, in the order of handles, takes the nearest text that is left. Taking turns
    is sequential, so the few close pairs of a sheet meet in one task."""

    def take(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for badge, group in rows.sort_values(["badge", "score", "text"]).groupby("badge", sort=True):
            free = group[~group["text"].isin(used)]
            if len(free):
                used.add(free["text"].iloc[0])
                out.append((key[0], badge, free["text"].iloc[0], free["score"].iloc[0]))
        return pd.DataFrame(out, columns=["sheet_id", "badge", "text", "score"])

    return candidates.groupBy("sheet_id").applyInPandas(take, PAIRED)


def annotation_texts(texts: DataFrame, units: DataFrame, within: float = 20.0) -> DataFrame:
    """Loose texts with the annotation unit of least score (distance to its box and 0.2 of that
    to its point), if at most `within`. units: sheet_id, unit_id, box, ux, uy."""
    p = texts.select("sheet_id", "handle", F.col("ax").alias("min_x"), F.col("ay").alias("min_y"), F.col("ax").alias("max_x"), F.col("ay").alias("max_y"))
    pairs = box_join(p, units.select("sheet_id", "unit_id", *BOX, "ux", "uy"), within, 128.0)
    score = F.round(B.box_distance(B.box("a_"), B.box("b_")) + B.point_distance(F.col("a_min_x"), F.col("a_min_y"), F.col("b_ux"), F.col("b_uy")) * 0.2, 9)
    best = best_per(pairs.withColumn("score", score).filter(F.col("score") <= within), ["sheet_id", "a_handle"], [F.col("score"), F.col("b_unit_id")])
    return best.select("sheet_id", F.col("a_handle").alias("handle"), F.col("b_unit_id").alias("unit_id"), "score")


def loose_fate(texts: DataFrame, noted: DataFrame, badged: DataFrame) -> DataFrame:
    """Where each loose text goes: annotation, badge, quantity-note or free-note, in this order."""
    x = texts.join(noted.select("sheet_id", "handle", F.lit(True).alias("_noted")), ["sheet_id", "handle"], "left")
    x = x.join(badged.select("sheet_id", F.col("text").alias("handle"), F.lit(True).alias("_badged")), ["sheet_id", "handle"], "left")
    fate = F.when(F.col("_noted"), "annotation").when(F.col("_badged"), "badge").when(F.coalesce(P.is_quantity_note(F.col("text")), F.lit(False)), "quantity-note").otherwise("free-note")
    return x.select("sheet_id", "handle", fate.alias("fate"))
