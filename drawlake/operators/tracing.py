"""Outer contours: edges of strokes, their styles, seeds along the sides of a view, scored links
between ends, greedy walks over the links, and the best loop of each view. Closed chains of
segments with gaps healed, and the holes among them.

Strokes have sheet_id, handle, kind, layer, linetype, color, weight, end points (sx, sy, ex, ey),
vertices (vx, vy), closed, centre (cx, cy), radius, ratio, rotation, angles (start_deg, end_deg)
and a box; any may be null. Views are boxes with sheet_id and view_id. Strokes without what their
kind needs give no edges. Rows that repeat a handle in a view are edges of their own. Empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.operators.spatial import best_per, box_join
from drawlake.storage import joinable, written

BOX = ("min_x", "min_y", "max_x", "max_y")
VIEW = ("sheet_id", "view_id")
STYLE = ("color", "weight", "lt", "lay")


@dataclass(frozen=True)
class ContourOptions:
    """Limits and weights of contours."""

    # Fixed values.
    end_tolerance: float = 2.0
    end_tolerance_ratio: float = 0.015
    band_ratio: float = 0.10
    band: float = 4.0
    edge_length_ratio: float = 0.005
    edge_length: float = 0.5
    loop_perimeter_ratio: float = 0.15
    loop_area_ratio: float = 0.01
    style_score_ratio: float = 0.55
    style_entities: int = 3
    trace_depth: int = 256
    links: int = 8
    # Choices.
    prefer_contour_layers: bool = True
    by_style: bool = True
    try_all: bool = True
    view_edges: int = 1_000_000  # of one view, which a walk holds together; more are an error


def shorter(view: B.Box) -> Column:
    """The shorter side of a view, 1 at least."""
    return F.greatest(F.lit(1.0), F.least(view.width, view.height))


def end_tolerance(view: B.Box, opt: ContourOptions) -> Column:
    return F.greatest(F.lit(opt.end_tolerance), shorter(view) * opt.end_tolerance_ratio)


def any_of(value: Column, words: tuple[str, ...]) -> Column:
    """Whether a value holds one of some plain words: one pattern, where many tests of a long
    expression would outgrow compiled code."""
    return value.rlike("|".join(words))


def with_style(d: DataFrame) -> DataFrame:
    """Adds the style's line type and layer keys (lt, lay), whether it is continuous-like, the
    line type that loosely equal styles share (loose), and whether the layer is a contour's."""
    lt = K.plain(F.col("linetype"))
    smooth = (lt == "") | F.contains(lt, F.lit("CONTINUOUS")) | F.contains(lt, F.lit("BYLAYER"))
    return d.withColumns({
        "lt": lt, "lay": K.plain(F.col("layer")), "smooth": smooth, "loose": F.when(smooth, "").otherwise(lt),
        "contour": any_of(K.plain(F.col("layer")), K.FLAG_CONTOUR),
    })


def view_strokes(d: DataFrame, views: DataFrame) -> DataFrame:
    """Strokes that may be on a contour of a view, a row for each view whose box they meet: of the
    five kinds, neither centre nor hidden lines, not on layers of titles and tables, with a box.
    Adds view_id, the view's box (v_min_x, ...) and the style columns."""
    lay, lt = K.plain(F.col("layer")), K.plain(F.col("linetype"))
    other = any_of(lay, K.FLAG_CENTER + K.FLAG_HIDDEN + K.FLAG_TITLE + K.FLAG_TABLE) | any_of(lt, K.FLAG_CENTER + K.FLAG_HIDDEN)
    able = d.filter(F.col("kind").isin("Line", "Polyline", "Arc", "Circle", "Ellipse") & F.col("min_x").isNotNull() & ~other)
    found = box_join(views.select(*VIEW, *BOX), with_style(able), 0.0, 128.0)
    own = [F.col(f"b_{c}").alias(c) for c in with_style(able).columns if c != "sheet_id"]
    return found.select("sheet_id", F.col("a_view_id").alias("view_id"), *[F.col(f"a_{c}").alias(f"v_{c}") for c in BOX], *own)


# --- edges ----------------------------------------------------------------------------------------


def on_circle(deg: Column) -> tuple[Column, Column]:
    return F.col("cx") + F.col("radius") * F.cos(F.radians(deg)), F.col("cy") + F.col("radius") * F.sin(F.radians(deg))


def sweep(start: Column, end: Column) -> Column:
    """Degrees from start to end, counter-clockwise, from 0 to less than 360."""
    return F.pmod(F.pmod(end, F.lit(360.0)) - F.pmod(start, F.lit(360.0)), F.lit(360.0))


def ellipse_length(a: Column, b: Column) -> Column:
    h = ((a - b) / (a + b)) * ((a - b) / (a + b))
    return F.lit(math.pi) * (a + b) * (1.0 + 3.0 * h / (10.0 + F.sqrt(4.0 - 3.0 * h)))


def stroke_ends() -> tuple[Column, Column, Column, Column]:
    """End points of a line or polyline: its own, or its first and last vertex."""
    several, own = F.coalesce(F.size("vx"), F.lit(0)) >= 2, F.col("sx").isNotNull() & F.col("ex").isNotNull()
    at = lambda c, v, i: F.when(own, F.col(c)).when(several, F.element_at(v, i))
    return at("sx", "vx", 1), at("sy", "vy", 1), at("ex", "vx", -1), at("ey", "vy", -1)


def arc_ends() -> tuple[Column, Column, Column, Column]:
    own = F.col("sx").isNotNull() & F.col("ex").isNotNull()
    (ax, ay), (bx, by) = on_circle(F.col("start_deg")), on_circle(F.col("end_deg"))
    return F.when(own, F.col("sx")).otherwise(ax), F.when(own, F.col("sy")).otherwise(ay), F.when(own, F.col("ex")).otherwise(bx), F.when(own, F.col("ey")).otherwise(by)


def arc_length(ends: tuple[Column, Column, Column, Column]) -> Column:
    turned = F.col("radius") * F.radians(sweep(F.col("start_deg"), F.col("end_deg")))
    return F.coalesce(turned, B.point_distance(*ends))


def contour_edges(strokes: DataFrame, opt: ContourOptions = ContourOptions()) -> DataFrame:
    """Edges of view_strokes: a line, an arc, each side of a polyline, a circle or an ellipse, with
    ends (x0, y0, x1, y1), length, closed (a shape of its own, or the side that closes a polyline)
    and a box. Lines, sides and arcs shorter than the least length of the view are left out.
    edge numbers those of a view by handle and seq."""
    e, v = B.box(), B.box("v_")
    least = F.greatest(F.lit(opt.edge_length), shorter(v) * opt.edge_length_ratio)

    def one(kind: str, ends: tuple[Column, ...], length: Column, closed: Column, own_box: bool) -> Column:
        x0, y0, x1, y1 = ends
        box = (e.min_x, e.min_y, e.max_x, e.max_y) if own_box else (F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
        names = ("x0", "y0", "x1", "y1", "e_min_x", "e_min_y", "e_max_x", "e_max_y")
        return F.struct(F.lit(kind).alias("edge_kind"), *[c.alias(n) for c, n in zip((*ends, *box), names, strict=True)], length.alias("length"), closed.alias("is_closed"))

    n = F.coalesce(F.size("vx"), F.lit(0))
    no, c = F.lit(False), F.col
    line, arc = stroke_ends(), arc_ends()

    def side(i: Column, j: Column, closed: Column) -> Column:
        ends = (F.element_at("vx", i), F.element_at("vy", i), F.element_at("vx", j), F.element_at("vy", j))
        return one("PolylineSegment", ends, B.point_distance(*ends), closed, False)

    sides = F.transform(F.sequence(F.lit(1), n - 1), lambda i: side(i, i + 1, no))
    sides = F.when(c("closed") & (n >= 3), F.concat(sides, F.array(side(n, F.lit(1), F.lit(True))))).otherwise(sides)
    r = F.coalesce("radius", F.least(e.width, e.height) * 0.5)
    a, b = F.coalesce("radius", e.width * 0.5), F.coalesce(c("radius") * c("ratio"), e.height * 0.5)
    mid = F.coalesce("cx", e.center_x), F.coalesce("cy", e.center_y)
    ring = lambda radius: (mid[0] + radius, mid[1], mid[0] + radius, mid[1])
    parts = (
        F.when((c("kind") == "Line") & line[0].isNotNull(), F.array(one("Line", line, B.point_distance(*line), no, False)))
        .when((c("kind") == "Polyline") & (n >= 2), sides)
        .when((c("kind") == "Polyline") & line[0].isNotNull(), F.array(one("PolylineSegment", line, B.point_distance(*line), F.coalesce(c("closed"), no), False)))
        .when((c("kind") == "Arc") & arc[0].isNotNull() & arc[2].isNotNull(), F.array(one("Arc", arc, arc_length(arc), no, True)))
        .when((c("kind") == "Circle") & (r > 0), F.array(one("Circle", ring(r), r * (2.0 * math.pi), F.lit(True), True)))
        .when((c("kind") == "Ellipse") & (a > 0) & (b > 0), F.array(one("Ellipse", ring(a), ellipse_length(a, b), F.lit(True), True)))
    )
    keep = (*VIEW, *[f"v_{x}" for x in BOX], "handle", *STYLE, "smooth", "loose", "contour")
    rows = strokes.withColumn("_least", least).select(*keep, "_least", F.posexplode(parts).alias("seq", "_e")).select(*keep, "seq", "_least", "_e.*")
    rows = rows.filter(F.col("edge_kind").isin("Circle", "Ellipse") | (F.col("length") >= F.col("_least"))).drop("_least")
    return rows.withColumn("edge", F.row_number().over(W.partitionBy(*VIEW).orderBy("handle", "seq", "x0", "y0", "x1", "y1")))


# --- styles ---------------------------------------------------------------------------------------


def style_groups(strokes: DataFrame, opt: ContourOptions = ContourOptions()) -> DataFrame:
    """Styles of each view's strokes: entities, length, touching (meets the view grown by its
    band), contour_like, score and selected: those from a share of the best score with enough
    strokes or one on a contour layer, or the best one if there is none such."""
    c, e, v = F.col, B.box(), B.box("v_")
    ends, arc = stroke_ends(), arc_ends()
    length = F.coalesce(
        F.when(c("kind").isin("Line", "Polyline"), B.point_distance(*ends)).when(c("kind") == "Arc", arc_length(arc))
        .when(c("kind") == "Circle", c("radius") * (2.0 * math.pi)).when(c("kind") == "Ellipse", ellipse_length(c("radius"), c("radius") * c("ratio"))),
        F.greatest(e.width, e.height),
    )
    band = F.greatest(F.lit(opt.band), F.least(v.width, v.height) * opt.band_ratio)
    touching = B.intersects(e, B.inflated(v, band))
    g = strokes.groupBy(*VIEW, *STYLE, "smooth", "loose").agg(
        F.count(F.lit(1)).alias("entities"), F.round(F.sum(length), 6).alias("length"), F.count_if(touching).alias("touching"), F.count_if(c("contour")).alias("contour_like")
    )
    score = c("length") * 3.0 + c("touching") * 600.0 + c("contour_like") * 400.0 + F.when(c("smooth"), 500.0).otherwise(0.0)
    g = g.withColumn("score", F.round(score, 6))
    view = W.partitionBy(*VIEW)
    enough = (c("entities") >= opt.style_entities) | (c("contour_like") > 0)
    g = g.withColumn("_able", (c("score") >= F.max("score").over(view) * opt.style_score_ratio) & enough)
    first = F.row_number().over(view.orderBy(c("score").desc(), *[c(s).asc_nulls_first() for s in STYLE])) == 1
    return g.withColumn("_first", first).withColumn("selected", c("_able") | (c("_first") & ~F.max("_able").over(view))).drop("_able", "_first")


def preferred(strokes: DataFrame, groups: DataFrame) -> DataFrame:
    """Strokes whose style loosely equals a selected one: colour, weight and line type, where
    continuous-like ones are alike."""
    s = groups.filter("selected").select(*[F.col(c).alias(f"_{c}") for c in (*VIEW, "color", "weight", "loose")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*VIEW, "color", "weight", "loose")]
    test = same[0]
    for x in same[1:]:
        test = test & x
    return strokes.join(s, test, "left_semi")


# --- seeds and links ------------------------------------------------------------------------------


def contour_seeds(edges: DataFrame, opt: ContourOptions = ContourOptions()) -> DataFrame:
    """Edges whose box meets a band along a side of the view: edge, side, score (length, 1000 if
    continuous-like, 400 on contour layers, up to 100 for lying close to the side) and place, their
    order in the view. An edge may be a seed of several sides."""
    e, v, c = B.box("e_"), B.box("v_"), F.col
    band = F.greatest(F.lit(opt.band), F.least(v.width, v.height) * opt.band_ratio)
    sides = (
        ("Top", B.Box(v.min_x, v.max_y - band, v.max_x, v.max_y), v.max_y - e.max_y), ("Bottom", B.Box(v.min_x, v.min_y, v.max_x, v.min_y + band), e.min_y - v.min_y),
        ("Left", B.Box(v.min_x, v.min_y, v.min_x + band, v.max_y), e.min_x - v.min_x), ("Right", B.Box(v.max_x - band, v.min_y, v.max_x, v.max_y), v.max_x - e.max_x),
    )
    close = lambda off: F.greatest(F.lit(0.0), 100.0 - F.abs(off))
    hits = F.array_compact(F.array(*[F.when(B.intersects(e, b), F.struct(F.lit(i).alias("rank"), F.lit(n).alias("side"), close(off).alias("close"))) for i, (n, b, off) in enumerate(sides)]))
    base = c("length") + F.when(c("smooth"), 1000.0).otherwise(0.0) + (F.when(c("contour"), 400.0).otherwise(0.0) if opt.prefer_contour_layers else 0.0)
    s = edges.withColumn("_hit", F.explode(hits)).select(*VIEW, "edge", "handle", "seq", "_hit.rank", "_hit.side", F.round(base + c("_hit.close"), 6).alias("score"))
    place = F.row_number().over(W.partitionBy(*VIEW).orderBy(c("score").desc(), "edge", "rank"))
    return s.withColumn("place", place).drop("rank")


def contour_links(edges: DataFrame, opt: ContourOptions = ContourOptions()) -> DataFrame:
    """For each edge (a) the edges (b) with an end within the view's tolerance of one of its own:
    distance, direction (1 where b goes on straight, 0 where it turns back), exact and loose
    equality of style, and score. The best of the four pairs of ends counts; the `links` best
    edges are kept, by falling score, distance and number (place).

    Ends meet by cells of three tolerances, so the join is an equality on view and cell. A pair of
    ends is met once, from the one with the smaller x (from the smaller edge where x is equal), which
    goes to the cells that its tolerance reaches from there: 2.2 on average. All that is told of a
    pair is the same both ways, so it is then read from either end."""
    tol = end_tolerance(B.box("v_"), opt)
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("end"), F.col(x).alias("x"), F.col(y).alias("y"), (F.col(p) - F.col(x)).alias("dx"), (F.col(q) - F.col(y)).alias("dy"))
                               for i, x, y, p, q in ((1, "x0", "y0", "x1", "y1"), (0, "x1", "y1", "x0", "y0"))]))
    p = edges.withColumn("tol", tol).select(*VIEW, "edge", *STYLE, "loose", "tol", ends.alias("p")).select(*VIEW, "edge", *STYLE, "loose", "tol", "p.*")
    cell = lambda v: F.floor(v / (F.col("tol") * 3.0))
    cells = lambda low, high: F.explode(F.when(cell(high) > cell(low), F.array(cell(low), cell(high))).otherwise(F.array(cell(low))))
    rename = lambda rows, s: rows.select(*VIEW, "col", "row", *[F.col(c).alias(f"{s}_{c}") for c in ("edge", "tol", *STYLE, "loose", "end", "x", "y", "dx", "dy")])
    x, y, reach = F.col("x"), F.col("y"), F.col("tol") * 1.001  # a distance above the tolerance may be rounded to it
    a = p.withColumn("col", cells(x, x + reach)).withColumn("row", cells(y - reach, y + reach))
    b = p.withColumns({"col": cell(x), "row": cell(y)})
    pairs = rename(a, "a").hint("merge").join(rename(b, "b").drop("b_tol"), [*VIEW, "col", "row"]).filter("a_edge <> b_edge AND (a_x < b_x OR (a_x = b_x AND a_edge < b_edge))")
    distance = B.point_distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    pairs = pairs.withColumn("distance", distance).filter("distance <= a_tol")
    size = lambda s: F.sqrt(F.col(f"{s}_dx") * F.col(f"{s}_dx") + F.col(f"{s}_dy") * F.col(f"{s}_dy"))
    # b's vector leads to the end that meets a, a's away from it.
    dot = -(F.col("a_dx") * F.col("b_dx") + F.col("a_dy") * F.col("b_dy")) / (size("a") * size("b"))
    direction = F.when((size("a") <= 1e-9) | (size("b") <= 1e-9), 0.0).otherwise((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)) + 1.0) * 0.5)
    same = lambda c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    exact, loose = same("color") & same("weight") & same("lt") & same("lay"), same("color") & same("weight") & same("loose")
    score = F.greatest(F.lit(0.0), 100.0 - F.col("distance") * 10.0) + direction * 50.0 + F.when(exact, 80.0).when(loose, 40.0).otherwise(0.0)
    pairs = pairs.withColumns({"direction": direction, "exact": exact, "loose": loose, "score": F.round(score, 6)})
    ways = F.explode(F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(n) for s, c, n in ((i, "edge", "edge"), (j, "edge", "next"), (i, "end", "end"), (j, "end", "next_end"))]) for i, j in ("ab", "ba")]))
    pairs = pairs.select(*VIEW, "distance", "direction", "exact", "loose", "score", ways.alias("w")).select(*VIEW, "w.*", "distance", "direction", "exact", "loose", "score")
    # Dealt by edge, pairs stay where they are for both choices.
    pairs = best_per(pairs.repartition(*VIEW, "edge"), [*VIEW, "edge", "next"], [F.col("score").desc(), F.col("end"), F.col("next_end").desc()])
    order = W.partitionBy(*VIEW, "edge").orderBy(F.col("score").desc(), F.round("distance", 6), "next")
    kept = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(1, opt.links))
    return kept.select(*VIEW, "edge", "next", "distance", "direction", "exact", "loose", "score", "place")


# --- walks ----------------------------------------------------------------------------------------


def walk(start: int, following: dict[int, list[int]], most: int) -> list[int]:
    """From an edge to the best linked one that has not been taken, until there is none."""
    path, taken = [start], {start}
    while len(path) < most:
        step = next((x for x in following.get(path[-1], ()) if x not in taken), None)
        if step is None:
            break
        path.append(step)
        taken.add(step)
    return path


WALKS = "sheet_id BIGINT, view_id BIGINT, place INT, side STRING, edges ARRAY<INT>"
WALK_TYPES = pa.schema([("sheet_id", pa.int64()), ("view_id", pa.int64()), ("place", pa.int32()), ("side", pa.string()), ("edges", pa.list_(pa.int32()))])


def contour_walks(seeds: DataFrame, links: DataFrame, opt: ContourOptions = ContourOptions()) -> DataFrame:
    """The walk from each seed, in the order of seeds; of walks over the same edges the first.
    Which edge is free depends on all steps before, so a view's links meet in one task, at most
    `view_edges` edges with `links` numbers each. Rows come sorted by view, links before seeds,
    and a task goes through its views one after the other: a call for each would cost more than its walks."""
    following = links.groupBy(*VIEW, "edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "next"))), lambda x: x["next"]).alias("following"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view, then, seen = None, {}, set()
        for batch in batches:
            out = []
            for sheet_id, view_id, place, edge, side, steps in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (sheet_id, view_id) != view:
                    view, then, seen = (sheet_id, view_id), {}, set()
                if place is None:
                    then[edge] = steps
                    if len(then) > opt.view_edges:
                        raise ValueError(f"view {view} has more than {opt.view_edges} edges")
                    continue
                path = walk(edge, then, opt.trace_depth)
                if frozenset(path) not in seen:
                    seen.add(frozenset(path))
                    out.append((sheet_id, view_id, place, side, path))
            yield pa.RecordBatch.from_pylist([dict(zip(WALK_TYPES.names, r, strict=True)) for r in out], schema=WALK_TYPES)

    # Both come from the same edges; new names part their columns.
    s = seeds.select(*VIEW, "place", "edge", "side", F.lit(None).cast("array<int>").alias("following"))
    f = following.select(*VIEW, F.lit(None).cast("int").alias("place"), "edge", F.lit(None).cast("string").alias("side"), "following")
    rows = s.toDF(*s.columns).unionByName(f.toDF(*f.columns)).select(*[F.col(v).cast("bigint").alias(v) for v in VIEW], "place", "edge", "side", "following")
    return rows.repartition(*VIEW).sortWithinPartitions(*VIEW, F.col("place").asc_nulls_first()).mapInArrow(run, WALKS)


def measured_loops(walks: DataFrame, edges: DataFrame, opt: ContourOptions = ContourOptions()) -> DataFrame:
    """Walks as loops: n, perimeter, area of the polygon of the edges' starts, box, closed (an end
    of the last edge lies within the tolerance of one of the first), area_ratio, coverage (of the
    view's box), touching (sides of the view), style_share (of the most frequent style), gap,
    outer_score and valid."""
    at = walks.select(*VIEW, "place", "side", F.posexplode("edges").alias("pos", "edge"))
    x = at.join(edges, [*VIEW, "edge"])
    loop = [*VIEW, "place", "side"]
    style = x.groupBy(*loop, *STYLE).agg(F.count(F.lit(1)).alias("k")).groupBy(*loop).agg(F.max("k").alias("most"))
    point = F.struct("pos", "x0", "y0", "x1", "y1")
    g = x.groupBy(*loop).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 6).alias("perimeter"), F.array_sort(F.collect_list(point)).alias("points"),
        *[F.first(f"v_{c}").alias(f"v_{c}") for c in BOX],
        F.min("e_min_x").alias("min_x"), F.min("e_min_y").alias("min_y"), F.max("e_max_x").alias("max_x"), F.max("e_max_y").alias("max_y"),
    ).join(style, loop)
    b, v, c = B.box(), B.box("v_"), F.col
    nth = lambda i: F.element_at("points", F.pmod(i, c("n")).cast("int") + 1)
    cross = F.aggregate(F.sequence(F.lit(0).cast("bigint"), c("n") - 1), F.lit(0.0), lambda s, i: s + nth(i)["x0"] * nth(i + 1)["y0"] - nth(i + 1)["x0"] * nth(i)["y0"])
    first, last, tol = F.element_at("points", 1), F.element_at("points", -1), end_tolerance(v, opt)
    meets = F.lit(False)
    for p, q in (("x0", "y0"), ("x1", "y1")):
        for s, t in (("x0", "y0"), ("x1", "y1")):
            meets = meets | (B.point_distance(first[p], first[q], last[s], last[t]) <= tol)
    g = g.withColumns({"closed": (c("n") > 1) & meets, "area": F.when(c("n") >= 3, F.abs(cross) * 0.5).otherwise(0.0)})
    off = [F.abs(b.min_x - v.min_x), F.abs(b.max_x - v.max_x), F.abs(b.min_y - v.min_y), F.abs(b.max_y - v.max_y)]
    gap = off[0] + off[1] + off[2] + off[3]
    around = F.greatest(F.lit(1.0), v.width + v.height)
    touching = sum((F.when(o <= tol * 2.0, 1).otherwise(0) for o in off), F.lit(0))
    g = g.withColumns({
        "area_ratio": c("area") / F.greatest(F.lit(1.0), v.area), "coverage": F.greatest(F.lit(0.0), 1.0 - gap / around), "touching": touching,
        "style_share": c("most") / c("n"), "gap": gap, "around": around,
    })
    # Weights of the outer score.
    score = (
        F.when(c("closed"), 1_000_000.0).otherwise(0.0) + c("area_ratio") * 400_000.0 + c("coverage") * 220_000.0 + c("touching") * 120_000.0
        + c("style_share") * 80_000.0 + c("perimeter") * 1.5 - c("gap") / c("around") * 180_000.0
    )
    valid = c("closed") & (c("perimeter") >= shorter(v) * opt.loop_perimeter_ratio) & (c("area") >= F.greatest(F.lit(1.0), v.area * opt.loop_area_ratio)) & (c("touching") >= 2)
    g = g.withColumns({"outer_score": F.round(score, 3), "valid": valid})
    return g.select(*loop, "n", "perimeter", "area", "closed", "area_ratio", "coverage", "touching", "style_share", "gap", "outer_score", "valid", *BOX)


def best_loops(loops: DataFrame) -> DataFrame:
    """The best valid loop of each view."""
    down = [F.round(F.col(c), 6).desc() for c in ("outer_score", "touching", "area_ratio", "coverage", "perimeter")]
    return best_per(loops.filter("valid"), [*VIEW], [*down, F.col("place")])


def traced(strokes: DataFrame, opt: ContourOptions = ContourOptions()) -> tuple[DataFrame, DataFrame]:
    """Walks and loops of view_strokes. Edges and walks are written once, as seeds,
    links and loops read the edges and two groupings the walks."""
    edges = joinable(contour_edges(strokes, opt), "contour-edges")
    walks = joinable(contour_walks(contour_seeds(edges, opt), contour_links(edges, opt), opt), "contour-walks")
    return walks, measured_loops(walks, edges, opt)


def outer_contours(d: DataFrame, views: DataFrame, opt: ContourOptions = ContourOptions()) -> DataFrame:
    """The outer contour of each view: the best loop over strokes of its preferred styles, or over
    all of its strokes where those give none and are fewer (again). Views without any loop give no row."""
    strokes = joinable(view_strokes(d, views), "view-strokes")
    own = preferred(strokes, style_groups(strokes, opt)) if opt.by_style else strokes
    best = joinable(best_loops(traced(own, opt)[1]).withColumn("again", F.lit(False)), "best-loops")  # read twice
    if not (opt.try_all and opt.by_style):
        return best
    rest = strokes.join(best.select(*VIEW), [*VIEW], "left_anti")
    return best.unionByName(best_loops(traced(rest, opt)[1]).withColumn("again", F.lit(True)))


# --- chains ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChainOptions:
    """Limits of closed chains. Fixed values."""

    snap: float = 0.5
    gap: float = 1.0
    closure: float = 1.0
    step_degrees: float = 8.0
    step_length: float = 2.0
    heal: bool = True


def chain_segments(d: DataFrame, opt: ChainOptions = ChainOptions()) -> DataFrame:
    """Straight segments of strokes (sheet_id, handle, kind, seq, x0, y0, x1, y1). Curves are cut by
    length and by angle, whichever asks for more: circles into 12 at least, ellipses into 16, arcs
    into 2. Polylines, splines and filled shapes give their sides. Segments without length are left out."""
    c = F.col
    by = lambda length, degrees: F.greatest(F.ceil(F.round(length / opt.step_length, 9)), F.ceil(F.round(degrees / opt.step_degrees, 9)))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    full = c("cx").isNotNull() & (c("radius") > 0)
    # Turns and numbers of parts are columns of their own: the points of a curve read them again and again.
    rows = d.withColumns({
        "_turn": F.when(c("kind") == "Arc", sweep(c("start_deg"), c("end_deg"))).otherwise(360.0), "_b": c("radius") * c("ratio"),
        "_cos": F.cos(F.radians(F.coalesce("rotation", F.lit(0.0)))), "_sin": F.sin(F.radians(F.coalesce("rotation", F.lit(0.0)))),
    })
    most = (
        F.when((c("kind") == "Circle") & full, F.greatest(F.lit(12).cast("bigint"), by(c("radius") * (2 * math.pi), c("_turn"))))
        .when((c("kind") == "Arc") & full & (c("_turn") > 1e-9), F.greatest(F.lit(2).cast("bigint"), by(c("radius") * F.radians("_turn"), c("_turn"))))
        .when((c("kind") == "Ellipse") & full & (c("_b") > 0), F.greatest(F.lit(16).cast("bigint"), by(ellipse_length(c("radius"), c("_b")), c("_turn"))))
    )
    rows = rows.withColumn("_n", most).withColumn("_at", F.sequence(F.lit(0).cast("bigint"), F.col("_n")))

    def around(i: Column) -> Column:
        """The i-th point of a circle or an ellipse; the last is the first."""
        t = F.radians(F.pmod(i, c("_n")) * 360.0 / c("_n"))
        x, y = c("radius") * F.cos(t), F.when(c("kind") == "Ellipse", c("_b")).otherwise(c("radius")) * F.sin(t)
        return F.when(c("kind") == "Ellipse", point(c("cx") + x * c("_cos") - y * c("_sin"), c("cy") + x * c("_sin") + y * c("_cos"))).otherwise(point(c("cx") + x, c("cy") + y))

    corners = F.transform(F.arrays_zip(F.col("vx").alias("x"), F.col("vy").alias("y")), lambda p: point(p["x"], p["y"]))
    corners = F.when(c("closed") & (F.size("vx") >= 3), F.concat(corners, F.slice(corners, 1, 1))).otherwise(corners)
    points = (
        F.when(c("kind") == "Line", F.when(c("sx").isNotNull() & c("ex").isNotNull(), F.array(point(c("sx"), c("sy")), point(c("ex"), c("ey")))))
        .when(c("kind") == "Arc", F.transform("_at", lambda i: point(*on_circle(c("start_deg") + c("_turn") * i / c("_n")))))
        .when(c("kind").isin("Circle", "Ellipse"), F.transform("_at", around))
        .otherwise(F.when(F.size("vx") >= 2, corners))
    )
    lines = F.zip_with(F.slice("_p", F.lit(1), F.size("_p") - 1), F.slice("_p", F.lit(2), F.size("_p") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumn("_p", points).filter(F.size("_p") >= 2).select("sheet_id", "handle", "kind", F.posexplode(lines).alias("seq", "_s"))
    rows = rows.select("sheet_id", "handle", "kind", "seq", F.col("_s.a.x").alias("x0"), F.col("_s.a.y").alias("y0"), F.col("_s.b.x").alias("x1"), F.col("_s.b.y").alias("y1"))
    square = (c("x1") - c("x0")) * (c("x1") - c("x0")) + (c("y1") - c("y0")) * (c("y1") - c("y0"))
    return rows.filter(square > 1e-12)


def outline_strokes(d: DataFrame) -> DataFrame:
    """Strokes that chains may be made of: shapes that are visible outlines by layer."""
    kind = F.col("kind")
    semantic = K.stroke_semantic(kind, F.col("layer"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return d.filter(K.is_geometry(kind) & semantic.isin("VisibleOutline", "Unknown"))


def chains_of(lines: list[tuple[float, float, float, float]], opt: ChainOptions) -> list[tuple[list[int], list[tuple[float, float]], bool, float]]:
    """Chains of one sheet: ends snap to the first point within the tolerance, and each unused
    segment in order starts a walk over the first unused segment at its end, until it is back or
    there is none. Open chains of three points or more whose ends are near are closed. Returns
    segments, points, closed and the gap that was healed."""
    nodes: list[tuple[float, float]] = []
    cells: dict[tuple[int, int], list[int]] = {}
    snap = max(opt.snap, 1e-9)

    def node(x: float, y: float) -> int:
        cx, cy = math.floor(x / snap), math.floor(y / snap)
        near = (i for dx in (-1, 0, 1) for dy in (-1, 0, 1) for i in cells.get((cx + dx, cy + dy), ()))
        first = min((i for i in near if (nodes[i][0] - x) ** 2 + (nodes[i][1] - y) ** 2 <= snap * snap), default=None)
        if first is None:
            first = len(nodes)
            nodes.append((x, y))
            cells.setdefault((cx, cy), []).append(first)
        return first

    ends = [(node(x0, y0), node(x1, y1)) for x0, y0, x1, y1 in lines]
    at: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(ends):
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    used = [False] * len(ends)
    begun = dict.fromkeys(at, 0)  # segments before this place of a node's list are used
    out = []
    for start, (first, here) in enumerate(ends):
        if used[start]:
            continue
        used[start] = True
        path, points = [start], [nodes[first], nodes[here]]
        while here != first:
            where = at[here]
            while begun[here] < len(where) and used[where[begun[here]]]:
                begun[here] += 1
            if begun[here] == len(where):
                break
            step = where[begun[here]]
            used[step] = True
            here = ends[step][1] if ends[step][0] == here else ends[step][0]
            path.append(step)
            points.append(nodes[here])
        closed, gap = here == first, 0.0
        if not closed and opt.heal and len(points) >= 3:
            gap = math.dist(points[0], points[-1])
            if gap <= max(opt.gap, opt.closure):
                points.append(points[0])
                closed = True
        out.append((path, points, closed, gap if closed else math.dist(points[0], points[-1])))
    return out


CHAINS = "sheet_id BIGINT, chain BIGINT, segments INT, handles ARRAY<BIGINT>, vx ARRAY<DOUBLE>, vy ARRAY<DOUBLE>, closed BOOLEAN, gap DOUBLE, area DOUBLE, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE"


def closed_chains(segments: DataFrame, opt: ChainOptions = ChainOptions()) -> DataFrame:
    """Chains of chain_segments, closed and open ones: chain (from 0, in the order of their first
    segment by handle and seq), segments, handles, points, closed, gap (left, or healed), area (0 of
    open ones) and box. What is used depends on all walks before, so a sheet's segments meet in one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["handle", "seq"], kind="stable")
        handle = rows["handle"].to_numpy()
        out = []
        for i, (path, points, closed, gap) in enumerate(chains_of(list(rows[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)), opt)):
            x, y = np.array(points).T
            area = abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2 if closed and len(points) >= 3 else 0.0
            out.append((int(key[0]), i, len(path), sorted({int(handle[j]) for j in path}), list(x), list(y), closed, gap, area, x.min(), y.min(), x.max(), y.max()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHAINS.split(", ")])

    return segments.groupBy("sheet_id").applyInPandas(run, CHAINS)


def inside(x: Column, y: Column, vx: Column, vy: Column) -> Column:
    """Whether a point lies in a polygon, by the crossings of a ray."""
    n = F.size(vx)

    def crosses(i: Column) -> Column:
        j = F.when(i == 1, n).otherwise(i - 1)
        xi, yi, xj, yj = F.element_at(vx, i), F.element_at(vy, i), F.element_at(vx, j), F.element_at(vy, j)
        return ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / ((yj - yi) + 1e-12) + xi)

    hits = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(crosses(i), 1).otherwise(0))
    return (n >= 3) & (hits % 2 == 1)


def chain_holes(chains: DataFrame, most: int = 32) -> DataFrame:
    """Closed chains with parent (the smallest larger chain around a point inside), depth and
    is_hole (odd depth). The point is the middle of the box if that lies inside, else half-way from
    there to the first corner. Deeper nesting than `most` is an error."""
    b, c = B.box(), F.col
    loops = written(chains.filter("closed AND area > 0"), "closed-chains")
    mid = inside(b.center_x, b.center_y, c("vx"), c("vy"))
    loops = loops.withColumns({"px": F.when(mid, b.center_x).otherwise((b.center_x + c("vx")[0]) * 0.5), "py": F.when(mid, b.center_y).otherwise((b.center_y + c("vy")[0]) * 0.5)})
    p = loops.select("sheet_id", "chain", "area", F.col("px").alias("min_x"), F.col("py").alias("min_y"), F.col("px").alias("max_x"), F.col("py").alias("max_y"))
    pairs = box_join(p, loops.select("sheet_id", "chain", "area", "vx", "vy", *BOX), 1e-9, 64.0).filter((c("a_chain") != c("b_chain")) & (c("b_area") > c("a_area")))
    pairs = pairs.filter(inside(c("a_min_x"), c("a_min_y"), c("b_vx"), c("b_vy")))
    best = best_per(pairs, ["sheet_id", "a_chain"], [c("b_area"), c("b_chain")]).select("sheet_id", F.col("a_chain").alias("chain"), F.col("b_chain").alias("parent"))
    best = written(best, "chain-parents")
    now = loops.select("sheet_id", "chain", "segments", "gap", "area").join(best, ["sheet_id", "chain"], "left").withColumn("up", c("parent")).withColumn("depth", F.when(c("parent").isNull(), 0).otherwise(1))
    step = best.select("sheet_id", c("chain").alias("up"), c("parent").alias("_next"))
    for _ in range(most):
        if now.filter("up IS NOT NULL").isEmpty():
            return now.drop("up").withColumn("is_hole", c("depth") % 2 == 1)
        now = now.join(step, ["sheet_id", "up"], "left").withColumn("depth", c("depth") + F.when(c("_next").isNotNull(), 1).otherwise(0)).withColumn("up", c("_next")).drop("_next")
    raise ValueError(f"chains are nested deeper than {most}")
