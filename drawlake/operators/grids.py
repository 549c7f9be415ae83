"""Proximity clusters and visual blocks, grid islands, frames on grids, strokes on cells, loops in loops."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.operators.spatial import best_per, box_join, box_of, connected

BOX = ("min_x", "min_y", "max_x", "max_y")
OUTLINES = ("Line", "Polyline", "Arc", "Circle", "Ellipse", "Spline")


def proximity_clusters(e: DataFrame, eps: Column | float, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Components of boxes within eps whose centres lie in the same or neighbouring cells of
    that size: adds component. eps may be a column of the sheet; `eps` then is its name's value
    in every row. Rows of different keys are never near."""
    b = B.box()
    size = F.col("_eps")
    rows = e.withColumn("_eps", F.lit(eps) if isinstance(eps, (int, float)) else eps)
    cell = rows.select(*keys, "handle", *BOX, "_eps", F.floor(b.center_x / size).alias("cx"), F.floor(b.center_y / size).alias("cy"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    near = cell.withColumn("s", F.explode(steps)).select(*keys, (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), F.col("handle").alias("a"), "_eps", *[F.col(c).alias(f"a_{c}") for c in BOX])
    other = cell.select(*keys, "cx", "cy", F.col("handle").alias("b"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    edges = near.join(other, [*keys, "cx", "cy"]).filter((F.col("a") < F.col("b")) & (B.box_distance(B.box("a_"), B.box("b_")) <= F.col("_eps"))).select(*keys, "a", "b")
    return connected(rows.drop("_eps"), edges, keys)


def group_label(kind: Column) -> Column:
    """The label of a group by what most of its members are, as an aggregate."""
    outline, text, bridge = F.count_if(kind.isin(*OUTLINES)), F.count_if(kind.isin("Text", "MText")), F.count_if(K.is_dimension(kind))
    return (
        F.when((outline >= F.greatest(text, bridge)) & (outline >= 3), "OUTLINE_GROUP").when((text >= F.greatest(outline, bridge)) & (text >= 2), "TEXT_GROUP")
        .when((bridge >= F.greatest(outline, text)) & (bridge >= 2), "DIM_GROUP").otherwise("MIXED_GROUP")
    )


def visual_blocks(e: DataFrame, eps: float, least: int = 3, least_share: float = 0.001, inner: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """Blocks of outlines that are near, with at least `least` members and that share of the
    drawing, and their members with the group inside the block, clustered at a part of eps:
    (sheet_id, block, box, n), (sheet_id, handle, block, part)."""
    outlines = e.filter(F.col("kind").isin(*OUTLINES))
    found = proximity_clusters(outlines, eps).withColumnRenamed("component", "block")
    area = box_of(e, "sheet_id").select("sheet_id", B.box().area.alias("_whole"))
    blocks = box_of(found, "sheet_id", "block").filter(F.col("n") >= least).join(area, "sheet_id").filter(B.box().area >= F.col("_whole") * least_share).drop("_whole")
    members = found.join(blocks.select("sheet_id", "block"), ["sheet_id", "block"], "left_semi")
    # Inner groups never leave their block, as nearer boxes are near too.
    parts = proximity_clusters(members, eps * inner).select("sheet_id", "handle", "kind", "block", F.col("component").alias("part"))
    return blocks, parts


GROUPED = "sheet_id BIGINT, handle BIGINT, group_id BIGINT"


def sequential_groups(rows: list[tuple], dividers: list[tuple], within: float = 300.0) -> list[int]:
    """Numbers of the groups that dimensions (box) join one after the other: the group with the
    nearest centre, unless it is farther than `within` or an upright line (x, low, high) stands
    between the two centres; a group's box grows as it takes members."""
    groups: list[list[float]] = []
    out = []
    middle = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    for box in rows:
        x, y = middle(box)
        near = [(((x - gx) ** 2 + (y - gy) ** 2) ** 0.5, k) for k, (gx, gy) in enumerate(map(middle, groups))]
        near = min((p for p in near if p[0] < within), default=None)
        if near is not None:
            gx, gy = middle(groups[near[1]])
            if any(min(x, gx) < lx < max(x, gx) and low <= max(y, gy) and high >= min(y, gy) for lx, low, high in dividers):
                near = None
        if near is None:
            groups.append(list(box))
            out.append(len(groups) - 1)
        else:
            g = groups[near[1]]
            g[:] = min(g[0], box[0]), min(g[1], box[1]), max(g[2], box[2]), max(g[3], box[3])
            out.append(near[1])
    return out


def dimension_groups(e: DataFrame, within: float = 300.0, divider: float = 100.0) -> DataFrame:
    """Dimensions of each sheet in groups that grow one by one in the order of handles: sheet_id,
    handle, group_id (first member). The order is the definition, so a sheet's dimensions and
    its long upright lines meet in one task."""
    keep = e.filter("kind = 'Dimension' OR (kind = 'Line' AND max_x - min_x <= 2 AND max_y - min_y >= %f)" % divider).select("sheet_id", "handle", "kind", *BOX)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dims = rows[rows["kind"] == "Dimension"].sort_values("handle")
        lines = rows[rows["kind"] == "Line"]
        cuts = [((a + c) / 2, b, d) for a, b, c, d in lines[list(BOX)].itertuples(index=False)]
        number = sequential_groups(list(dims[list(BOX)].itertuples(index=False, name=None)), cuts, within)
        first: dict[int, int] = {}
        handles = dims["handle"].tolist()
        out = [(key[0], h, first.setdefault(n, h)) for h, n in zip(handles, number, strict=True)]
        return pd.DataFrame(out, columns=["sheet_id", "handle", "group_id"])

    return keep.groupBy("sheet_id").applyInPandas(run, GROUPED)


# --- cells ----------------------------------------------------------------------------------------


def point_islands(points: DataFrame, parts: int = 300) -> DataFrame:
    """Distinct cells of points (x, y) on a grid of the range over `parts`, in islands of cells
    that touch on a side or a corner: sheet_id, cx, cy, island (the smallest cell number)."""
    span = points.groupBy("sheet_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    size = F.when(F.col("span") > 0, F.col("span") / parts).otherwise(1.0)
    at = lambda v, low: F.floor(F.round((F.col(v) - F.col(low)) / size, 9))
    cells = points.join(span, "sheet_id").select("sheet_id", at("x", "x0").alias("cx"), at("y", "y0").alias("cy")).distinct()
    nodes = cells.withColumn("handle", F.col("cy") * (parts + 1) + F.col("cx"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1))]))
    moved = nodes.select("*", steps.alias("s")).select("sheet_id", F.col("handle").alias("a"), (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    edges = moved.join(nodes.withColumnRenamed("handle", "b"), ["sheet_id", "cx", "cy"]).select("sheet_id", "a", "b")
    return connected(nodes, edges).select("sheet_id", "cx", "cy", F.col("component").alias("island"))


def frame_islands(islands: DataFrame, rows: int = 20, cols: int = 30) -> DataFrame:
    """Adds is_frame to islands of cells (sheet_id, row, col, island): those that touch the
    border strongly and are a thin band along it or a ring around the sheet."""
    edge = (F.col("row") == 0) | (F.col("row") == rows - 1) | (F.col("col") == 0) | (F.col("col") == cols - 1)
    g = islands.groupBy("sheet_id", "island").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(edge).alias("touch"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")
    )
    wide = (F.col("c0") == 0) & (F.col("c1") == cols - 1) & (F.col("r1") - F.col("r0") + 1 <= max(2, rows // 12))
    high = (F.col("r0") == 0) & (F.col("r1") == rows - 1) & (F.col("c1") - F.col("c0") + 1 <= max(2, cols // 12))
    ring = (F.col("r0") == 0) & (F.col("r1") == rows - 1) & (F.col("c0") == 0) & (F.col("c1") == cols - 1) & (F.col("n") <= max(12, (rows + cols) * 2))
    strong = (F.col("touch") > 0) & (F.col("touch") >= F.greatest(F.lit(6.0), F.col("n") * 0.35))
    return islands.join(g.select("sheet_id", "island", (strong & (wide | high | ring)).alias("is_frame")), ["sheet_id", "island"])


def stroke_cells(strokes: DataFrame, size: Column | float) -> DataFrame:
    """Every cell of a square grid that a stroke (sx, sy, ex, ey) passes: the cells between its
    crossings with grid lines, and where it passes a corner also the cell beside it in the
    direction of x. Adds cx and cy."""
    s = F.lit(size) if isinstance(size, (int, float)) else size
    x0, y0, x1, y1 = (F.col(c) / s for c in ("sx", "sy", "ex", "ey"))

    def crossings(a: Column, b: Column) -> Column:
        """Places along the stroke, from 0 to 1, where it meets whole numbers."""
        low, high = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
        return F.when((a != b) & (low <= high), F.transform(F.sequence(low, high), lambda k: F.round((k - a) / (b - a), 12))).otherwise(F.array().cast("array<double>"))

    tx, ty = crossings(x0, x1), crossings(y0, y1)
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), tx, ty)))
    rows = strokes.withColumn("_t", ts).withColumn("_both", F.array_intersect(tx, ty)).withColumn("_x0", x0).withColumn("_y0", y0).withColumn("_dx", x1 - x0).withColumn("_dy", y1 - y0)
    t = F.col("_t")
    at = lambda u, v: F.struct(F.floor(F.col("_x0") + F.col("_dx") * u).alias("cx"), F.floor(F.col("_y0") + F.col("_dy") * v).alias("cy"))
    between = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: at((F.get(t, i - 1) + F.get(t, i)) * 0.5, (F.get(t, i - 1) + F.get(t, i)) * 0.5))
    # At an inner corner the step along x comes first, so the cell beside is ahead in x and behind in y.
    corners = F.transform(F.filter("_both", lambda u: (u > 0) & (u < 1)), lambda u: at(u + 1e-7, u - 1e-7))
    cells = F.explode(F.array_distinct(F.concat(between, corners)))
    return rows.select(*strokes.columns, cells.alias("_c")).select(*strokes.columns, "_c.cx", "_c.cy")


#: Where a cell is tested, in quarters of its sides: corners, middle and points of its
#: edges; and how far a point may lie from the arc, in cells.
CELL_TESTS = tuple((i, j) for i in range(5) for j in range(5) if i in (0, 4) or j in (0, 4) or i == j == 2)
CELL_NEAR = 0.35


def arc_cells(arcs: DataFrame, size: float) -> DataFrame:
    """Every cell of a square grid that an arc passes: one that holds an end of it, or of whose
    test points one lies near the circle at an angle of the arc. arcs: cx, cy, radius, start_deg,
    end_deg; from start counter-clockwise to end, equal angles are a full turn. Arcs with a null or
    without a radius have no cells. Adds col and row.

    Only the cells along the circle are looked at: for each column those rows where the ring of
    width CELL_NEAR crosses it, so work grows with the arc's length and not with its area."""
    c = F.col
    start = F.radians(F.pmod("start_deg", F.lit(360.0)))
    turn = F.radians(F.pmod(c("end_deg") - c("start_deg"), F.lit(360.0)))
    rows = arcs.filter((c("radius") > 0) & c("cx").isNotNull() & c("cy").isNotNull() & c("start_deg").isNotNull() & c("end_deg").isNotNull())
    rows = rows.withColumns({"_s": start, "_turn": F.when(turn == 0, 2 * math.pi).otherwise(turn)})
    for name, angle in (("_a", c("_s")), ("_b", c("_s") + c("_turn"))):
        rows = rows.withColumns({f"{name}x": c("cx") + c("radius") * F.cos(angle), f"{name}y": c("cy") + c("radius") * F.sin(angle)})
    rows = rows.withColumns({"_far": c("radius") + CELL_NEAR * size + 1e-6, "_near": c("radius") - CELL_NEAR * size - 1e-6})
    cell = lambda v: F.floor(v / size)
    rows = rows.withColumn("col", F.explode(F.sequence(cell(c("cx") - c("_far")), cell(c("cx") + c("_far")))))
    low, high = c("col") * size - c("cx"), (c("col") + 1) * size - c("cx")
    rows = rows.withColumns({"_m": F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high))), "_k": F.greatest(F.abs(low), F.abs(high))})
    outer = F.sqrt(F.greatest(F.lit(0.0), c("_far") * c("_far") - c("_m") * c("_m")))
    inner = F.when(c("_near") > c("_k"), F.sqrt(c("_near") * c("_near") - c("_k") * c("_k")))
    rows = rows.withColumns({"_out": outer, "_in": inner})
    y = c("cy")
    up, down = F.sequence(cell(y + c("_in")), cell(y + c("_out"))), F.sequence(cell(y - c("_out")), cell(y - c("_in")))
    rows = rows.withColumn("row", F.explode(F.when(c("_in").isNull(), F.sequence(cell(y - c("_out")), cell(y + c("_out")))).otherwise(F.array_union(down, up))))
    x0, y0 = c("col") * size, c("row") * size
    holds = lambda px, py: (px >= x0 - 1e-9) & (px <= x0 + size + 1e-9) & (py >= y0 - 1e-9) & (py <= y0 + size + 1e-9)
    points = F.array(*[F.struct(F.lit(i * 0.25).alias("u"), F.lit(j * 0.25).alias("v")) for i, j in CELL_TESTS])

    def on_arc(p: Column) -> Column:
        dx, dy = x0 + p["u"] * size - c("cx"), y0 + p["v"] * size - c("cy")
        ahead = F.pmod(F.atan2(dy, dx) - c("_s"), F.lit(2 * math.pi))
        return (F.abs(F.sqrt(dx * dx + dy * dy) - c("radius")) <= CELL_NEAR * size) & (F.round(ahead, 9) <= F.round(c("_turn"), 9))

    hit = holds(c("_ax"), c("_ay")) | holds(c("_bx"), c("_by")) | F.exists(points, on_arc)
    return rows.filter(hit).select(*arcs.columns, "col", "row")


# --- loops ----------------------------------------------------------------------------------------


def nested_loops(loops: DataFrame, most: int = 32) -> DataFrame:
    """Parent (the smallest larger loop around a loop's middle), depth and whether a loop is a
    hole (odd depth). loops: sheet_id, loop_id, box; deeper nesting than `most` is an error."""
    a, b = B.box("a_"), B.box("b_")
    x = loops.select("sheet_id", "loop_id", *BOX)
    pairs = box_join(x, x, 0.0, 64.0).filter((F.col("a_loop_id") != F.col("b_loop_id")) & (b.area > a.area) & B.contains_point(b, a.center_x, a.center_y, 1e-9))
    best = best_per(pairs.withColumn("_area", b.area), ["sheet_id", "a_loop_id"], [F.col("_area"), F.col("b_loop_id")])
    parents = best.select("sheet_id", F.col("a_loop_id").alias("loop_id"), F.col("b_loop_id").alias("parent"))
    now = x.select("sheet_id", "loop_id").join(parents, ["sheet_id", "loop_id"], "left").withColumn("up", F.col("parent")).withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1))
    step = parents.select("sheet_id", F.col("loop_id").alias("up"), F.col("parent").alias("_next"))
    for _ in range(most):
        if now.filter("up IS NOT NULL").isEmpty():
            break
        now = now.join(step, ["sheet_id", "up"], "left").select("sheet_id", "loop_id", "parent", F.col("_next").alias("up"), (F.col("depth") + F.when(F.col("_next").isNotNull(), 1).otherwise(0)).alias("depth"))
    else:
        raise ValueError(f"loops are nested deeper than {most}")
    return now.select("sheet_id", "loop_id", "parent", "depth", (F.col("depth") % 2 == 1).alias("is_hole"))


def covered_share(spans: DataFrame, low: float, high: float) -> DataFrame:
    """The share of low to high that a sheet's spans (min_x, max_x) cover together."""
    cut = spans.select("sheet_id", "handle", F.greatest("min_x", F.lit(low)).alias("a"), F.least("max_x", F.lit(high)).alias("b")).filter("b > a")
    reach = F.max("b").over(W.partitionBy("sheet_id").orderBy("a", "handle").rowsBetween(W.unboundedPreceding, -1))
    add = F.greatest(F.lit(0.0), F.col("b") - F.greatest("a", F.coalesce("reach", "a")))
    return cut.withColumn("reach", reach).select("sheet_id", add.alias("add")).groupBy("sheet_id").agg((F.sum("add") / (high - low)).alias("share"))


def sub_clusters(members: DataFrame, unit: str) -> DataFrame:
    """Geometry of each unit in clusters that are connected by a gap of a fifth of its median
    diagonal (1.5 to 8), by widened boxes or near centres, and texts with the nearest cluster
    within three gaps (8 to 30): sheet_id, unit, handle, cluster_id (null for texts that none takes)."""
    b = B.box()
    seeds = members.filter(K.is_geometry(F.col("kind")))
    median = seeds.filter(b.diagonal > 0).groupBy("sheet_id", unit).agg(F.percentile(b.diagonal, 0.5).alias("_m"))
    gap = F.greatest(F.lit(1.5), F.least(F.lit(8.0), F.coalesce("_m", F.lit(0.0)) * 0.20))
    gaps = members.select("sheet_id", unit).distinct().join(median, ["sheet_id", unit], "left").select("sheet_id", unit, gap.alias("gap"))
    x = seeds.join(gaps, ["sheet_id", unit]).select("sheet_id", "handle", unit, "gap", *BOX)
    p, q = B.box("a_"), B.box("b_")
    wide = (B.gap_x(p, q) <= F.col("a_gap")) & (B.gap_y(p, q) <= F.col("a_gap"))
    close = B.point_distance(p.center_x, p.center_y, q.center_x, q.center_y) <= F.col("a_gap")
    edges = box_join(x, x, 8.0, 64.0).filter((F.col("a_handle") < F.col("b_handle")) & (F.col(f"a_{unit}") == F.col(f"b_{unit}")) & (wide | close)).select("sheet_id", F.col("a_handle").alias("a"), F.col("b_handle").alias("b"))
    found = connected(seeds.select("sheet_id", "handle", unit, *BOX), edges).withColumnRenamed("component", "cluster_id")
    boxes = box_of(found, "sheet_id", unit, "cluster_id").join(gaps, ["sheet_id", unit]).drop("n")
    t = members.filter(K.is_text(F.col("kind"))).select("sheet_id", "handle", unit, F.col("ax").alias("min_x"), F.col("ay").alias("min_y"), F.col("ax").alias("max_x"), F.col("ay").alias("max_y"))
    margin = F.greatest(F.lit(8.0), F.least(F.lit(30.0), F.col("b_gap") * 3.0))
    near = box_join(t, boxes, 30.0, 64.0).filter(F.col(f"a_{unit}") == F.col(f"b_{unit}")).withColumn("_d", B.box_distance(p, q)).filter(F.col("_d") <= margin)
    best = best_per(near, ["sheet_id", "a_handle"], [F.col("_d"), F.col("b_cluster_id")]).select("sheet_id", F.col("a_handle").alias("handle"), F.col("b_cluster_id").alias("cluster_id"))
    texts = t.select("sheet_id", unit, "handle").join(best, ["sheet_id", "handle"], "left").select("sheet_id", unit, "handle", "cluster_id")
    return found.select("sheet_id", unit, "handle", "cluster_id").unionByName(texts)


def is_form_line() -> Column:
    """Long thin lines along the border or in the bottom band, and rectangles around the sheet;
    over a row's box and its target's box with the prefix s_."""
    b, s = B.box(), B.box("s_")
    w, h = F.greatest(s.width, F.lit(1e-6)), F.greatest(s.height, F.lit(1e-6))
    mx, my = w * 0.025, h * 0.025
    thin_x, thin_y = b.width / w <= 0.04, b.height / h <= 0.04
    near_side, near_end = (b.min_x <= s.min_x + mx) | (b.max_x >= s.max_x - mx), (b.min_y <= s.min_y + my) | (b.max_y >= s.max_y - my)
    low = b.max_y <= s.min_y + h * 0.22
    close = (F.abs(b.min_x - s.min_x) <= mx) & (F.abs(b.max_x - s.max_x) <= mx) & (F.abs(b.min_y - s.min_y) <= my) & (F.abs(b.max_y - s.max_y) <= my)
    around = (F.col("kind") == "Polyline") & close & (b.width / w >= 0.85) & (b.height / h >= 0.85)
    long = ((b.width / w >= 0.60) & thin_y & near_end) | ((b.height / h >= 0.60) & thin_x & near_side)
    bottom = low & (((b.width / w >= 0.18) & thin_y) | ((b.height / h >= 0.18) & thin_x))
    return K.is_line(F.col("kind")) & (around | long | bottom)
