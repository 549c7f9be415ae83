"""Block instances in world space: nested inserts with rotation, scale and translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions.boxes import Box
from drawlake.storage import written

#: A map of the plane as six columns: x' = a x + b y + tx, y' = c x + d y + ty.
MATRIX = ("a", "b", "c", "d", "tx", "ty")


def insert_matrix(x: Column, y: Column, degrees: Column, scale_x: Column, scale_y: Column) -> list[Column]:
    """Scale, then turn, then shift."""
    t = F.radians(degrees)
    values = (F.cos(t) * scale_x, -F.sin(t) * scale_y, F.sin(t) * scale_x, F.cos(t) * scale_y, x, y)
    return [v.cast("double").alias(n) for v, n in zip(values, MATRIX, strict=True)]


def chained(outer: str, inner: str) -> list[Column]:
    """The inner map first, then the outer one."""
    o, i = ({n: F.col(p + n) for n in MATRIX} for p in (outer, inner))
    values = (
        o["a"] * i["a"] + o["b"] * i["c"], o["a"] * i["b"] + o["b"] * i["d"], o["c"] * i["a"] + o["d"] * i["c"], o["c"] * i["b"] + o["d"] * i["d"],
        o["a"] * i["tx"] + o["b"] * i["ty"] + o["tx"], o["c"] * i["tx"] + o["d"] * i["ty"] + o["ty"],
    )
    return [v.alias(n) for v, n in zip(values, MATRIX, strict=True)]


def world_box(box: Box, prefix: str = "") -> Box:
    """The box of the four mapped corners."""
    m = {n: F.col(prefix + n) for n in MATRIX}
    corners = [(x, y) for x in (box.min_x, box.max_x) for y in (box.min_y, box.max_y)]
    xs, ys = [m["a"] * x + m["b"] * y + m["tx"] for x, y in corners], [m["c"] * x + m["d"] * y + m["ty"] for x, y in corners]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def expand_inserts(roots: DataFrame, inserts: DataFrame, most_depth: int = 32, inner_last: bool = False) -> DataFrame:
    """Every instance of a block: sheet_id, node, handle (of the insert), path and handles
    (blocks and inserts from the sheet down), depth and its map to world space.

    roots: sheet_id, child, handle and a map; inserts: parent, child, handle and a map. A block
    on its own path is not entered again. An insert's map is applied before those of what holds it;
    inner_last: after them, as scans that multiply from the other side do. Nesting deeper than most_depth is an error. A level
    is one join, written to the shared folder; its rows are the instances of that depth.
    """
    level = roots.select("sheet_id", F.col("child").alias("node"), "handle", F.array("child").alias("path"), F.array("handle").alias("handles"), F.lit(0).alias("depth"), *MATRIX)
    step = inserts.select("parent", "child", F.col("handle").alias("i_handle"), *[F.col(n).alias(f"i_{n}") for n in MATRIX])
    out = level
    for depth in range(1, most_depth + 2):
        outer = level.select("sheet_id", "node", "path", "handles", *[F.col(n).alias(f"o_{n}") for n in MATRIX])
        below = outer.join(step, F.col("node") == F.col("parent")).filter(~F.array_contains("path", F.col("child")))
        level = below.select(
            "sheet_id", F.col("child").alias("node"), F.col("i_handle").alias("handle"), F.array_append("path", F.col("child")).alias("path"),
            F.array_append("handles", F.col("i_handle")).alias("handles"), F.lit(depth).alias("depth"), *(chained("i_", "o_") if inner_last else chained("o_", "i_")),
        )
        level = written(level, "block-level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"blocks are nested deeper than {most_depth}")


def block_entities(instances: DataFrame, leaves: DataFrame, attributes: DataFrame) -> DataFrame:
    """World-space rows of all instances: a container for each, its attributes and its leaves.

    leaves: node, handle, kind, box in the block's space. attributes: insert (its handle),
    handle, box in the space of what holds the insert. Returns sheet_id, source (Container,
    Attribute, Leaf), kind, handle, path (blocks joined by >), handles, depth and box; the box
    of a container holds all that is in it, and is null if nothing is.
    """
    local = Box(*[F.col(f"l_{c}") for c in Box._fields])
    inside = leaves.select(F.col("node").alias("l_node"), F.col("handle").alias("l_handle"), "kind", *[F.col(c).alias(f"l_{c}") for c in Box._fields])
    path = F.array_join(F.col("path").cast("array<string>"), ">").alias("path")
    boxed = lambda b: [v.alias(c) for v, c in zip(b, Box._fields, strict=True)]
    leaf = instances.join(inside, F.col("node") == F.col("l_node")).select(
        "sheet_id", F.lit("Leaf").alias("source"), "kind", F.col("l_handle").alias("handle"), path, "handles", (F.col("depth") + 1).alias("depth"), *boxed(world_box(local))
    )
    # Attributes lie in the space around the insert, whose map is that of the instance above.
    above = instances.select("sheet_id", F.col("handles").alias("up"), *[F.col(n).alias(f"u_{n}") for n in MATRIX])
    held = instances.select("sheet_id", "handle", "path", "handles", "depth").withColumn("up", F.slice("handles", F.lit(1), F.size("handles") - 1))
    held = held.join(above, ["sheet_id", "up"], "left")
    for n, same in zip(MATRIX, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), strict=True):
        held = held.withColumn(f"u_{n}", F.coalesce(f"u_{n}", F.lit(same)))
    marks = attributes.select(F.col("insert").alias("l_insert"), F.col("handle").alias("l_handle"), *[F.col(c).alias(f"l_{c}") for c in Box._fields])
    attribute = held.join(marks, F.col("handle") == F.col("l_insert")).select(
        "sheet_id", F.lit("Attribute").alias("source"), F.lit("InsertAttribute").alias("kind"), F.col("l_handle").alias("handle"), path, "handles", (F.col("depth") + 1).alias("depth"), *boxed(world_box(local, "u_"))
    )
    # A container's box: each leaf counts for all inserts above it.
    ups = leaf.withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size("handles")), lambda n: F.slice("handles", F.lit(1), n))))
    spans = ups.groupBy("sheet_id", F.col("up").alias("handles")).agg(*[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in Box._fields])
    container = instances.select("sheet_id", "handle", path, "handles", "depth").join(spans, ["sheet_id", "handles"], "left").select(
        "sheet_id", F.lit("Container").alias("source"), F.lit("BlockReference").alias("kind"), "handle", "path", "handles", "depth", *Box._fields
    )
    return container.unionByName(attribute).unionByName(leaf)


def curve_axes(p: Column, q: Column, r: Column, s: Column) -> tuple[Column, Column, Column, Column]:
    """The map [[p, q], [r, s]] of the unit circle as turn, stretch along the axes, turn: radius
    of the long axis, of the short one (below 0 for maps that mirror), angle of the long axis,
    and the turn before the stretch."""
    e, f, g, h = (p + s) * 0.5, (p - s) * 0.5, (r + q) * 0.5, (r - q) * 0.5
    even, odd = F.sqrt(e * e + h * h), F.sqrt(f * f + g * g)
    a, b = F.atan2(g, f), F.atan2(h, e)
    return even + odd, even - odd, (b + a) * 0.5, (b - a) * 0.5


def mapped_primitives(instances: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaves of all instances with their parameters in world space.

    leaves: node, handle, kind, text, ends (sx, sy, ex, ey), centre (cx, cy), radius (the long
    one of ellipses), ratio, rotation (of ellipses and texts, in degrees), start_deg, end_deg and
    height (of texts). Circles and arcs that a map stretches become ellipses, whose angles are
    those of their parameter from the long axis; mirrored arcs swap their angles; a text's
    height follows the map across its direction. Returns sheet_id, kind, handle, path, depth, the
    parameters and mirrored. What a kind lacks stays null, and so does what depends on a null.
    """
    c = F.col
    inner = leaves.select(F.col("node").alias("l_node"), *[c for c in leaves.columns if c != "node"])
    x = instances.select("sheet_id", "node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.col("depth") + 1, *MATRIX).toDF("sheet_id", "node", "path", "depth", *[f"m_{n}" for n in MATRIX])
    x = x.join(inner, F.col("node") == F.col("l_node"))
    at = lambda u, v: (c("m_a") * u + c("m_b") * v + c("m_tx"), c("m_c") * u + c("m_d") * v + c("m_ty"))
    curve, text = c("kind").isin("Circle", "Arc", "Ellipse"), c("kind").isin("Text", "MText", "InsertAttribute")
    # What makes the curve of the unit circle: its own radii and turn, then the map.
    t = F.radians(F.when(c("kind") == "Ellipse", F.coalesce("rotation", F.lit(0.0))).otherwise(0.0))
    a, b = c("radius"), F.when(c("kind") == "Ellipse", c("radius") * c("ratio")).otherwise(c("radius"))
    x = x.withColumns({
        "_p": (c("m_a") * F.cos(t) + c("m_b") * F.sin(t)) * a, "_q": (c("m_b") * F.cos(t) - c("m_a") * F.sin(t)) * b,
        "_r": (c("m_c") * F.cos(t) + c("m_d") * F.sin(t)) * a, "_s": (c("m_d") * F.cos(t) - c("m_c") * F.sin(t)) * b,
        "_det": c("m_a") * c("m_d") - c("m_b") * c("m_c"),
    })
    for name, value in zip(("_long", "_short", "_angle", "_turn"), curve_axes(c("_p"), c("_q"), c("_r"), c("_s")), strict=True):
        x = x.withColumn(name, value)
    even = c("_long") - F.abs("_short") <= 1e-9 * c("_long")
    # Angles of an ellipse count from its long axis, which points up or along x.
    axis = F.pmod(F.round(F.degrees("_angle"), 7), F.lit(360.0))
    flip = F.when(axis >= 180.0, 180.0).otherwise(0.0)
    own = lambda deg: F.degrees("_turn") + deg
    base = F.when(even, F.degrees("_angle")).otherwise(-flip)
    first, last = F.when(c("_det") < 0, -own(c("end_deg"))).otherwise(own(c("start_deg"))), F.when(c("_det") < 0, -own(c("start_deg"))).otherwise(own(c("end_deg")))
    turned = lambda v: F.round(F.pmod(F.round(v, 6), F.lit(360.0)), 6) + 0.0
    way = F.radians("rotation")
    wx, wy = c("m_a") * F.cos(way) + c("m_b") * F.sin(way), c("m_c") * F.cos(way) + c("m_d") * F.sin(way)
    (sx, sy), (ex, ey), (cx, cy) = at(c("sx"), c("sy")), at(c("ex"), c("ey")), at(c("cx"), c("cy"))
    return x.select(
        "sheet_id", F.when(c("kind").isin("Circle", "Arc") & ~even, "Ellipse").otherwise(c("kind")).alias("kind"), "handle", "path", "depth", "text",
        sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey"), cx.alias("cx"), cy.alias("cy"),
        F.when(curve, c("_long")).alias("radius"), F.when(curve & ~even, F.abs("_short") / c("_long")).alias("ratio"),
        F.when(curve & ~even, turned(axis - flip)).when(text, turned(F.degrees(F.atan2(wy, wx)))).alias("rotation"),
        F.when(c("kind") == "Arc", turned(base + first)).alias("start_deg"), F.when(c("kind") == "Arc", turned(base + last)).alias("end_deg"),
        F.when(text, c("height") * F.abs("_det") / F.sqrt(wx * wx + wy * wy)).alias("height"), (c("_det") < 0).alias("mirrored"),
    )
