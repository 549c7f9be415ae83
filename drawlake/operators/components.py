"""Features and roles of components, statistics and roles of blocks, scores of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.functions import primitives as P
from drawlake.operators.spatial import box_join, box_of, prefixed

BORDER, TITLE_GAP, MARKER, ISOLATION, SYMBOL_ISOLATION, BAND = 20.0, 50.0, 40.0, 30.0, 35.0, 0.12


def concentric(members: DataFrame, *keys: str) -> DataFrame:
    """Groups (sheet_id and further keys) with two circles of nearly one centre and different
    radii. Centres meet by cells, so a group of many circles is no product of all of them."""
    b, c = B.box(), F.col
    at = {"min_x": b.center_x, "min_y": b.center_y, "max_x": b.center_x, "max_y": b.center_y}
    circles = members.filter("kind = 'Circle'").select(*keys, "handle", *[v.alias(n) for n, v in at.items()], (F.least(b.width, b.height) / 2.0).alias("radius"))
    near = B.point_distance(c("a_min_x"), c("a_min_y"), c("b_min_x"), c("b_min_y")) <= 2.0
    own = [k for k in keys if k != "sheet_id"]
    same = F.lit(True)
    for k in own:
        same = same & c(f"a_{k}").eqNullSafe(c(f"b_{k}"))
    pairs = box_join(circles, circles, 2.0, 16.0).filter(same & (c("a_handle") < c("b_handle")) & near & (F.abs(c("a_radius") - c("b_radius")) >= 1.0))
    return pairs.select("sheet_id", *[c(f"a_{k}").alias(k) for k in own]).distinct().withColumn("has_concentric", F.lit(True))


def component_features(members: DataFrame, title_share: float = 0.26) -> DataFrame:
    """Counts, words, place and neighbours of each component: members with sheet_id, comp,
    handle, kind, layer, text, rotation and box. The title area is the lowest share of a sheet."""
    kind, t = F.col("kind"), P.component_text(F.col("text"))
    text = K.is_text(kind) & (F.coalesce(t, F.lit("")) != "")
    up = F.upper(t)
    some = lambda test: F.coalesce(F.bool_or(text & test), F.lit(False))
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    keys = ["sheet_id", "comp"]
    g = members.groupBy(*keys).agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
        F.count_if(K.is_text(kind)).alias("texts"), F.count_if(kind == "Line").alias("lines"), F.count_if(kind == "Circle").alias("circles"), F.count_if(kind == "Polyline").alias("polylines"),
        F.count_if(K.is_dimension(kind)).alias("dimensions"), F.count_if(kind == "Ellipse").alias("ellipses"), F.count_if(K.is_geometry(kind)).alias("geometry"), F.count_if(kind == "Leader").alias("leaders"),
        F.count_if((kind == "Line") & F.contains(F.upper("layer"), F.lit("CENTER"))).alias("center_lines"),
        F.bool_or(kind.isin("Circle", "Ellipse", "Region", "Hatch")).alias("closed_outline"), F.bool_or(P.is_vertical_text(kind, F.col("rotation"), w, h)).alias("vertical_text"),
        some(t.rlike(r"^\s*[\d.\-+()]+\s*$")).alias("numeric_only"), some(K.mentions(up, P.SCALE_WORDS) | t.rlike(r"\b\d+\s*:\s*\d+\b")).alias("scale_word"),
        some(K.mentions(up, P.MATERIAL_WORDS)).alias("material_word"), some(K.mentions(up, P.QUANTITY_WORDS) | t.rlike(r"(?i)\b\d+\s*(EA|PCS|SET)\b")).alias("quantity_word"),
        some(K.mentions(up, P.TITLE_WORDS)).alias("title_word"), some(K.mentions(up, P.CONTROL_WORDS)).alias("control_word"),
    )
    # What lies near a component, from pairs of boxes that share a grid cell.
    box = g.select(*keys, "min_x", "min_y", "max_x", "max_y", "dimensions", "geometry", "leaders")
    a, b = B.box("a_"), B.box("b_")
    pairs = box_join(box, box, SYMBOL_ISOLATION, 128.0).filter("a_comp != b_comp").withColumn("gap", B.box_distance(a, b))
    close = F.col("gap") <= ISOLATION
    near = pairs.groupBy("sheet_id", F.col("a_comp").alias("comp")).agg(
        F.bool_or(close).alias("near_any"), F.bool_or(close & (F.col("b_dimensions") > 0)).alias("near_dimension"), F.bool_or(close & (F.col("b_geometry") > 0)).alias("near_geometry"),
        F.bool_or((F.col("gap") <= SYMBOL_ISOLATION) & (F.col("b_geometry") > 0)).alias("near_core"),
    )
    sheets = prefixed(box_of(members, "sheet_id").drop("n"), "s_")
    x = g.join(near, keys, "left").join(concentric(members, *keys), keys, "left").join(sheets, "sheet_id")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    c, s = B.box(), B.box("s_")
    border = F.least(F.abs(c.min_x - s.min_x), F.abs(s.max_x - c.max_x), F.abs(c.min_y - s.min_y), F.abs(s.max_y - c.max_y))
    title = B.Box(s.min_x, s.min_y, s.max_x, s.min_y + s.height * title_share)
    mx, my = s.width * BAND, s.height * BAND
    x = x.select(
        "*", (border <= BORDER).alias("near_border"), (B.box_distance(c, title) <= TITLE_GAP).alias("near_title"),
        ((c.min_x >= s.min_x + mx) & (c.max_x <= s.max_x - mx) & (c.min_y >= s.min_y + my) & (c.max_y <= s.max_y - my)).alias("central"),
        ((F.col("dimensions") > 0) | no("near_dimension")).alias("by_dimension"), ((F.col("geometry") > 0) | no("near_geometry")).alias("by_geometry"),
        ((c.width <= MARKER) & (c.height <= MARKER) & ~no("near_any")).alias("marker"), no("has_concentric").alias("concentric"),
        ((F.col("lines") + F.col("polylines") >= 3) & (F.col("circles") >= 1)).alias("trapezoid"), no("near_core").alias("_core"),
    )
    return x.select(
        *keys, "min_x", "min_y", "max_x", "max_y", "texts", "lines", "circles", "polylines", "dimensions", "center_lines", "closed_outline", "vertical_text",
        "numeric_only", "scale_word", "material_word", "quantity_word", "title_word", "control_word", "near_border", "near_title", "central", "by_dimension", "by_geometry", "marker", "concentric", "trapezoid",
        ((F.col("near_border") | F.col("marker")) & ~F.col("by_geometry") & ~F.col("by_dimension")).alias("removable"),
        ((F.col("ellipses") > 0) & F.col("numeric_only") & (F.col("marker") | F.col("near_border")) & ~F.col("by_geometry")).alias("ellipse_marker"),
        (F.col("concentric") & (F.col("trapezoid") | (F.col("lines") >= 2) | (F.col("polylines") >= 1)) & (F.col("dimensions") == 0) & ~F.col("_core")).alias("projection_symbol"),
    )


#: Points of each role, in the order in which ties are settled.
ROLE_POINTS = {
    "GeometryCore": {"closed_outline": 25, "by_dimension": 20, "by_geometry": 20, "central": 15, "near_border": -15, "control_word": -30, "projection_symbol": -20},
    "DimensionRelated": {"has_dimension": 35, "by_geometry": 20, "has_number": 10},
    "TitleBlock": {"near_title": 25, "title_word": 25, "meta_word": 15},
    "MetaField": {"scale_word": 25, "material_word": 25, "quantity_word": 25, "near_title": 15},
    "MarginAnnotation": {"near_border": 20, "vertical_text": 20, "control_word": 30, "by_geometry": -20},
    "AuxiliaryMarker": {"ellipse_marker": 35, "numeric_only": 10, "marker": 20, "by_geometry": -20},
    "ProjectionMethodSymbol": {"concentric": 20, "trapezoid": 20, "has_center_line": 10, "projection_symbol": 30},
}


def component_roles(features: DataFrame) -> DataFrame:
    """Adds role, role_score and confidence: the first role of most points, from 20 on."""
    helpers = {
        "has_dimension": F.col("dimensions") > 0, "has_number": (F.col("texts") > 0) & F.col("numeric_only"),
        "meta_word": F.col("scale_word") | F.col("material_word") | F.col("quantity_word"), "has_center_line": F.col("center_lines") > 0,
    }
    points = lambda rules: sum([F.when(F.col(c), n).otherwise(0) for c, n in rules.items()], F.lit(0))
    ranked = F.array(*[F.struct((-points(rules)).alias("less"), F.lit(i).alias("place"), F.lit(role).alias("role")) for i, (role, rules) in enumerate(ROLE_POINTS.items())])
    best = F.array_min(ranked)
    score = -best["less"]
    role = F.when(score < 20, "Unknown").otherwise(best["role"])
    confidence = F.when(score >= 70, "High").when(score >= 40, "Medium").otherwise("Low")
    return features.withColumns(helpers).withColumns({"role": role, "role_score": score, "confidence": confidence}).drop(*helpers)


def block_stats(d: DataFrame, vertices: Column | None = None) -> DataFrame:
    """Counts and line lengths of every block with all that is nested in it: primitives with
    block_path, whose prefixes are the blocks that hold them."""
    parts = F.split("block_path", ">")
    rows = d.filter("block_path IS NOT NULL").withColumn("block", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ">"))))
    kind, corners = F.col("kind"), P.vertices() if vertices is None else vertices
    step = lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))
    ring = F.concat(corners, F.when(F.col("closed"), F.slice(corners, 1, 1)).otherwise(F.slice(corners, 1, 0)))
    around = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), step)
    strokes = F.when(kind == "Line", F.array(F.struct((F.col("ex") - F.col("sx")).alias("dx"), (F.col("ey") - F.col("sy")).alias("dy")))).when(kind == "Polyline", around)
    length = lambda s: F.sqrt(s["dx"] * s["dx"] + s["dy"] * s["dy"])
    flat, upright = lambda s: F.abs(s["dy"]) <= 1e-4, lambda s: F.abs(s["dx"]) <= 1e-4
    sort = lambda s: F.when(length(s) <= 1e-9, "none").when(flat(s), "h").when(upright(s), "v").otherwise("o")
    total = lambda name: F.coalesce(F.aggregate(strokes, F.lit(0.0), lambda acc, s: acc + F.when(sort(s) == name, length(s)).otherwise(0.0)), F.lit(0.0))
    longs = lambda name: F.coalesce(F.size(F.filter(strokes, lambda s: (sort(s) == name) & (length(s) > 100.0))), F.lit(0))
    rows = rows.select("*", *[total(n).alias(f"len_{n}") for n in "hvo"], *[longs(n).alias(f"long_{n}") for n in "hv"])
    return rows.groupBy("sheet_id", "block").agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
        F.count_if(kind == "Line").alias("lines"), F.count_if(kind == "Arc").alias("arcs"), F.count_if(kind == "Circle").alias("circles"), F.count_if(kind == "Polyline").alias("polylines"),
        F.count_if(kind == "Text").alias("db_texts"), F.count_if(kind == "MText").alias("m_texts"), F.count_if(kind == "InsertAttribute").alias("attributes"), F.count_if(kind == "BlockReference").alias("nested"),
        F.sum("len_h").alias("len_h"), F.sum("len_v").alias("len_v"), F.sum("len_o").alias("len_o"), F.sum("long_h").alias("long_h"), F.sum("long_v").alias("long_v"),
        *[F.coalesce(F.bool_or(F.contains(F.upper("text"), F.lit(w))), F.lit(False)).cast("int").alias(f"_w{i}") for i, w in enumerate(P.BLOCK_WORDS)],
    ).withColumn("words", sum([F.col(f"_w{i}") for i in range(len(P.BLOCK_WORDS))], F.lit(0))).drop(*[f"_w{i}" for i in range(len(P.BLOCK_WORDS))])


def block_roles(stats: DataFrame) -> DataFrame:
    """Adds meta, geometry and frame points and the role that leads by at least 10."""
    c = F.col
    texts, geometry = c("db_texts") + c("m_texts") + c("attributes"), c("lines") + c("arcs") + c("circles") + c("polylines")
    rounds, longs = c("arcs") + c("circles"), c("long_h") + c("long_v")
    b = B.box()
    boxed = b.min_x.isNotNull()
    add = lambda rules: sum([F.when(test, n).otherwise(0) for test, n in rules], F.lit(0))
    meta = add([
        (c("db_texts") > 0, 20), (c("m_texts") > 0, 20), (c("attributes") > 0, 20), (texts >= 3, 15), (texts >= 8, 20),
        ((geometry > 0) & (texts > 0) & (texts / F.greatest(geometry, F.lit(1)) >= 0.3), 10), (c("words") > 0, 15 + c("words") * 5),
    ])
    shape = add([
        (geometry >= 10, 20), (geometry >= 30, 20), ((texts == 0) & (geometry > 0), 20), (rounds >= 3, 15), (rounds >= 10, 10),
        ((geometry >= 20) & (texts == 0), 10), (c("len_o") > (c("len_h") + c("len_v")) * 0.3, 10),
    ])
    frame = add([
        ((c("lines") >= 4) | (c("polylines") >= 1), 5), (c("long_h") >= 2, 15), (c("long_v") >= 2, 15), ((c("long_h") >= 2) & (c("long_v") >= 2), 15),
        (boxed & (b.width > 100) & (b.height > 50), 10), ((texts == 0) & (longs >= 4), 10), (rounds >= 3, -10), (rounds >= 10, -10),
        (boxed & (b.width * b.height < 2000), -15), ((geometry >= 40) & (rounds >= 3), -10),
    ])
    x = stats.withColumn("meta", meta).withColumn("geometry", shape).withColumn("frame", F.greatest(frame, F.lit(0)))
    order = F.sort_array(F.array("meta", "geometry", "frame"), False)
    role = (
        F.when(order[0] < 20, "Unknown").when(order[0] - order[1] < 10, "Unknown").when(c("meta") == order[0], "Meta").when(c("geometry") == order[0], "Geometry").otherwise("Frame")
    )
    return x.withColumn("role", role)


#: Words of metadata that count against a geometry unit.
UNIT_WORDS = (
    "TITLE", "DWG", "DRAWING", "DRAWN", "DESIGNED", "APPROVED", "DATE", "SCALE", "MATERIAL", "Q'TY", "QTY", "REMARK", "REMARKS",
    "DESCRIPTION", "SIZE", "TOL", "GENERAL TOL", "NOMINAL DIM", "UNIT", "CLASS OF FINISH", "A3", "A4", "MODIFICATION", "REV",
)


def unit_scores(e: DataFrame, *keys: str) -> DataFrame:
    """How much a unit looks like a view of a part: for shapes, against texts, annotations,
    the lowest quarter of the sheet, words of metadata and bare lines."""
    kind = F.col("kind")
    meta = K.mentions(F.upper(F.coalesce("text", F.lit(""))), UNIT_WORDS)
    g = e.groupBy("sheet_id", *keys).agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.count(F.lit(1)).alias("total"),
        F.count_if(K.is_geometry(kind)).alias("geometry"), F.count_if(K.is_text(kind)).alias("texts"), F.count_if(K.is_dimension(kind)).alias("notes"), F.count_if(kind == "Line").alias("lines"),
        F.count_if(kind == "Polyline").alias("polylines"), F.count_if(kind == "Arc").alias("arcs"), F.count_if(kind == "Circle").alias("circles"), F.count_if(kind == "Hatch").alias("hatches"),
        F.count_if(kind == "Region").alias("regions"), F.count_distinct(F.when(meta, F.trim("text"))).alias("hits"),
    ).join(prefixed(box_of(e, "sheet_id").drop("n"), "s_"), "sheet_id")
    c, b, s = F.col, B.box(), B.box("s_")
    shape = F.least(F.lit(12.0), c("circles") * 4.0 + c("arcs") * 3.0) + F.least(F.lit(10.0), c("polylines") * 0.8) + F.least(F.lit(6.0), c("regions") * 3.0 + c("hatches") * 1.5)
    top = s.min_y + s.height * 0.25
    low = F.greatest(F.lit(0.0), F.least(b.max_y, top) - F.greatest(b.min_y, s.min_y)) / F.greatest(b.height, F.lit(1e-6))
    lines = (c("geometry") > 0) & (c("lines") >= c("geometry") * 0.80) & (c("circles") + c("arcs") == 0) & (c("polylines") <= 2)
    middle = (b.center_y - s.min_y) / F.greatest(s.height, F.lit(1e-6))
    score = (
        c("geometry") / c("total") * 35.0 + shape - c("texts") / c("total") * 18.0 - c("notes") / c("total") * 16.0 - low * 40.0 - F.when(b.max_y <= top, 18.0).otherwise(0.0)
        - c("hits") * 9.0 - F.when(lines, 8.0).otherwise(0.0) - F.when(middle < 0.25, (F.lit(0.25) - middle) * 20.0).otherwise(0.0)
    )
    return g.withColumn("score", score)
