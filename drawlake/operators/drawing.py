"""Operators over entity tables: regions, zones, clusters, views, units, grids, quantities.

All take and return DataFrames with a sheet_id and treat each sheet by itself. Sums of scores
keep the order in which they are written, so that results do not depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import cadtext as T
from drawlake.functions import kinds as K
from drawlake.operators.spatial import best_per, box_join, box_of, connected, prefixed
from drawlake.storage import written

# --- sheets and bands ---------------------------------------------------------------------


def sheet_bounds(e: DataFrame) -> DataFrame:
    return box_of(e, "sheet_id")


def with_sheet(e: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Add the sheet's box as s_min_x ... s_max_y, by an equality join on sheet_id."""
    s = sheets if sheets is not None else sheet_bounds(e)
    return e.join(prefixed(s.select("sheet_id", *("min_x", "min_y", "max_x", "max_y")), "s_"), "sheet_id")


def band_regions(e: DataFrame) -> DataFrame:
    """Three regions of every sheet: title band at the bottom, meta band at the right, core."""
    s = sheet_bounds(e)
    b = B.box()
    region = lambda name, kind, x0, y0, x1, y1, conf: F.struct(
        F.lit(name).alias("region_id"), F.lit(kind).alias("region_kind"), x0.alias("min_x"), y0.alias("min_y"), x1.alias("max_x"), y1.alias("max_y"), F.lit(conf).alias("confidence")
    )
    split_y, split_x = b.min_y + b.height * 0.26, b.max_x - b.width * 0.24
    three = F.array(
        region("title-bottom", "TitleBlock", b.min_x, b.min_y, b.max_x, split_y, 0.7),
        region("meta-right", "MetaTable", split_x, b.min_y, b.max_x, b.max_y, 0.68),
        region("drawing-core", "Geometry", b.min_x, split_y, split_x, b.max_y, 0.75),
    )
    return s.select("sheet_id", F.explode(three).alias("r")).select("sheet_id", "r.*")


def preliminary_region(e: DataFrame) -> DataFrame:
    s = with_sheet(e)
    b = B.box("s_")
    bottom = F.col("ay").between(b.min_y, b.min_y + b.height * 0.26) & F.col("ax").between(b.min_x, b.max_x)
    right = F.col("ax").between(b.max_x - b.width * 0.24, b.max_x) & F.col("ay").between(b.min_y, b.max_y)
    name = F.when(bottom, "title-bottom").when(right, "meta-right").otherwise("drawing-core")
    kind = F.when(bottom, "TitleBlock").when(right, "MetaTable").otherwise("Geometry")
    return s.select("sheet_id", "handle", name.alias("region_id"), kind.alias("region_kind"))


def simple_regions(e: DataFrame) -> DataFrame:
    """Counts and boxes of what meets the top, right and centre bands of a sheet."""
    s = with_sheet(e)
    b = B.box("s_")
    w, h = F.greatest(b.width, F.lit(1.0)), F.greatest(b.height, F.lit(1.0))
    bands = {
        "meta-top": B.Box(b.min_x, b.min_y + h * 0.72, b.max_x, b.max_y),
        "meta-right": B.Box(b.min_x + w * 0.72, b.min_y, b.max_x, b.max_y),
        "geom-main": B.Box(b.min_x + w * 0.08, b.min_y + h * 0.08, b.max_x - w * 0.12, b.max_y - h * 0.12),
    }
    hits = F.array(*[F.when(B.intersects(x, B.box()) & (K.is_geometry(F.col("kind")) if name == "geom-main" else F.lit(True)), F.lit(name)) for name, x in bands.items()])
    members = s.withColumn("region_id", F.explode(F.array_compact(hits)))
    return box_of(members.withColumn("is_text", K.is_text(F.col("kind"))), "sheet_id", "region_id")


# --- entity to region ----------------------------------------------------------------------


def _regions_of(e: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds the few regions of each sheet as one array, so that picking one needs no further shuffle."""
    columns = ("region_id", "region_kind", "min_x", "min_y", "max_x", "max_y", "confidence")
    packed = regions.groupBy("sheet_id").agg(F.collect_list(F.struct(*columns)).alias("_regions"))
    return e.join(packed, "sheet_id", "left")


def _box_of(r: Column) -> B.Box:
    return B.Box(*[r[c] for c in B.Box._fields])


def best_region(e: DataFrame, regions: DataFrame, near: float = 12.0) -> DataFrame:
    """For each entity the region that holds its anchor (smallest first), else the one that
    it overlaps most, else the nearest within `near`. Ties go to area, confidence, region_id."""
    b = B.box()

    def rated(r: Column) -> Column:
        rb = _box_of(r)
        overlap, gap = B.overlap_of_smaller(b, rb), B.box_distance(b, rb)
        tier = F.when(B.contains_point(rb, F.col("ax"), F.col("ay"), 1.0), 0).when(overlap > 0, 1).when(gap <= near, 2)
        key = F.when(tier == 0, F.lit(0.0)).when(tier == 1, -overlap).otherwise(gap)
        return F.struct(tier.alias("tier"), key.alias("key"), rb.area.alias("area"), (-r["confidence"]).alias("doubt"), r["region_id"].alias("region_id"), r["region_kind"].alias("region_kind"))

    best = F.array_min(F.filter(F.transform("_regions", rated), lambda x: x["tier"].isNotNull()))
    # Generated once, where three fields of a column would each rate all regions anew.
    x = _regions_of(e, regions).select(*[F.col(c) for c in e.columns], F.explode(F.array(best)).alias("_best"))
    return x.select(*e.columns, "_best.region_id", "_best.region_kind", F.col("_best.tier").cast("int").alias("tier"))


def scored_region(e: DataFrame, regions: DataFrame) -> DataFrame:
    """For each entity the region with 0.65 for its anchor and 0.35 for its centre inside, if
    at least 0.15. Only regions that it touches count."""
    b = B.box()
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)

    def rated(r: Column) -> Column:
        rb = _box_of(r)
        score = flag(B.contains_point(rb, F.col("ax"), F.col("ay"))) * 0.65 + flag(B.contains_point(rb, b.center_x, b.center_y)) * 0.35
        return F.struct((-F.when(B.intersects(b, rb), score).otherwise(0.0)).alias("less"), r["region_id"].alias("region_id"), r["region_kind"].alias("region_kind"))

    best = F.array_min(F.filter(F.transform("_regions", rated), lambda x: -x["less"] >= 0.15))
    return _regions_of(e, regions).withColumn("_best", best).select(*e.columns, "_best.region_id", "_best.region_kind", (-F.col("_best.less")).alias("score"))


def is_table_border(kind: Column) -> Column:
    w, h = F.abs(F.col("max_x") - F.col("min_x")), F.abs(F.col("max_y") - F.col("min_y"))
    long, short = F.greatest(w, h), F.least(w, h)
    return K.is_line(kind) & (long > 0) & ((short == 0) | (long >= short * 8.0))


def region_role(region_kind: Column) -> tuple[Column, Column]:
    """Semantic role and confidence of an entity in its region (null for none)."""
    k = F.col("kind")
    text, dim, geo = K.is_text(k), K.is_dimension(k), K.is_geometry(k)
    t = K.plain(F.col("text"))
    border = is_table_border(k)
    rules = {
        "Geometry": [(dim, "Dimension", 0.92), (text, "Text", 0.72), (geo, "Geometry", 0.90), (None, "Symbol", 0.45)],
        "DimensionNote": [(dim, "Dimension", 0.95), (text, "Text", 0.86), (geo, "Geometry", 0.65), (None, "Symbol", 0.40)],
        "MetaTable": [
            (border, "TableBorder", 0.92), (text & T.is_meta_label(t), "MetaLabel", 0.93), (text & T.is_meta_value(t), "MetaValue", 0.82), (text, "Text", 0.60),
            (dim, "Dimension", 0.55), (geo, "Symbol", 0.52), (None, "Unknown", 0.20),
        ],
        "TitleBlock": [
            (border, "TableBorder", 0.88), (text & T.is_meta_label(t), "MetaLabel", 0.86), (text & T.is_meta_value(t), "MetaValue", 0.74),
            (text & T.is_title_text(t), "TitleText", 0.82), (text, "Text", 0.58), (geo, "Symbol", 0.48), (dim, "Dimension", 0.42), (None, "Unknown", 0.20),
        ],
        "Preview": [(geo, "PreviewGeometry", 0.92), (text, "Text", 0.68), (dim, "Dimension", 0.60), (None, "Symbol", 0.42)],
    }
    free = [(dim, "Dimension", 0.72), (text, "Text", 0.68), (geo, "Geometry", 0.64), (None, "Unknown", 0.20)]

    def chain(pick: int) -> Column:
        def one(cases: list) -> Column:
            out = None
            for test, *values in cases[:-1]:
                out = F.when(test, values[pick]) if out is None else out.when(test, values[pick])
            return out.otherwise(cases[-1][1 + pick])

        out = None
        for kind, cases in rules.items():
            out = F.when(region_kind == kind, one(cases)) if out is None else out.when(region_kind == kind, one(cases))
        return out.otherwise(one(free))

    return chain(0), chain(1)


# --- frames, zones and content ---------------------------------------------------------------


def frame_candidates(e: DataFrame) -> DataFrame:
    """Entities whose box nearly covers the sheet, with their border score."""
    s = with_sheet(e)
    b, sb = B.box(), B.box("s_")
    coverage = F.when(sb.area > 0, b.area / sb.area).otherwise(0.0)

    def border(diff: Column) -> Column:
        return F.when(diff <= 1.25, 1.0).when(diff <= 2.5, 0.7).when(diff <= 5.0, 0.4).when(diff <= 10.0, 0.1).otherwise(0.0)

    score = F.lit(1.0) - F.abs(F.lit(1.0) - coverage)
    for side in ("min_x", "max_x", "min_y", "max_y"):
        score = score + border(F.abs(F.col(side) - F.col(f"s_{side}")))
    return s.withColumn("coverage", coverage).filter((b.width > 0) & (b.height > 0) & F.col("coverage").between(0.85, 1.02)).withColumn("score", score).filter("score > 0")


def outer_frame(e: DataFrame) -> DataFrame:
    """The best frame candidate of each sheet; ties go to the smallest handle."""
    return best_per(frame_candidates(e), ["sheet_id"], [F.col("score").desc(), F.col("handle")])


#: Strips and their keywords.
ZONES = {
    "BottomTitleBlock": ("TitleBlockTable", 0.45, ("NO", "DESCRIPTION", "SPECIFICATION", "GENERAL TOL", "NOMINAL DIM", "DETAILS OF THE MODIFICATION", "REASONS OF THE MODIFICATION", "REV", "APPD", "CHKD", "DRN")),
    "RightMetaBand": ("MetaTextBand", 0.40, ("SIZE", "SCALE", "UNIT", "REMARK", "REMARKS", "PAINT", "MATERIAL", "MAT'L", "Q'TY", "THIS DOCUMENT IS THE PROPERTY")),
    "LeftBorderAnnotations": ("BorderAnnotationBand", 0.20, ("SET", "Q'TY", "QTY", "REV", "NO")),
}


def zone_strips(e: DataFrame) -> DataFrame:
    """Bottom, right and left strips of every sheet, of its non-text box widened by 2."""
    s = prefixed(sheet_bounds(e), "s_")
    work = box_of(e.filter(~K.is_text(F.col("kind"))), "sheet_id")
    both = s.join(work, "sheet_id", "left")
    has = (F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y"))
    low = lambda c: F.when(has, F.greatest(F.col(f"s_{c}"), F.col(c) - 2.0)).otherwise(F.col(f"s_{c}"))
    high = lambda c: F.when(has, F.least(F.col(f"s_{c}"), F.col(c) + 2.0)).otherwise(F.col(f"s_{c}"))
    base = both.select("sheet_id", low("min_x").alias("z_min_x"), low("min_y").alias("z_min_y"), high("max_x").alias("z_max_x"), high("max_y").alias("z_max_y"))
    z = B.box("z_")
    strip = lambda name, x0, y0, x1, y1: F.struct(F.lit(name).alias("zone"), x0.alias("min_x"), y0.alias("min_y"), x1.alias("max_x"), y1.alias("max_y"))
    three = F.array(
        strip("BottomTitleBlock", z.min_x, z.min_y, z.max_x, z.min_y + z.height * 0.28),
        strip("RightMetaBand", z.max_x - z.width * 0.22, z.min_y, z.max_x, z.max_y),
        strip("LeftBorderAnnotations", z.min_x, z.min_y, z.min_x + z.width * 0.10, z.max_y),
    )
    return base.select("*", F.explode(three).alias("r")).select("sheet_id", "z_min_x", "z_min_y", "z_max_x", "z_max_y", "r.*")


def zone_members(e: DataFrame) -> DataFrame:
    """Entities of each strip: texts that touch it, lines inside or with at least 0.35 of
    their area in it, blocks with their anchor in it, others inside."""
    pairs = e.join(prefixed(zone_strips(e), "r_"), "sheet_id")
    b, r = B.box(), B.box("r_")
    rep = B.contains_point(r, F.col("ax"), F.col("ay"), 2.0)
    inside, touch = B.contains_box(r, b, 2.0), B.intersects(r, b, 2.0)
    share = F.when(b.area > 0, B.intersection_area(b, r) / b.area).otherwise(0.0)
    kind = F.col("kind")
    member = (
        F.when(K.is_text(kind), rep | touch)
        .when(K.is_line(kind), rep | inside | (share >= 0.35))
        .when(kind == "BlockReference", rep & touch).otherwise(rep | inside)
    )
    return pairs.filter(member)


def exclusion_zones(e: DataFrame) -> DataFrame:
    """Zones that are scored at least 2: sheet_id, zone, kind, box, score, text_count,
    keyword_hits (keywords that some text of the strip contains)."""
    m = zone_members(e)
    kind, t = F.col("kind"), K.plain(F.col("text"))
    base = B.box("r_z_")
    hits = [F.max(F.when((F.col("r_zone") == name) & K.is_text(kind) & F.contains(t, F.lit(w)), 1).otherwise(0)) for name, (_, _, words) in ZONES.items() for w in words]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    first = lambda c: F.first(c).alias(c)
    g = m.groupBy("sheet_id", F.col("r_zone").alias("zone")).agg(
        F.min("min_x").alias("m_min_x"), F.min("min_y").alias("m_min_y"), F.max("max_x").alias("m_max_x"), F.max("max_y").alias("m_max_y"),
        F.count_if(K.is_text(kind)).alias("text_count"), total.cast("bigint").alias("keyword_hits"),
        F.count_if(K.is_line(kind) & (F.col("max_x") - F.col("min_x") >= base.width * 0.18)).alias("long_h"),
        F.count_if(K.is_line(kind) & (F.col("max_y") - F.col("min_y") >= base.height * 0.18)).alias("long_v"),
        *[first(f"r_{p}{c}") for p in ("", "z_") for c in ("min_x", "min_y", "max_x", "max_y")],
    )
    z, r = B.box("m_"), B.box("r_")
    inner = B.Box(F.greatest(z.min_x, r.min_x), F.greatest(z.min_y, r.min_y), F.least(z.max_x, r.max_x), F.least(z.max_y, r.max_y))
    good = (inner.width > 0) & (inner.height > 0)
    final = g.select("*", *[F.when(good, v).otherwise(F.col(f"r_{c}")).alias(c) for c, v in zip(("min_x", "min_y", "max_x", "max_y"), inner, strict=True)])
    f = B.box()
    bottom, right = F.abs(f.min_y - base.min_y) <= 8.0, F.abs(f.max_x - base.max_x) <= 8.0
    score = F.col("text_count") * 0.25 + F.col("keyword_hits") * 1.0 + F.col("long_h") * 0.4 + F.col("long_v") * 0.4 + F.when(bottom, 1.0).otherwise(0.0) + F.when(right, 1.0).otherwise(0.0)
    most = F.create_map(*[x for n, (_, a, _) in ZONES.items() for x in (F.lit(n), F.lit(a))])
    kinds = F.create_map(*[x for n, (k, _, _) in ZONES.items() for x in (F.lit(n), F.lit(k))])
    share = f.area / base.area
    return (
        final.withColumn("score", score).withColumn("share", share)
        .filter((F.col("share") > 0) & (F.col("share") <= most[F.col("zone")]) & (F.col("text_count") >= 3) & (F.col("score") >= 2.0))
        .filter(((F.col("zone") != "BottomTitleBlock") | bottom) & ((F.col("zone") != "RightMetaBand") | right))
        .select("sheet_id", "zone", kinds[F.col("zone")].alias("zone_kind"), "min_x", "min_y", "max_x", "max_y", "score", "text_count", "keyword_hits")
    )


def residual_content(e: DataFrame) -> DataFrame:
    """What remains when the outer frame, the zones' members, what lies in the widened zones
    and border-like entities in the frame's border strip are taken away."""
    zones = written(exclusion_zones(e))  # a few rows a sheet, used three times
    members = zone_members(e).select("sheet_id", "handle", F.col("r_zone").alias("zone")).join(zones.select("sheet_id", "zone"), ["sheet_id", "zone"], "left_semi")
    frame = outer_frame(e)
    gone = members.select("sheet_id", "handle").unionByName(frame.select("sheet_id", "handle")).distinct()
    z = B.inflated(B.box("z_"), 2.0)
    in_zone = B.contains_box(z, B.box()) | B.contains_point(z, F.col("ax"), F.col("ay"))
    left = e.join(gone, ["sheet_id", "handle"], "left_anti")
    zz = prefixed(zones.select("sheet_id", "min_x", "min_y", "max_x", "max_y"), "z_", ()).withColumnRenamed("z_sheet_id", "z_sheet")
    left = left.join(zz, (F.col("sheet_id") == F.col("z_sheet")) & in_zone, "left_anti")
    framed = left.join(prefixed(frame.select("sheet_id", "min_x", "min_y", "max_x", "max_y"), "f_"), "sheet_id", "left")
    f = B.box("f_")
    inner = B.deflated(f, 2.0)
    strip = B.contains_point(f, F.col("ax"), F.col("ay")) & ~B.contains_point(inner, F.col("ax"), F.col("ay"))
    border = strip & (K.is_text(F.col("kind")) | K.is_line(F.col("kind")) | (F.col("kind") == "Leader"))
    return framed.filter(f.min_x.isNull() | (B.intersects(B.box(), inner) & ~border)).select(*e.columns)


# --- clusters and views -----------------------------------------------------------------------


def seed_filter(e: DataFrame) -> DataFrame:
    """Geometry that may seed clusters: no excluded layer, not tiny, no fills, no long bridges."""
    s = with_sheet(e)
    b, sb = B.box(), B.box("s_")
    w, h = F.greatest(F.lit(0.0), b.width), F.greatest(F.lit(0.0), b.height)
    most, least = F.greatest(w, h), F.greatest(F.least(w, h), F.lit(0.001))
    kind, diag = F.col("kind"), sb.diagonal
    layer = F.lower(F.trim("layer"))
    long_line = (kind == "Line") & ((most >= diag * 0.18) | ((most >= least * 40.0) & (most >= diag * 0.03)))
    long_poly = (kind == "Polyline") & ((most >= diag * 0.20) | ((most >= least * 25.0) & (most >= diag * 0.05)))
    keep = kind.isin("Line", "Polyline", "Arc", "Circle", "Ellipse") & ~layer.isin("cl", "hl", "d") & ~((w <= 0.5) & (h <= 0.5)) & ~long_line & ~long_poly
    return s.filter(keep).select(*e.columns)


def union_edges(seeds: DataFrame) -> DataFrame:
    """Pairs of seeds to be united: within 2.0 as boxes; two lines also need overlap on an
    axis and boxes widened by 0.5 that meet, round ones 0.25, others 0.375."""
    pairs = box_join(seeds.select("sheet_id", "handle", "kind", "min_x", "min_y", "max_x", "max_y"), seeds.select("sheet_id", "handle", "kind", "min_x", "min_y", "max_x", "max_y"), 2.0)
    a, b = B.box("a_"), B.box("b_")
    ak, bk = F.col("a_kind"), F.col("b_kind")
    lines, rounds = K.is_line(ak) & K.is_line(bk), K.is_round(ak) | K.is_round(bk)
    overlap = F.greatest(B.axis_overlap(a.min_x, a.max_x, b.min_x, b.max_x), B.axis_overlap(a.min_y, a.max_y, b.min_y, b.max_y)) > 0
    ok = F.when(lines, overlap & B.intersects(a, b, 0.5)).when(rounds, B.intersects(a, b, 0.25)).otherwise(B.intersects(a, b, 0.375))
    return pairs.filter((F.col("a_handle") < F.col("b_handle")) & (B.box_distance(a, b) <= 2.0) & ok).select("sheet_id", F.col("a_handle").alias("a"), F.col("b_handle").alias("b"))


def geometry_clusters(e: DataFrame) -> DataFrame:
    """Seeds with their cluster (smallest handle of the component)."""
    seeds = seed_filter(e)
    return connected(seeds, union_edges(seeds)).withColumnRenamed("component", "cluster_id")


def cluster_boxes(e: DataFrame) -> DataFrame:
    return box_of(geometry_clusters(e), "sheet_id", "cluster_id")


def attach_nearest(e: DataFrame, clusters: DataFrame, within: float = 80.0) -> DataFrame:
    """Texts and dimensions with the nearest cluster box within the distance, or none."""
    later = e.filter(K.is_text(F.col("kind")) | K.is_dimension(F.col("kind")))
    pairs = box_join(later.select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y"), clusters.select("sheet_id", "cluster_id", "min_x", "min_y", "max_x", "max_y"), within, 256.0)
    pairs = pairs.withColumn("distance", B.box_distance(B.box("a_"), B.box("b_"))).filter(F.col("distance") <= within)
    best = best_per(pairs, ["sheet_id", "a_handle"], [F.col("distance"), F.col("b_cluster_id")])
    return later.select("sheet_id", "handle").join(best.select("sheet_id", F.col("a_handle").alias("handle"), F.col("b_cluster_id").alias("cluster_id"), "distance"), ["sheet_id", "handle"], "left")


def view_pairs(views: DataFrame, directed: bool = True) -> DataFrame:
    """All pairs of views of a sheet with overlap, gap, direction and score."""
    v = views.select("sheet_id", "view_id", "min_x", "min_y", "max_x", "max_y")
    test = F.col("a_view_id") != F.col("b_view_id") if directed else F.col("a_view_id") < F.col("b_view_id")
    pairs = prefixed(v, "a_").join(prefixed(v, "b_"), "sheet_id").filter(test)
    a, b = B.box("a_"), B.box("b_")
    dx, dy = b.center_x - a.center_x, b.center_y - a.center_y
    gx, gy = B.gap_x(a, b), B.gap_y(a, b)
    direction = (
        F.when((gx <= 1e-9) & (gy <= 1e-9), "Overlapping")
        .when((F.abs(dx) >= F.abs(dy)) & (dx >= 0), "RightOf").when(F.abs(dx) >= F.abs(dy), "LeftOf")
        .when(dy >= 0, "Above").otherwise("Below")
    )
    gap = B.normalized_gap(a, b)
    xo, yo = B.x_overlap_ratio(a, b), B.y_overlap_ratio(a, b)
    return pairs.select(
        "sheet_id", F.col("a_view_id").alias("source_id"), F.col("b_view_id").alias("target_id"), direction.alias("direction"),
        xo.alias("x_overlap"), yo.alias("y_overlap"), gap.alias("gap"),
        (F.lit(0.6) * F.greatest(xo, yo) + F.lit(0.4) * (F.lit(1.0) - B.clamp01(gap / 1.5))).alias("score"),
    )


def merge_edges(views: DataFrame, sheets: DataFrame) -> DataFrame:
    """Pairs of clusters to be merged into one view, by five weighted scores; clusters in the
    corridor between the two block it."""
    v = views.select("sheet_id", "view_id", "min_x", "min_y", "max_x", "max_y").filter((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) > 1e-6)
    pairs = prefixed(v, "a_").join(prefixed(v, "b_"), "sheet_id").filter("a_view_id < b_view_id").join(prefixed(sheets.select("sheet_id", "min_x", "min_y", "max_x", "max_y"), "s_"), "sheet_id")
    a, b, s = B.box("a_"), B.box("b_"), B.box("s_")
    joint = B.union(a, b)
    band = F.greatest(B.x_overlap_ratio(a, b), B.y_overlap_ratio(a, b))
    gap = B.normalized_gap(a, b)
    plausible = B.clamp01(F.when(joint.area > 1e-9, (a.area + b.area) / joint.area).otherwise(0.0))
    major = (a.area >= s.area * 0.25) & (b.area >= s.area * 0.25)
    near = pairs.filter((gap <= 0.35) & (band >= 0.45) & ~(major & (plausible < 0.35)))
    cx, cy = joint.width * 0.08, joint.height * 0.08
    corridor = B.Box(joint.min_x + cx, joint.min_y + cy, joint.max_x - cx, joint.max_y - cy)
    other = prefixed(v, "o_")
    o = B.box("o_")
    blocked = near.join(other, "sheet_id").filter(~F.col("o_view_id").isin(F.col("a_view_id"), F.col("b_view_id")) & B.intersects(corridor, B.inflated(o, 1.0)))
    counts = blocked.groupBy("sheet_id", "a_view_id", "b_view_id").agg(F.count(F.lit(1)).alias("blockers"))
    x = near.join(counts, ["sheet_id", "a_view_id", "b_view_id"], "left").withColumn("blockers", F.coalesce("blockers", F.lit(0)))
    penalty = B.clamp01(F.col("blockers") * 0.35)
    space = F.when(joint.area > 1e-9, B.clamp01((joint.area - (a.area + b.area)) / joint.area)).otherwise(1.0)
    isolation = B.clamp01((F.lit(1.0) - space) * (F.lit(1.0) - penalty))
    size = F.least(a.diagonal, b.diagonal) / F.greatest(a.diagonal, b.diagonal)
    score = F.lit(0.30) * (F.lit(1.0) - B.clamp01(gap / 0.35)) + F.lit(0.25) * band + F.lit(0.15) * size + F.lit(0.10) * plausible + F.lit(0.20) * isolation
    return x.filter(penalty < 0.70).withColumn("score", score).filter(F.round("score", 9) >= 0.62).select("sheet_id", F.col("a_view_id").alias("a"), F.col("b_view_id").alias("b"), "blockers", "score")


def frame_like(clusters: DataFrame, sheets: DataFrame) -> DataFrame:
    """Clusters that look like a sheet frame: at least 4 of 6 points."""
    c = clusters.join(prefixed(sheets.select("sheet_id", "min_x", "min_y", "max_x", "max_y"), "s_"), "sheet_id")
    b, s = B.box(), B.box("s_")
    floor = lambda v: F.greatest(v, F.lit(1e-9))
    tol = F.greatest(s.width, s.height) * 0.015
    edges = sum([F.when(F.abs(F.col(k) - F.col(f"s_{k}")) <= tol, 1).otherwise(0) for k in ("min_x", "min_y", "max_x", "max_y")], F.lit(0))
    off = B.point_distance(b.center_x, b.center_y, s.center_x, s.center_y) / floor(s.diagonal)
    tests = [
        b.area / floor(s.area) >= 0.72, b.width / floor(s.width) >= 0.90, b.height / floor(s.height) >= 0.90,
        edges >= 3, off <= 0.05, (F.col("n") > 0) & (F.col("n") <= 12) & (F.col("rounds") <= F.col("n") * 0.20),
    ]
    points = sum([F.when(t, 1).otherwise(0) for t in tests], F.lit(0))
    return c.select("sheet_id", "cluster_id", points.alias("points"), (points >= 4).alias("is_frame"))


def dimension_semantics(e: DataFrame) -> DataFrame:
    b = B.box()
    turn = F.when(b.width > b.height * 1.25, "Horizontal").when(b.height > b.width * 1.25, "Vertical").otherwise("Unknown")
    return e.filter("kind = 'Dimension'").select("*", turn.alias("orientation"), T.dimension_kind(F.col("text")).alias("dimension_kind"), T.measured_value(F.col("text")).alias("measured"))


def dimension_owner(dims: DataFrame, views: DataFrame) -> DataFrame:
    """The view that owns each dimension: best weighted score of at least 0.55 and ahead of
    the second by 0.08, else ambiguous or unresolved."""
    strong = view_pairs(views).filter("score >= 0.40").groupBy("sheet_id", F.col("source_id").alias("view_id")).agg(F.count(F.lit(1)).alias("strong"))
    v = views.join(strong, ["sheet_id", "view_id"], "left").select("sheet_id", F.col("view_id").alias("v_view_id"), *[F.col(c).alias(f"v_{c}") for c in ("min_x", "min_y", "max_x", "max_y")], F.coalesce("strong", F.lit(0)).alias("strong"))
    p = dims.join(v, "sheet_id")
    d, w = B.box(), B.box("v_")
    gap, xo, yo = B.normalized_gap(d, w), B.x_overlap_ratio(d, w), B.y_overlap_ratio(d, w)
    h, t = F.col("orientation") == "Horizontal", F.col("orientation") == "Vertical"
    loose = F.lit(1.0) - B.clamp01(gap / 1.2)
    beside_y, beside_x = (F.col("ay") > w.max_y) | (F.col("ay") < w.min_y), (F.col("ax") < w.min_x) | (F.col("ax") > w.max_x)
    band = F.when(h & ~beside_y, 0.15).when(h, F.lit(0.35) + F.lit(0.65) * xo).when(t & ~beside_x, 0.15).when(t, F.lit(0.35) + F.lit(0.65) * yo).otherwise(loose)
    projection = F.when(h, xo).when(t, yo).otherwise(loose)
    score = F.lit(0.35) * band + F.lit(0.25) * projection + F.lit(0.20) * (F.lit(1.0) - B.clamp01(gap / 1.5)) + F.lit(0.20) * B.clamp01(F.col("strong") / 3.0)
    ranked = p.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(W.partitionBy("sheet_id", "handle").orderBy(F.col("score").desc(), "v_view_id")))
    g = ranked.filter("rank <= 2").groupBy("sheet_id", "handle").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("v_view_id"))).alias("view_id")
    )
    status = F.when(F.col("score") < 0.55, "Unresolved").when(F.col("second").isNotNull() & (F.abs(F.col("score") - F.col("second")) < 0.08), "Ambiguous").otherwise("Resolved")
    return g.withColumn("status", status).select("sheet_id", "handle", "status", F.when(F.col("status") == "Resolved", F.col("view_id")).alias("view_id"), "score")


# --- units --------------------------------------------------------------------------------------


def composition(e: DataFrame, *keys: str) -> DataFrame:
    """Counts by kind of each group, and what it is heavy in."""
    kind = F.col("kind")
    kinds = {"block": "BlockReference", "text": "Text", "mtext": "MText", "dimension": "Dimension", "leader": "Leader", "line": "Line", "polyline": "Polyline", "arc": "Arc", "circle": "Circle", "hatch": "Hatch"}
    g = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(kind == v).alias(f"n_{k}") for k, v in kinds.items()],
        F.count_if(K.is_geometry(kind)).alias("geometry"), F.count_if(K.is_text(kind)).alias("texts"), F.count_if(K.is_dimension(kind)).alias("annotations"),
    )
    return g.select(
        "*", ((F.col("texts") >= 3) & (F.col("texts") >= F.col("geometry"))).alias("text_heavy"),
        ((F.col("geometry") >= 3) & (F.col("geometry") > F.col("texts"))).alias("geometry_heavy"),
        ((F.col("annotations") >= 2) & (F.col("annotations") >= F.col("geometry") * 0.5)).alias("annotation_heavy"),
    )


def loose_key(kind: Column) -> Column:
    return F.when(K.is_text(kind), "loose-text").when(K.is_dimension(kind), "loose-dimension").when(kind == "BlockReference", "loose-block").when(K.is_geometry(kind), "loose-geometry").otherwise("loose-other")


def structural_units(e: DataFrame) -> DataFrame:
    """Branch units by block path, family units by leaf block, loose units by class: unit
    kind, key, index by descending size (ties by key) and member statistics."""
    path = F.col("block_path")
    rows = (
        e.filter(path.isNotNull()).select("*", F.lit("Branch").alias("unit_kind"), path.alias("unit_key"))
        .unionByName(e.filter(path.isNotNull()).select("*", F.lit("BlockFamily").alias("unit_kind"), F.col("block_name").alias("unit_key")))
        .unionByName(e.filter(path.isNull()).select("*", F.lit("Loose").alias("unit_kind"), loose_key(F.col("kind")).alias("unit_key")))
    )
    g = box_of(rows, "sheet_id", "unit_kind", "unit_key")
    index = F.row_number().over(W.partitionBy("sheet_id", "unit_kind").orderBy(F.col("n").desc(), "unit_key"))
    return g.withColumn("unit_index", index.cast("int"))


def ownership(e: DataFrame) -> DataFrame:
    """Loose members whose handle no branch or family owns."""
    owned = e.filter(F.col("block_path").isNotNull()).select("sheet_id", "handle")
    return e.join(owned, ["sheet_id", "handle"], "left_anti")


# --- grids ----------------------------------------------------------------------------------------


def occupied_cells(e: DataFrame, rows: int = 20, cols: int = 30) -> DataFrame:
    """Cells of a sheet's grid that boxes cover, with hits by box and by anchor."""
    s = with_sheet(e)
    b = B.box("s_")
    cw, ch = b.width / cols, b.height / rows
    at = lambda v, low, size, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) / size).cast("int")))
    x0, x1 = at(F.col("min_x"), b.min_x, cw, cols), at(F.col("max_x"), b.min_x, cw, cols)
    y0, y1 = at(F.col("min_y"), b.min_y, ch, rows), at(F.col("max_y"), b.min_y, ch, rows)
    cells = s.filter((cw > 0) & (ch > 0)).withColumn("row", F.explode(F.sequence(y0, y1))).withColumn("col", F.explode(F.sequence(x0, x1)))
    rep = (at(F.col("ax"), b.min_x, cw, cols) == F.col("col")) & (at(F.col("ay"), b.min_y, ch, rows) == F.col("row"))
    return cells.groupBy("sheet_id", "row", "col").agg(F.count(F.lit(1)).alias("box_hits"), F.count_if(rep).alias("anchor_hits"), F.min("handle").alias("first_handle"))


def grid_islands(cells: DataFrame, cols: int = 30) -> DataFrame:
    """Islands of cells that touch on a side: sheet_id, island, cells, row and column span."""
    nodes = cells.select("sheet_id", "row", "col", (F.col("row") * cols + F.col("col")).cast("bigint").alias("handle"))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")), F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc"))))
    shifted = nodes.select("*", steps.alias("d")).select("sheet_id", F.col("handle").alias("a"), (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col"))
    edges = shifted.join(nodes.select("sheet_id", "row", "col", F.col("handle").alias("b")), ["sheet_id", "row", "col"]).select("sheet_id", "a", "b")
    return connected(nodes, edges).groupBy("sheet_id", F.col("component").alias("island")).agg(
        F.count(F.lit(1)).alias("cells"), F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col")
    )


# --- quantities --------------------------------------------------------------------------------------


def quantity_candidates(e: DataFrame) -> DataFrame:
    """Inline quantities of texts with their scores; region_kind as in preliminary_region."""
    t = F.trim(F.coalesce("text", F.lit("")))
    quantity, rule = T.quantity_rules(t)
    r = F.col("region_kind")
    base = F.when(r == "MetaTable", 0.10).when(r == "TitleBlock", 0.06).when(r == "DimensionNote", -0.12).when(r == "Geometry", -0.18).when(r == "Preview", -0.15).otherwise(-0.04)
    bonus = F.when(F.contains(F.upper(t), F.lit("SET")), 0.04).otherwise(0.0)
    score = F.when(F.col("rule") == "label", 0.97).when(F.col("rule") == "unit", B.clamp01(base + 0.82 + bonus)).otherwise(B.clamp01(base + 0.78))
    rows = e.filter(K.is_text(F.col("kind")) & (t != "") & ~T.is_engineering_text(t)).join(preliminary_region(e), ["sheet_id", "handle"])
    return rows.withColumn("quantity", quantity).withColumn("rule", rule).filter("quantity IS NOT NULL").withColumn("score", score)


#: What a label holds, in upper case.
QUANTITY_LABELS = ("QTY", "Q'TY", "QUANTITY", "수량")
REGION_SCORES = {"MetaTable": 0.10, "TitleBlock": 0.06, "DimensionNote": -0.12, "Geometry": -0.18, "Preview": -0.15}


def label_neighbours(texts: DataFrame, most: int = 3) -> DataFrame:
    """Values beside quantity labels in tables and title blocks: for each label the `most` best texts of
    its region that are a quantity on their own: sheet_id, label, handle, quantity, score, relation
    (right, below, close), distance and rank (by falling score, distance and handle).

    texts: sheet_id, handle, text, ax, ay, height (null or 0: 3.5), region_id, region_kind. A
    label meets what lies within its reach by cells of a region, whose size follows from the tallest
    text of the sheet. Null texts are no labels and no values; rows without an anchor meet nothing."""
    c = F.col
    t = texts.withColumns({"t": F.trim(F.coalesce("text", F.lit(""))), "h": F.when(c("height") > 0, c("height")).otherwise(3.5)}).filter("ax IS NOT NULL AND ay IS NOT NULL")
    tall = t.groupBy("sheet_id").agg(F.greatest(F.lit(120.0), F.max("h") * 35.0).alias("cell"))
    t = t.join(tall, "sheet_id").withColumns({"cx": F.floor(c("ax") / c("cell")), "cy": F.floor(c("ay") / c("cell"))})
    named = F.lit(False)
    for w in QUANTITY_LABELS:
        named = named | F.contains(F.upper("t"), F.lit(w))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    labels = t.filter(named & c("region_kind").isin("MetaTable", "TitleBlock")).withColumn("s", steps)
    labels = labels.select("sheet_id", "region_id", (c("cx") + c("s.i")).alias("cx"), (c("cy") + c("s.j")).alias("cy"), c("handle").alias("label"), c("ax").alias("lx"), c("ay").alias("ly"), c("h").alias("lh"))
    values = t.withColumn("quantity", T.standalone_quantity(c("t"))).filter((c("t") != "") & c("quantity").isNotNull() & ~T.is_engineering_text(c("t")))
    p = labels.join(values.select("sheet_id", "region_id", "region_kind", "cx", "cy", "handle", "quantity", "ax", "ay", "h"), ["sheet_id", "region_id", "cx", "cy"]).filter("label <> handle")
    h = F.greatest("lh", "h")
    p = p.withColumns({"dx": c("ax") - c("lx"), "dy": c("ay") - c("ly"), "distance": B.point_distance(c("ax"), c("ay"), c("lx"), c("ly"))})
    right = c("dx").between(F.lit(0.0), F.greatest(F.lit(120.0), h * 35.0)) & (F.abs("dy") <= F.greatest(F.lit(8.0), h * 1.8))
    below = (c("dy") <= 0) & (F.abs("dx") <= F.greatest(F.lit(10.0), h * 2.0)) & (F.abs("dy") <= F.greatest(F.lit(80.0), h * 22.0))
    p = p.withColumn("relation", F.when(right, "right").when(below, "below").when(c("distance") <= F.greatest(F.lit(16.0), h * 4.5), "close")).filter("relation IS NOT NULL")
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in REGION_SCORES.items() for x in kv])[c("region_kind")], F.lit(-0.04))
    near = F.when(c("relation") == "right", 0.34).when(c("relation") == "below", 0.24).otherwise(0.18)
    score = F.round(B.clamp01(F.lit(0.52) + base + near) - F.when(c("quantity") > 500, 0.06).otherwise(0.0), 9)
    rank = F.row_number().over(W.partitionBy("sheet_id", "label").orderBy(c("score").desc(), "distance", "handle"))
    return p.withColumn("score", score).withColumn("rank", rank).filter(c("rank") <= most).select("sheet_id", "label", "handle", "quantity", "score", "relation", "distance", "rank")


def all_quantities(e: DataFrame) -> DataFrame:
    """Inline quantities and values beside labels, each a candidate: sheet_id, handle, label (null of
    inline ones), quantity, score. A text that is both counts twice."""
    inline = quantity_candidates(e).select("sheet_id", "handle", F.lit(None).cast("bigint").alias("label"), "quantity", "score")
    texts = e.filter(K.is_text(F.col("kind"))).join(preliminary_region(e), ["sheet_id", "handle"]).withColumn("height", F.lit(None).cast("double"))
    return inline.unionByName(label_neighbours(texts).select("sheet_id", "handle", F.col("label").cast("bigint").alias("label"), "quantity", "score"))


def decide_quantity(candidates: DataFrame, sheets: DataFrame) -> DataFrame:
    """Confirmed, ambiguous or not found, for every sheet."""
    best = F.max("score")
    n = F.count(F.lit(1))
    g = candidates.groupBy("sheet_id", "quantity").agg(best.alias("best"), n.alias("n")).withColumn("total", F.round(F.col("best") + F.least(F.lit(0.20), (F.col("n") - 1) * 0.05), 9))
    rank = F.row_number().over(W.partitionBy("sheet_id").orderBy(F.col("total").desc(), F.col("n").desc(), F.col("best").desc(), "quantity"))
    top = g.withColumn("rank", rank).filter("rank <= 2")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    one = top.groupBy("sheet_id").agg(pick(1, "quantity").alias("quantity"), pick(1, "best").alias("best"), pick(1, "n").alias("n"), pick(1, "total").alias("total"), pick(2, "total").alias("second"))
    lead = F.col("total") - F.col("second")
    conflict = F.col("second").isNotNull() & (F.col("total") >= 0.70) & (F.col("second") >= 0.70) & (F.abs(lead) < 0.12)
    clear = (F.col("best") >= 0.88) & (F.col("second").isNull() | (lead >= 0.12))
    again = (F.col("best") >= 0.76) & (F.col("n") >= 2) & (F.col("second").isNull() | (lead >= 0.08))
    status = F.when(F.col("total").isNull(), "NotFound").when(conflict, "Ambiguous").when(clear | again, "Confirmed").when(F.col("best") >= 0.60, "Ambiguous").otherwise("NotFound")
    return sheets.select("sheet_id").join(one, "sheet_id", "left").withColumn("status", status).select("sheet_id", "status", F.when(F.col("status") == "Confirmed", F.col("quantity")).alias("quantity"), "total")
