"""Roles, separation and packing of structural units, and block decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.operators.drawing import loose_key
from drawlake.operators.spatial import best_per, box_join, connected

#: Keywords and patterns of unit roles.
METADATA_WORDS = ("SCALE", "UNIT", "DATE", "DRAWN", "CHECK", "APPROVED", "GENERAL", "TOL", "TITLE", "DWG", "NO", "REV")
MATERIAL = r"\b(SS41|SS400|SUS|SUS304|SUS316|AL|AL5052|AL6061|SPHC|SPCC|SECC|SGCC|STEEL|STS|SKD|SKH|SCM|SM45C|A36)\b"


def unit_members(e: DataFrame) -> DataFrame:
    """Entities with the units they belong to: branch and family by block path, else loose."""
    path = F.col("block_path")
    unit = lambda kind, key: F.struct(F.lit(kind).alias("unit_kind"), key.alias("unit_key"))
    of = F.when(path.isNotNull(), F.array(unit("Branch", path), unit("BlockFamily", F.col("block_name")))).otherwise(F.array(unit("Loose", loose_key(F.col("kind")))))
    return e.select("*", F.explode(of).alias("u")).select(*e.columns, "u.unit_kind", "u.unit_key")


def unit_roles(e: DataFrame) -> DataFrame:
    """Role of every unit: frame, table row, annotation, metadata, title block, geometry, mixed."""
    kind, t = F.col("kind"), K.plain(F.col("text"))
    text = K.is_text(kind)
    number = t.rlike(r"^\d{1,9}$")
    value = F.when(number, t.cast("bigint"))
    some = lambda c: F.coalesce(F.bool_or(text & c), F.lit(False))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    g = unit_members(e).groupBy("sheet_id", "unit_kind", "unit_key").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(text).alias("texts"), F.count_if(K.is_dimension(kind)).alias("dims"), F.count_if(K.is_geometry(kind)).alias("geometry"), F.count_if(kind == "Line").alias("lines"),
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
        some(value.between(1, 9999)).alias("item"), some(value.between(1, 999)).alias("qty"), some(t.rlike(MATERIAL)).alias("material"), some(t.isin("-", "—", "N/A", "NA")).alias("remark"),
        some(~number & ~t.rlike(MATERIAL) & ~t.isin("-", "—") & (letters >= 2)).alias("description"), F.count_if(text & K.mentions(t, METADATA_WORDS)).alias("meta_hits"),
        F.array_sort(F.collect_set("handle")).alias("handles"),
    )
    b, n = B.box(), F.col("total")
    flat = (b.height > 1e-6) & (b.width >= b.height * 8.0)
    row = (F.col("texts") >= 4) & (F.col("dims") == 0) & flat & (F.col("texts") >= n * 0.8) & F.col("item") & F.col("material") & F.col("qty") & F.col("description") & F.col("remark")
    frame = (F.col("geometry") >= 4) & (F.col("lines") >= 4) & (F.col("texts") <= 2) & (F.col("dims") == 0) & (b.width > 50) & (b.height > 50)
    role = (
        F.when(frame, "Frame").when(row, "Table")
        .when((F.col("dims") > 0) & (F.col("dims") >= n * 0.60), "Annotation")
        .when((F.col("texts") > 0) & (F.col("texts") >= n * 0.60) & (F.col("meta_hits") >= 1), "Metadata")
        .when((F.col("texts") > 0) & (F.col("unit_kind") != "Loose") & (F.col("texts") >= n * 0.80) & ~flat & (F.col("meta_hits") >= 1), "TitleBlock")
        .when((F.col("geometry") >= n * 0.55) & (F.col("texts") <= n * 0.45) & (F.col("dims") <= n * 0.20), "Geometry").otherwise("Mixed")
    )
    return g.withColumn("role", role)


def representative_units(units: DataFrame) -> DataFrame:
    """Geometry units, one for each set of members: most geometry, purest, largest, fewest
    texts, branches before families before loose ones, then by key."""
    priority = F.when(F.col("unit_kind") == "Branch", 0).when(F.col("unit_kind") == "BlockFamily", 1).otherwise(2)
    rows = units.filter("role = 'Geometry'").withColumn("members", F.array_join(F.col("handles").cast("array<string>"), "|"))
    order = [F.col("geometry").desc(), (F.col("geometry") / F.col("total")).desc(), F.col("total").desc(), F.col("texts"), priority, F.col("unit_key")]
    return best_per(rows, ["sheet_id", "members"], order)


def block_decisions(e: DataFrame) -> DataFrame:
    """Preserve or collapse each block, from the counts of its children."""
    kind = F.col("kind")
    c = e.filter("block_path IS NOT NULL").groupBy("sheet_id", "block_path").agg(
        F.count(F.lit(1)).alias("children"), F.count_if(kind == "BlockReference").alias("blocks"), F.count_if(K.is_geometry(kind)).alias("geometry"),
        F.count_if(K.is_text(kind)).alias("texts"), F.count_if(K.is_dimension(kind)).alias("dims"), F.count_if(kind != "BlockReference").alias("leaves"),
    )
    n = F.col
    reason = (
        F.when((n("children") == 1) & (n("blocks") == 1) & (n("leaves") == 0), "single child wrapper")
        .when((n("children") <= 2) & (n("geometry") == 0) & (n("texts") + n("dims") <= 1), "near empty wrapper")
        .when(n("geometry") >= 3, "enough geometry leaves").when(n("leaves") >= 5, "enough total leaves")
        .when((n("geometry") > 0) & (n("texts") + n("dims") > 0), "mixed geometry and annotation").otherwise("neutral")
    )
    return c.withColumn("reason", reason).withColumn("preserve", ~F.col("reason").isin("single child wrapper", "near empty wrapper"))


def connect_gaps(units: DataFrame) -> DataFrame:
    """Gap at which a sheet's units are packed together: 1.45 times the 65th percentile of
    nearest-neighbour gaps over 1 and up to 120, else 0.12 times the median span, in 8 to 80."""
    u = units.select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y")
    pairs = box_join(u, u, 120.0, 256.0).filter("a_handle != b_handle").withColumn("gap", B.box_distance(B.box("a_"), B.box("b_"))).filter("gap > 1 AND gap <= 120")
    near = pairs.groupBy("sheet_id", "a_handle").agg(F.min("gap").alias("gap")).groupBy("sheet_id").agg((F.percentile("gap", 0.65) * 1.45).alias("near"))
    span = F.greatest(B.box().width, B.box().height)
    spans = units.filter(span > 0).groupBy("sheet_id").agg((F.percentile(span, 0.5) * 0.12).alias("span"))
    gap = F.coalesce("near", "span", F.lit(8.0))
    return units.select("sheet_id").distinct().join(near, "sheet_id", "left").join(spans, "sheet_id", "left").select("sheet_id", F.least(F.lit(80.0), F.greatest(F.lit(8.0), gap)).alias("connect_gap"))


def unit_packs(units: DataFrame) -> DataFrame:
    """Packs of units (sheet_id, handle, box, geometry, meta_hits): boxes or centres within
    the sheet's gap, chained; score 3 per geometry, 5 per unit, -25 per metadata hit, -0.0005
    per area."""
    u = units.select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y")
    a, b = B.box("a_"), B.box("b_")
    pairs = box_join(u, u, 80.0, 256.0).filter("a_handle < b_handle").join(connect_gaps(units), "sheet_id")
    near = B.intersects(a, b, 1.0) | (B.box_distance(a, b) <= F.col("connect_gap")) | (B.point_distance(a.center_x, a.center_y, b.center_x, b.center_y) <= F.col("connect_gap"))
    edges = pairs.filter(near).select("sheet_id", F.col("a_handle").alias("a"), F.col("b_handle").alias("b"))
    g = connected(units, edges).groupBy("sheet_id", F.col("component").alias("pack_id")).agg(
        F.count(F.lit(1)).alias("units"), F.sum("geometry").alias("geometry"), F.sum("meta_hits").alias("meta_hits"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")
    )
    return g.withColumn("score", F.col("geometry") * 3.0 + F.col("units") * 5.0 - F.col("meta_hits") * 25.0 - B.box().area * 0.0005)


def island_semantics(islands: DataFrame) -> DataFrame:
    """Role of islands: geometry view, badge, annotation or unknown, from additive scores.

    Needs the island's box, cells, overlap_dims, texts, numeric_texts, short_texts, geometry,
    curves, closed_curve, bridge and the sheet's box as s_min_x ... s_max_y.
    """
    n, s, b = F.col, B.box("s_"), B.box()
    small = (n("cells") <= 48) | (b.area <= F.greatest(s.area * 0.015, F.lit(1.0)))
    corner = (b.max_y >= s.min_y + s.height * 0.78) & (b.min_x <= s.min_x + s.width * 0.22)
    numeric = (n("texts") > 0) & (n("numeric_texts") >= 1) & (n("short_texts") >= n("texts"))
    rich = (n("geometry") + n("curves") >= 6) | (n("overlap_dims") >= 2)
    when = lambda test, points: F.when(test, points).otherwise(0.0)
    ringed = numeric & n("closed_curve")
    geometry = (
        when(n("overlap_dims") > 0, 3.0) + when(n("overlap_dims") >= 2, 1.5) + when(n("cells") >= 50, 1.0) + when(rich, 1.5)
        + when(n("curves") >= 3, 0.5) + when(small, -1.2) + when(ringed, -1.5)
    )
    badge = (
        when(small, 1.5) + when(corner, 1.0) + when(n("overlap_dims") == 0, 1.0) + when(numeric, 2.0) + when(n("closed_curve"), 2.0)
        + when(n("texts").between(1, 3), 0.7) + when(n("geometry") + n("curves") <= 6, 0.7) + when(n("overlap_dims") >= 2, -1.5)
    )
    note = when(n("texts") >= F.greatest(F.lit(1), n("geometry")), 1.5) + when(n("overlap_dims") == 0, 0.5) + when(n("texts") >= 2, 1.0) + when(ringed, -1.0)
    scored = islands.withColumn("score_geometry", F.round(geometry, 6)).withColumn("score_badge", F.round(badge, 6)).withColumn("score_annotation", F.round(note, 6))
    g, d, a = n("score_geometry"), n("score_badge"), n("score_annotation")
    role = (
        F.when(n("bridge"), "SparseBridge").when((d >= g) & (d >= a) & (d >= 3.0), "BadgeMarker")
        .when((g >= d) & (g >= a) & (g >= 2.5), "GeometryView").when(a >= 2.0, "AnnotationLike").otherwise("Unknown")
    )
    return scored.withColumn("role", role)
