"""Queries of contour seeds, view seeds and promotions, zone merges, masks, parts around dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.operators import contours as C
from drawlake.operators import drawing as D
from drawlake.operators import views as V
from drawlake.operators.spatial import best_per, box_join
from drawlake.plans.grids import _OUT, _proximity
from drawlake.plans.primitives import LINETYPE_SQL, r, with_linetypes
from drawlake.plans.rows import DIM, GEO, SHEETS_SQL, TEXT, has
from drawlake.plans.shapes import block_views, reach
from drawlake.plans.views import CONTENT_SQL, RELATIONS_SQL
from drawlake.sources.drawings import ENTITIES_SQL, entities
from drawlake.sources.primitives import PRIMITIVES_SQL, primitives

ENTRIES: dict = {}


def entry(name: str, sql: str | None, source=entities, head: str = f"{ENTITIES_SQL}, {SHEETS_SQL}, "):
    def register(f):
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(source(spark, sf_dir))), None if sql is None else f"WITH RECURSIVE {head}{sql}"
        return f

    return register


def of_primitives(name: str, sql: str | None):
    return entry(name, sql, primitives, PRIMITIVES_SQL)


@of_primitives("geometry_seeds", " SELECT handle FROM d WHERE CASE kind WHEN 'Line' THEN NOT (abs(sx - ex) <= 1e-9 AND abs(sy - ey) <= 1e-9) WHEN 'Polyline' THEN true WHEN 'Spline' THEN true WHEN 'Circle' THEN radius > 0 WHEN 'Arc' THEN radius > 0 WHEN 'Ellipse' THEN radius > 0 AND radius * ratio > 0 WHEN 'Solid' THEN coalesce(max_x > min_x OR max_y > min_y, false) WHEN 'Point' THEN coalesce(max_x > min_x OR max_y > min_y, false) ELSE false END")
def geometry_seeds(d):
    return C.geometry_seeds(d, C.SeedOptions().without("Hatch")).select("handle")


@of_primitives("contour_sources", f"{LINETYPE_SQL} SELECT handle FROM el WHERE min_x IS NOT NULL AND max_x >= 100 AND min_x <= 700 AND max_y >= 50 AND min_y <= 500 AND kind IN ('Line', 'Polyline', 'Arc', 'Circle', 'Ellipse', 'Face') AND NOT ({has('upper(layer)', *K.FLAG_CENTER, *K.FLAG_HIDDEN, *K.FLAG_TITLE, *K.FLAG_TABLE)} OR {has("upper(coalesce(effective, ''))", *K.FLAG_CENTER, *K.FLAG_HIDDEN)})")
def contour_sources(d):
    """Strokes in the window 100 to 700 by 50 to 500 that may be on a contour."""
    view = B.Box(F.lit(100.0), F.lit(50.0), F.lit(700.0), F.lit(500.0))
    return C.contour_sources(with_linetypes(d), view, F.col("effective")).select("handle")


@of_primitives("outer_seeds", f", x AS (SELECT sheet_id, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM d WHERE kind = 'Line' AND min_x IS NOT NULL GROUP BY sheet_id), q AS (SELECT d.*, x0, y0, x1, y1, greatest(4, least(x1 - x0, y1 - y0) * 0.1) AS band, sqrt(power(ex - sx, 2) + power(ey - sy, 2)) + CASE WHEN {has('upper(trim(layer))', *K.FLAG_CONTOUR)} THEN 400 ELSE 0 END AS score FROM d JOIN x USING (sheet_id) WHERE kind = 'Line' AND min_x IS NOT NULL) SELECT handle, 'Top' AS side, round(score + greatest(0, 100 - abs(y1 - max_y)), 6) AS score FROM q WHERE max_y >= y1 - band UNION ALL SELECT handle, 'Bottom', round(score + greatest(0, 100 - abs(min_y - y0)), 6) FROM q WHERE min_y <= y0 + band UNION ALL SELECT handle, 'Left', round(score + greatest(0, 100 - abs(min_x - x0)), 6) FROM q WHERE min_x <= x0 + band UNION ALL SELECT handle, 'Right', round(score + greatest(0, 100 - abs(x1 - max_x)), 6) FROM q WHERE max_x >= x1 - band")
def outer_seeds(d):
    length = F.sqrt(F.pow(F.col("ex") - F.col("sx"), 2) + F.pow(F.col("ey") - F.col("sy"), 2))
    return C.outer_seeds(d.filter("kind = 'Line' AND min_x IS NOT NULL").withColumn("length", length)).select("handle", "side", r("score"))


# --- views --------------------------------------------------------------------------------------

FLAGS_SQL = f"""vf AS (SELECT v.sheet_id, v.view_id, bool_or(coalesce(e.kind IN {DIM}, false)) AS has_dimension, bool_or(coalesce(contains(e.layer, 'CENTER') AND e.kind IN {GEO}, false)) AS has_center, bool_or(coalesce(e.layer = 'hl' AND e.kind IN {GEO}, false)) AS has_hidden, count(e.handle) FILTER (e.kind IN {GEO}) AS geometry
  FROM v LEFT JOIN e ON e.sheet_id = v.sheet_id AND e.handle <> v.view_id AND e.min_x - 20 <= v.max_x AND v.min_x <= e.max_x + 20 AND e.min_y - 20 <= v.max_y AND v.min_y <= e.max_y + 20 GROUP BY v.sheet_id, v.view_id),
 vs AS (SELECT *, round((CASE WHEN has_dimension THEN 0.35 ELSE 0 END + CASE WHEN has_center THEN 0.55 ELSE 0 END + CASE WHEN has_hidden THEN 0.40 ELSE 0 END + CASE WHEN geometry >= 3 THEN 0.15 ELSE 0 END + 0.10)::DOUBLE, 9) AS seed_score FROM vf)"""


def flagged_views(e):
    """Blocks as views with what lies within 20 of them."""
    v = block_views(e)
    keep = ("sheet_id", "handle", "kind", "layer", "min_x", "min_y", "max_x", "max_y")
    pairs = box_join(v, e.select(*keep), 20.0, 128.0).filter("a_view_id != b_handle")
    kind, layer = F.col("b_kind"), F.col("b_layer")
    geo = K.is_geometry(kind)
    g = pairs.groupBy("sheet_id", F.col("a_view_id").alias("view_id")).agg(
        F.bool_or(K.is_dimension(kind)).alias("has_dimension"), F.bool_or(geo & F.contains(layer, F.lit("CENTER"))).alias("has_center"), F.bool_or(geo & (layer == "hl")).alias("has_hidden"), F.count_if(geo).alias("geometry")
    )
    x = v.join(g, ["sheet_id", "view_id"], "left").na.fill(0, ["geometry"]).na.fill(False, ["has_dimension", "has_center", "has_hidden"])
    return C.seed_scores(x.withColumn("is_bridge", F.lit(False)))


@entry("view_seeds", f"v AS (SELECT sheet_id, handle AS view_id, min_x, min_y, max_x, max_y FROM e WHERE kind = 'BlockReference'), {FLAGS_SQL} SELECT view_id, seed_score, seed_score >= 0.75 AS is_seed FROM vs")
def view_seeds(e):
    return flagged_views(e).select("view_id", "seed_score", "is_seed")


def both_ways(e):
    """Relations of all ordered pairs."""
    v = block_views(e)
    forth = V.relations(v)
    # Seen from the other side a view lies on the other one.
    swap = {c: c.replace("a_", "t_", 1) if c.startswith("a_") else c.replace("b_", "a_", 1) if c.startswith("b_") else c for c in forth.columns}
    back = forth.select(*[F.col(c).alias(swap[c].replace("t_", "b_", 1) if swap[c].startswith("t_") else swap[c]) for c in forth.columns])
    turned = F.create_map(*[F.lit(x) for x in ("Left", "Right", "Right", "Left", "Above", "Below", "Below", "Above", "Overlapping", "Overlapping")])[F.col("position")]
    return forth.unionByName(back.withColumn("position", turned))


_PROMOTED = """round((CASE WHEN in_row THEN 0.20 ELSE 0 END + CASE WHEN in_column THEN 0.20 ELSE 0 END + CASE WHEN wl >= 0.45 AND hl >= 0.45 AND al >= 0.20 THEN 0.20 ELSE 0 END + CASE WHEN aw * ah > 1e-9 AND bw * bh >= 0.20 * (aw * ah) THEN 0.15 ELSE 0 END + CASE WHEN least(bw, bh) > 0 AND greatest(bw, bh) / nullif(least(bw, bh), 0) <= 8 THEN 0.10 ELSE 0 END
  + CASE WHEN c.has_center THEN 0.20 ELSE 0 END + CASE WHEN c.has_hidden THEN 0.15 ELSE 0 END + CASE WHEN t.has_center AND c.has_center THEN 0.10 ELSE 0 END + CASE WHEN t.has_hidden AND c.has_hidden THEN 0.08 ELSE 0 END + CASE WHEN c.has_dimension THEN 0.15 ELSE 0 END + CASE position WHEN 'Below' THEN 0.15 WHEN 'Above' THEN 0.05 ELSE 0 END)::DOUBLE, 9)"""


@entry("view_promotions", f"""{RELATIONS_SQL}, {FLAGS_SQL}, dr AS (SELECT sheet_id, a, b, aw, ah, bw, bh, in_row, in_column, wl, hl, al, relation, position FROM rr UNION ALL SELECT sheet_id, b, a, bw, bh, aw, ah, in_row, in_column, wl, hl, al, relation, CASE position WHEN 'Left' THEN 'Right' WHEN 'Right' THEN 'Left' WHEN 'Above' THEN 'Below' WHEN 'Below' THEN 'Above' ELSE position END FROM rr),
 pm AS (SELECT dr.*, {_PROMOTED} AS score FROM dr JOIN vs t ON t.view_id = dr.a AND t.seed_score >= 0.75 JOIN vs c ON c.view_id = dr.b AND c.seed_score < 0.75 WHERE relation NOT IN ('EmbeddedFeature', 'ParentChildContainment')),
 bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS k FROM pm) WHERE k = 1)
 SELECT vs.view_id, bp.a AS source_id, coalesce(score, 0) AS score, bp.position, coalesce(score >= 0.55, false) AS promoted FROM vs LEFT JOIN bp ON bp.b = vs.view_id WHERE seed_score < 0.75""")  # fmt: skip
def view_promotions(e):
    return C.promotions(flagged_views(e), both_ways(e)).select("view_id", "source_id", "score", "position", "promoted")


@entry("preferred_regions", f"{CONTENT_SQL} SELECT sheet_id, region_id FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY CASE WHEN region_id = 'title-bottom' THEN 0 ELSE 1 END, round(confidence, 9) DESC, (max_x - min_x) * (max_y - min_y), region_id) AS k FROM cr WHERE region_id = 'title-bottom' OR region_kind = 'Geometry') WHERE k = 1")
def preferred_regions(e):
    """The title band of each sheet, else its region of geometry."""
    found = V.content_regions(e).filter("region_id = 'title-bottom' OR region_kind = 'Geometry'")
    by_name = F.when(F.col("region_id") == "title-bottom", 0).otherwise(1)
    return best_per(found, ["sheet_id"], [by_name, F.round("confidence", 9).desc(), B.box().area, F.col("region_id")]).select("sheet_id", "region_id")


@entry("merged_zones", None)
def merged_zones(e):
    """Blocks as zones of their layer; joining in order has no SQL, tested against plain loops."""
    b = B.box()
    return C.merged_zones(e.filter("kind = 'BlockReference'").withColumn("zone_id", F.col("handle")).withColumn("zone_kind", F.col("layer")).withColumn("score", b.area))


# --- masks --------------------------------------------------------------------------------------

PIXELS_SQL = "px AS (SELECT DISTINCT sheet_id, row, unnest(range(CAST(floor(min_x / 8) AS BIGINT), CAST(floor(max_x / 8) AS BIGINT) + 1)) AS col FROM (SELECT *, unnest(range(CAST(floor(min_y / 8) AS BIGINT), CAST(floor(max_y / 8) AS BIGINT) + 1)) AS row FROM e WHERE kind IN ('Polyline', 'Circle')))"
MASK_SQL = f"""{PIXELS_SQL}, pn AS (SELECT *, row * 4294967296 + 2147483648 + col AS handle FROM px), pe AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM pn a JOIN pn b ON a.sheet_id = b.sheet_id AND a.handle < b.handle AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1), {reach('pn', 'pe', 'pi')},
 mi AS (SELECT pi.sheet_id, component AS island, count(*) AS area, min(col) AS x, min(row) AS y, max(col) - min(col) + 1 AS width, max(row) - min(row) + 1 AS height FROM pi JOIN pn USING (sheet_id, handle) GROUP BY pi.sheet_id, component)"""


def pixels(e):
    """The 8-unit pixels that polylines and circles cover."""
    at = lambda c: F.floor(F.col(c) / 8)
    cells = e.filter("kind IN ('Polyline', 'Circle')").withColumn("row", F.explode(F.sequence(at("min_y"), at("max_y")))).withColumn("col", F.explode(F.sequence(at("min_x"), at("max_x"))))
    return cells.select("sheet_id", "row", "col").distinct()


@entry("mask_islands", f"{MASK_SQL} SELECT sheet_id, island, area, x, y, width, height FROM mi WHERE area >= 4")
def mask_islands(e):
    return C.mask_islands(pixels(e)).filter("area >= 4").select("sheet_id", "island", "area", "x", "y", "width", "height")


@entry("mask_hints", f"{MASK_SQL}, ch AS (SELECT a.sheet_id, a.island, count(b.handle) AS children FROM mi a LEFT JOIN e b ON b.sheet_id = a.sheet_id AND b.kind IN ('Polyline', 'Circle') AND floor(b.ax / 8) BETWEEN a.x AND a.x + a.width - 1 AND floor(b.ay / 8) BETWEEN a.y AND a.y + a.height - 1 GROUP BY a.sheet_id, a.island) SELECT sheet_id, island, children, CASE WHEN width / height > 3 THEN 'LongRowSheetCollection' WHEN width > 20 AND height > 20 THEN 'SingleOuterFrameOrFramedClusters' WHEN children >= 5 THEN 'InternalContentClusters' ELSE 'InternalContentCluster' END AS hint FROM mi JOIN ch USING (sheet_id, island)")
def mask_hints(e):
    """What islands of a mask look like; anchors of shapes in an island's box are its children."""
    x = C.mask_islands(pixels(e))
    box = x.select("sheet_id", "island", F.col("x").cast("double").alias("min_x"), F.col("y").cast("double").alias("min_y"), (F.col("x") + F.col("width") - 1).cast("double").alias("max_x"), (F.col("y") + F.col("height") - 1).cast("double").alias("max_y"))
    at = lambda c: F.floor(F.col(c) / 8).cast("double")
    points = e.filter("kind IN ('Polyline', 'Circle')").select("sheet_id", "handle", at("ax").alias("min_x"), at("ay").alias("min_y"), at("ax").alias("max_x"), at("ay").alias("max_y"))
    n = box_join(box, points, 0.0, 32.0).groupBy("sheet_id", F.col("a_island").alias("island")).agg(F.count(F.lit(1)).alias("children"))
    x = x.join(n, ["sheet_id", "island"], "left").na.fill(0, ["children"])
    return C.cluster_hints(x, F.lit(50), F.lit(50)).select("sheet_id", "island", "children", "hint")


@entry("hit_islands", f"""cb AS (SELECT sheet_id, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM e WHERE kind IN ('Circle', 'Arc') GROUP BY sheet_id), hc AS (SELECT DISTINCT e.sheet_id, CAST(rr.r AS INTEGER) AS row, CAST(cc.c AS INTEGER) AS col FROM e JOIN cb USING (sheet_id), range(20) rr(r), range(30) cc(c) WHERE kind IN ('Circle', 'Arc') AND x1 > x0 AND y1 > y0
  AND rr.r BETWEEN least(19, floor((min_y - y0) / ((y1 - y0) / 20))) AND least(19, floor((max_y - y0) / ((y1 - y0) / 20))) AND cc.c BETWEEN least(29, floor((min_x - x0) / ((x1 - x0) / 30))) AND least(29, floor((max_x - x0) / ((x1 - x0) / 30)))),
 hn AS (SELECT *, CAST(row * 30 + col AS BIGINT) AS handle FROM hc), he AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM hn a JOIN hn b ON a.sheet_id = b.sheet_id AND a.handle < b.handle AND abs(a.row - b.row) + abs(a.col - b.col) = 1), {reach('hn', 'he', 'hi')}
 SELECT hi.sheet_id, component AS island, count(*) AS cells, min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col FROM hi JOIN hn USING (sheet_id, handle) GROUP BY hi.sheet_id, component""")  # fmt: skip
def hit_islands(e):
    return D.grid_islands(D.occupied_cells(e.filter("kind IN ('Circle', 'Arc')")))


# --- parts --------------------------------------------------------------------------------------


@entry("dimension_parts", f"""dm AS (SELECT * FROM e WHERE kind IN {DIM}), {_proximity('dm', 150.0, 'dc')}, db AS (SELECT dc.sheet_id, component AS dimensions, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM dc JOIN dm USING (sheet_id, handle) GROUP BY ALL),
 om AS (SELECT {{'s': e.sheet_id, 'd': dimensions}} AS sheet_id, handle, min_x, min_y, max_x, max_y FROM db JOIN e ON e.sheet_id = db.sheet_id AND e.kind IN {_OUT} AND min_x <= x1 AND x0 <= max_x AND min_y <= y1 AND y0 <= max_y), {_proximity('om', 60.0, 'oc')}
 SELECT oc.sheet_id['s'] AS sheet_id, oc.sheet_id['d'] AS dimensions, component AS part, count(*) AS n FROM oc JOIN om ON om.sheet_id = oc.sheet_id AND om.handle = oc.handle GROUP BY oc.sheet_id, component HAVING count(*) >= 2""")  # fmt: skip
def dimension_parts(e):
    return C.dimension_parts(e, 150.0, 60.0)


@entry("part_inventory", f"tx AS (SELECT p.sheet_id, p.handle AS part_id, t.text FROM e p JOIN e t ON t.sheet_id = p.sheet_id AND t.kind IN {TEXT} AND t.ax BETWEEN p.min_x AND p.max_x AND t.ay BETWEEN p.min_y AND p.max_y WHERE p.kind = 'Polyline'), g AS (SELECT sheet_id, part_id, string_agg(text, ' | ' ORDER BY text) AS texts FROM tx GROUP BY ALL) SELECT e.sheet_id, e.handle AS part_id, CASE WHEN texts IS NULL THEN 'None' ELSE 'Inclusion' END AS status, coalesce(texts, '') AS texts FROM e LEFT JOIN g ON g.sheet_id = e.sheet_id AND g.part_id = e.handle WHERE kind = 'Polyline'")
def part_inventory(e):
    """Polylines as parts, with the texts that they hold."""
    box = e.filter("kind = 'Polyline'").select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y")
    points = e.filter(K.is_text(F.col("kind"))).select("sheet_id", "text", F.col("ax").alias("min_x"), F.col("ay").alias("min_y"), F.col("ax").alias("max_x"), F.col("ay").alias("max_y"))
    held = box_join(box, points, 0.0, 64.0).groupBy("sheet_id", F.col("a_handle").alias("handle")).agg(F.array_join(F.array_sort(F.collect_list("b_text")), " | ").alias("texts"))
    x = box.select("sheet_id", "handle").join(held, ["sheet_id", "handle"], "left")
    return x.select("sheet_id", F.col("handle").alias("part_id"), F.when(F.col("texts").isNull(), "None").otherwise("Inclusion").alias("status"), F.coalesce("texts", F.lit("")).alias("texts"))


@entry("containment_tree", """p AS (SELECT a.sheet_id, a.handle, b.handle AS parent, row_number() OVER (PARTITION BY a.sheet_id, a.handle ORDER BY (b.max_x - b.min_x) * (b.max_y - b.min_y), b.handle) AS k FROM e a JOIN e b ON a.sheet_id = b.sheet_id AND a.handle <> b.handle WHERE a.min_x >= b.min_x AND a.max_x <= b.max_x AND a.min_y >= b.min_y AND a.max_y <= b.max_y AND (b.max_x - b.min_x) * (b.max_y - b.min_y) > (a.max_x - a.min_x) * (a.max_y - a.min_y)),
 q AS (SELECT e.sheet_id, e.handle, parent FROM e LEFT JOIN p ON p.sheet_id = e.sheet_id AND p.handle = e.handle AND k = 1) SELECT sheet_id, coalesce(CAST(parent AS VARCHAR), 'ROOT') AS parent, count(*) AS children FROM q GROUP BY ALL""")  # fmt: skip
def containment_tree(e):
    """How many nodes each node holds at once; the root holds what nothing else does."""
    k = e.select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y")
    a, b = B.box("a_"), B.box("b_")
    pairs = box_join(k, k).filter((F.col("a_handle") != F.col("b_handle")) & B.contains_box(b, a) & (b.area > a.area)).withColumn("_area", b.area)
    parents = best_per(pairs, ["sheet_id", "a_handle"], [F.col("_area"), F.col("b_handle")]).select("sheet_id", F.col("a_handle").alias("handle"), F.col("b_handle").alias("parent"))
    tree = k.select("sheet_id", "handle").join(parents, ["sheet_id", "handle"], "left")
    return tree.groupBy("sheet_id", F.coalesce(F.col("parent").cast("string"), F.lit("ROOT")).alias("parent")).agg(F.count(F.lit(1)).alias("children"))
