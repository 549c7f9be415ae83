"""Row-wise queries: geometry, classes and texts of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import cadtext as T
from drawlake.functions import kinds as K
from drawlake.operators import drawing as D
from drawlake.operators.spatial import prefixed
from drawlake.sources.drawings import ENTITIES_SQL, entities

ENTRIES: dict = {}
TEXT = "('Text', 'MText', 'InsertAttribute')"
DIM = "('Dimension', 'Leader')"
GEO = "('Line', 'Polyline', 'Arc', 'Circle', 'Ellipse', 'Hatch', 'Solid', 'Face', 'Point', 'Spline', 'Region')"
SHEETS_SQL = "s AS (SELECT sheet_id, min(min_x) AS s_min_x, min(min_y) AS s_min_y, max(max_x) AS s_max_x, max(max_y) AS s_max_y FROM e GROUP BY sheet_id)"


def entry(name: str, sql: str | None):
    """Register a query over entities with its SQL, which may use e and s."""

    def register(f):
        text = None if sql is None else f"WITH {ENTITIES_SQL}, {SHEETS_SQL} {sql}"
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(entities(spark, sf_dir))), text
        return f

    return register


def has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@entry("entities_scan", "SELECT sheet_id, handle, kind, layer, min_x, min_y, max_x, max_y, text, block_path, depth FROM e")
def entities_scan(e):
    return e.select("sheet_id", "handle", "kind", "layer", "min_x", "min_y", "max_x", "max_y", "text", "block_path", "depth")


@entry("kind_predicates", f"SELECT handle, kind IN {TEXT} AS is_text, kind IN {DIM} AS is_dimension, kind IN {GEO} AS is_geometry FROM e")
def kind_predicates(e):
    k = F.col("kind")
    return e.select("handle", K.is_text(k).alias("is_text"), K.is_dimension(k).alias("is_dimension"), K.is_geometry(k).alias("is_geometry"))


@entry("typed_scan", "SELECT handle, layer FROM e WHERE kind IN ('Line', 'Polyline') AND layer <> 'hl'")
def typed_scan(e):
    return e.filter(F.col("kind").isin("Line", "Polyline") & (F.col("layer") != "hl")).select("handle", "layer")


@entry("window_count", "SELECT sheet_id, count(*) AS n FROM e WHERE min_x <= 400 AND max_x >= 100 AND min_y <= 300 AND max_y >= 50 AND kind = 'Line' GROUP BY sheet_id")
def window_count(e):
    window = B.Box(F.lit(100.0), F.lit(50.0), F.lit(400.0), F.lit(300.0))
    return e.filter((F.col("kind") == "Line") & B.intersects(B.box(), window)).groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n"))


@entry("without_dimensions", "SELECT handle, kind FROM e WHERE kind <> 'Dimension'")
def without_dimensions(e):
    return e.filter("kind != 'Dimension'").select("handle", "kind")


@entry("box_measures", "SELECT handle, max_x - min_x AS width, max_y - min_y AS height, (max_x - min_x) * (max_y - min_y) AS area, (min_x + max_x) * 0.5 AS cx, (min_y + max_y) * 0.5 AS cy, round(sqrt((max_x - min_x) * (max_x - min_x) + (max_y - min_y) * (max_y - min_y)), 6) AS diagonal FROM e")
def box_measures(e):
    b = B.box()
    return e.select("handle", b.width.alias("width"), b.height.alias("height"), b.area.alias("area"), b.center_x.alias("cx"), b.center_y.alias("cy"), F.round(b.diagonal, 6).alias("diagonal"))


@entry("box_inflate_deflate", """SELECT handle, min_x - 3 AS i_min_x, max_y + 3 AS i_max_y,
  CASE WHEN min_x + 10 > max_x - 10 THEN (min_x + max_x) * 0.5 ELSE min_x + 10 END AS d_min_x, CASE WHEN min_x + 10 > max_x - 10 THEN (min_x + max_x) * 0.5 ELSE max_x - 10 END AS d_max_x,
  CASE WHEN min_y + 10 > max_y - 10 THEN (min_y + max_y) * 0.5 ELSE min_y + 10 END AS d_min_y, CASE WHEN min_y + 10 > max_y - 10 THEN (min_y + max_y) * 0.5 ELSE max_y - 10 END AS d_max_y FROM e""")  # fmt: skip
def box_inflate_deflate(e):
    i, d = B.inflated(B.box(), 3.0), B.deflated(B.box(), 10.0)
    return e.select("handle", i.min_x.alias("i_min_x"), i.max_y.alias("i_max_y"), *[c.alias(f"d_{n}") for n, c in zip(B.Box._fields, d, strict=True)])


PAIRS_SQL = "p AS (SELECT a.sheet_id, a.handle AS a_handle, b.handle AS b_handle, a.min_x AS ax0, a.min_y AS ay0, a.max_x AS ax1, a.max_y AS ay1, b.min_x AS bx0, b.min_y AS by0, b.max_x AS bx1, b.max_y AS by1 FROM e a JOIN e b ON a.sheet_id = b.sheet_id AND a.handle < b.handle WHERE a.kind = 'Circle' AND b.kind = 'Polyline')"


def circle_pairs(e):
    c = e.select("sheet_id", "handle", "kind", "min_x", "min_y", "max_x", "max_y")
    return prefixed(c.filter("kind = 'Circle'"), "a_").join(prefixed(c.filter("kind = 'Polyline'"), "b_"), "sheet_id").filter("a_handle < b_handle")


@entry("pair_overlaps", f""", {PAIRS_SQL}, q AS (SELECT *, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS common,
  (ax1 - ax0) * (ay1 - ay0) AS aa, (bx1 - bx0) * (by1 - by0) AS ba FROM p)
SELECT a_handle, b_handle, common, CASE WHEN common > 0 AND least(aa, ba) > 0 THEN round(common / least(aa, ba), 6) ELSE 0.0 END AS of_smaller,
  CASE WHEN aa + ba - common > 0 THEN round(common / (aa + ba - common), 6) ELSE 0.0 END AS iou FROM q""")  # fmt: skip
def pair_overlaps(e):
    a, b = B.box("a_"), B.box("b_")
    return circle_pairs(e).select("a_handle", "b_handle", B.intersection_area(a, b).alias("common"), F.round(B.overlap_of_smaller(a, b), 6).alias("of_smaller"), F.round(B.intersection_over_union(a, b), 6).alias("iou"))


@entry("pair_projection", f""", {PAIRS_SQL}, q AS (SELECT *, greatest(0, bx0 - ax1, ax0 - bx1) AS gx, greatest(0, by0 - ay1, ay0 - by1) AS gy, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) AS ox, least(ax1 - ax0, bx1 - bx0) AS mx,
  sqrt((ax1 - ax0) * (ax1 - ax0) + (ay1 - ay0) * (ay1 - ay0)) AS da, sqrt((bx1 - bx0) * (bx1 - bx0) + (by1 - by0) * (by1 - by0)) AS db FROM p)
SELECT a_handle, b_handle, gx, gy, CASE WHEN mx > 1e-9 THEN round(ox / mx, 6) ELSE 0.0 END AS x_overlap, round(sqrt(gx * gx + gy * gy), 6) AS distance, round(greatest(gx, gy) / greatest(1e-9, least(da, db)), 4) AS gap FROM q""")  # fmt: skip
def pair_projection(e):
    a, b = B.box("a_"), B.box("b_")
    return circle_pairs(e).select(
        "a_handle", "b_handle", B.gap_x(a, b).alias("gx"), B.gap_y(a, b).alias("gy"), F.round(B.x_overlap_ratio(a, b), 6).alias("x_overlap"),
        F.round(B.box_distance(a, b), 6).alias("distance"), F.round(B.normalized_gap(a, b), 4).alias("gap"),
    )


@entry("sheet_bounds", "SELECT sheet_id, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, count(*) AS n FROM e GROUP BY sheet_id")
def sheet_bounds(e):
    return D.sheet_bounds(e)


@entry("snapshot_key", "SELECT handle, concat_ws('|', 'E', CAST(handle AS VARCHAR), concat('D', depth), kind, coalesce(block_path, '')) AS snapshot_key FROM e")
def snapshot_key(e):
    return e.select("handle", F.concat_ws("|", F.lit("E"), "handle", F.concat(F.lit("D"), "depth"), "kind", F.coalesce("block_path", F.lit(""))).alias("snapshot_key"))


@entry("ghosts", """SELECT e.handle, CASE WHEN max_x - min_x <= 1e-9 AND max_y - min_y <= 1e-9 AND depth > 0
  AND (ax < s_min_x + 300 OR ay > s_max_y - 100) THEN 'ghost' ELSE 'kept' END AS verdict FROM e JOIN s USING (sheet_id)""")  # fmt: skip
def ghosts(e):
    point = (F.col("max_x") - F.col("min_x") <= 1e-9) & (F.col("max_y") - F.col("min_y") <= 1e-9) & (F.col("depth") > 0)
    far = (F.col("ax") < F.col("s_min_x") + 300) | (F.col("ay") > F.col("s_max_y") - 100)
    return D.with_sheet(e).select("handle", F.when(point & far, "ghost").otherwise("kept").alias("verdict"))


@entry("role_of_type", """SELECT handle, CASE lower(kind) WHEN 'text' THEN 'Text' WHEN 'mtext' THEN 'Text' WHEN 'dimension' THEN 'Dimension' WHEN 'leader' THEN 'Leader' WHEN 'circle' THEN 'Geometry'
  WHEN 'arc' THEN 'Geometry' WHEN 'polyline' THEN 'Geometry' WHEN 'line' THEN 'Geometry' WHEN 'blockreference' THEN 'BlockContainer' WHEN 'hatch' THEN 'HatchLike' ELSE 'Unknown' END AS role FROM e""")  # fmt: skip
def role_of_type(e):
    return e.select("handle", K.role_of_type(F.col("kind")).alias("role"))


@entry("seed_kind", "SELECT handle, CASE WHEN kind IN ('Circle', 'Arc', 'Polyline', 'Line', 'Hatch') THEN 'CoreGeometry' ELSE 'AttachLater' END AS seed FROM e")
def seed_kind(e):
    return e.select("handle", K.seed_kind(F.col("kind")).alias("seed"))


@entry("scene_bucket", f"SELECT handle, CASE WHEN kind IN {DIM} THEN 'Annotation' WHEN kind IN {TEXT} OR kind = 'BlockReference' THEN 'Metadata' WHEN kind IN {GEO} THEN 'GeometryCore' ELSE 'Unknown' END AS bucket FROM e")
def scene_bucket(e):
    return e.select("handle", K.scene_bucket(F.col("kind")).alias("bucket"))


@entry("scene_partition", f"SELECT sheet_id, CASE WHEN kind IN {DIM} THEN 'Annotation' WHEN kind IN {TEXT} OR kind = 'BlockReference' THEN 'Metadata' WHEN kind IN {GEO} THEN 'GeometryCore' ELSE 'Unknown' END AS bucket, count(*) AS n FROM e GROUP BY ALL")
def scene_partition(e):
    return e.groupBy("sheet_id", K.scene_bucket(F.col("kind")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@entry("stroke_semantic", f"""SELECT handle, CASE WHEN kind IN {TEXT} OR kind IN {DIM} THEN 'Annotation' WHEN kind NOT IN {GEO} THEN 'Unknown'
  WHEN {has("upper(layer)", *K.STROKE_CENTER)} THEN 'Center' WHEN {has("upper(layer)", *K.STROKE_HIDDEN)} THEN 'Hidden' WHEN {has("upper(layer)", *K.STROKE_NOTE)} THEN 'Annotation' ELSE 'VisibleOutline' END AS stroke FROM e""")  # fmt: skip
def stroke_semantic(e):
    return e.select("handle", K.stroke_semantic(F.col("kind"), F.col("layer"), F.col("block_name"), F.col("text")).alias("stroke"))


@entry("semantic_flags", f"SELECT handle, {has('upper(layer)', *K.FLAG_CENTER)} AS is_center_line, {has('upper(layer)', *K.FLAG_HIDDEN)} AS is_hidden_line, {has('upper(layer)', *K.FLAG_TITLE)} AS is_title_layer, {has('upper(layer)', *K.FLAG_TABLE)} AS is_table_layer, {has('upper(layer)', *K.FLAG_CONTOUR)} AS is_contour_layer, {has('upper(layer)', *K.FLAG_TITLE, *K.FLAG_TABLE)} AS is_noise FROM e")
def semantic_flags(e):
    return e.select("handle", *[c.alias(n) for n, c in K.semantic_flags(F.col("layer")).items()])


@entry("normalize_text", r"SELECT handle, trim(regexp_replace(replace(replace(text, ':', '%%U\P'), '%%U\P', ' : '), ' {2,}', ' ', 'g')) AS clean FROM e WHERE text IS NOT NULL")
def normalize_text(e):
    raw = F.replace("text", F.lit(":"), F.lit("%%U\\P:\\P"))
    return e.filter("text IS NOT NULL").select("handle", T.normalize_cad_text(raw).alias("clean"))


@entry("strip_format_codes", "SELECT handle, text AS clean FROM e WHERE text IS NOT NULL")
def strip_format_codes(e):
    raw = F.concat(F.lit("{\\Fromans;"), "text", F.lit("}"))
    return e.filter("text IS NOT NULL").select("handle", T.strip_format_codes(raw).alias("clean"))


@entry("inline_quantity", r"""SELECT handle, CASE WHEN regexp_matches(text, '^QTY: ') THEN CAST(substr(text, 6) AS INTEGER) WHEN regexp_matches(text, '^\d+ EA$') THEN CAST(string_split(text, ' ')[1] AS INTEGER) END AS quantity,
  CASE WHEN regexp_matches(text, '^QTY: ') THEN 'label' WHEN regexp_matches(text, '^\d+ EA$') THEN 'unit' END AS rule FROM e WHERE text IS NOT NULL""")  # fmt: skip
def inline_quantity(e):
    q, r = T.quantity_rules(F.col("text"))
    return e.filter("text IS NOT NULL").select("handle", q.alias("quantity"), r.alias("rule"))


@entry("standalone_quantity", r"SELECT handle, nullif(CASE WHEN regexp_matches(text, '^\d+ EA$') THEN CAST(string_split(text, ' ')[1] AS INTEGER) END, 0) AS quantity FROM e WHERE text IS NOT NULL")
def standalone_quantity(e):
    return e.filter("text IS NOT NULL").select("handle", T.standalone_quantity(F.col("text")).alias("quantity"))


@entry("engineering_text", r"SELECT handle, (" + has("upper(text)", *T.NOT_QTY) + r" OR regexp_matches(text, '^\s*\d+\s*[-].+$')) AS is_engineering FROM e WHERE text IS NOT NULL")
def engineering_text(e):
    return e.filter("text IS NOT NULL").select("handle", T.is_engineering_text(F.col("text")).alias("is_engineering"))


@entry("part_attributes", r"SELECT sheet_id, upper(regexp_extract(string_agg(text, ' | ' ORDER BY text), '(?i)(SS400|SUS\d+|AL|SM45C|S\d+C|SPCC|SHP|GI|STS\d+)', 0)) AS material FROM e WHERE text LIKE 'MATERIAL%' GROUP BY sheet_id")
def part_attributes(e):
    """By substring, so the word MATERIAL itself reads as the metal AL."""
    joined = e.filter("text LIKE 'MATERIAL%'").groupBy("sheet_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " | ").alias("t"))
    return joined.select("sheet_id", T.part_attributes(F.col("t"))["material"].alias("material"))


@entry("attribute_quantity", r"""SELECT handle, CAST(coalesce(CASE WHEN regexp_matches(text, '^\d+ EA$') THEN string_split(text, ' ')[1] END, '1') AS BIGINT) AS quantity, CASE WHEN regexp_matches(text, '\d\s*T') THEN 1.0 ELSE 0.0 END AS thickness FROM e WHERE text IS NOT NULL""")
def attribute_quantity(e):
    p = T.part_attributes(F.col("text"))
    return e.filter("text IS NOT NULL").select("handle", p["quantity"].alias("quantity"), p["thickness"].alias("thickness"))


@entry("meta_text_tests", f"""SELECT handle, {has("upper(trim(text))", *T.META_LABELS)} AS is_label,
  NOT {has("upper(trim(text))", *T.META_LABELS)} AND regexp_matches(upper(trim(text)), '^[A-Z0-9\\-\\._/ ]{{1,40}}$') AS is_value FROM e WHERE text IS NOT NULL""")  # fmt: skip
def meta_text_tests(e):
    t = K.plain(F.col("text"))
    return e.filter("text IS NOT NULL").select("handle", T.is_meta_label(t).alias("is_label"), T.is_meta_value(t).alias("is_value"))


@entry("measured_value", r"SELECT handle, CAST(nullif(regexp_extract(text, '[-+]?\d+(\.\d+)?', 0), '') AS DOUBLE) AS measured FROM e WHERE text IS NOT NULL")
def measured_value(e):
    return e.filter("text IS NOT NULL").select("handle", T.measured_value(F.col("text")).alias("measured"))


@entry("digits_or_one", "SELECT handle, coalesce(TRY_CAST(nullif(regexp_replace(text, '[^0-9]', '', 'g'), '') AS INTEGER), 1) AS quantity FROM e WHERE text IS NOT NULL")
def digits_or_one(e):
    return e.filter("text IS NOT NULL").select("handle", T.digits_or_one(F.col("text")).alias("quantity"))


@entry("keyword_hits", "SELECT sheet_id, max(CASE WHEN contains(text, 'MATERIAL') THEN 1 ELSE 0 END) + max(CASE WHEN contains(text, 'SCALE') THEN 1 ELSE 0 END) + max(CASE WHEN contains(text, 'REMARK') THEN 1 ELSE 0 END) AS by_keyword, CAST(count(*) FILTER (contains(text, 'MATERIAL') OR contains(text, 'SCALE') OR contains(text, 'REMARK')) AS BIGINT) AS by_text FROM e WHERE text IS NOT NULL GROUP BY sheet_id")
def keyword_hits(e):
    words = ("MATERIAL", "SCALE", "REMARK")
    each = [F.max(F.when(F.contains("text", F.lit(w)), 1).otherwise(0)) for w in words]
    return e.filter("text IS NOT NULL").groupBy("sheet_id").agg((each[0] + each[1] + each[2]).alias("by_keyword"), F.count_if(K.mentions(F.col("text"), words)).alias("by_text"))


@entry("dimension_semantics", "SELECT handle, CASE WHEN max_x - min_x > (max_y - min_y) * 1.25 THEN 'Horizontal' WHEN max_y - min_y > (max_x - min_x) * 1.25 THEN 'Vertical' ELSE 'Unknown' END AS orientation, 'Linear' AS dimension_kind FROM e WHERE kind = 'Dimension'")
def dimension_semantics(e):
    return D.dimension_semantics(e).select("handle", "orientation", "dimension_kind")


@entry("seed_filter", """SELECT handle FROM (SELECT *, greatest(max_x - min_x, max_y - min_y) AS mx, greatest(least(max_x - min_x, max_y - min_y), 0.001) AS mn,
  sqrt((s_max_x - s_min_x) * (s_max_x - s_min_x) + (s_max_y - s_min_y) * (s_max_y - s_min_y)) AS diag FROM e JOIN s USING (sheet_id))
WHERE kind IN ('Line', 'Polyline', 'Arc', 'Circle', 'Ellipse') AND lower(layer) NOT IN ('cl', 'hl', 'd') AND NOT (max_x - min_x <= 0.5 AND max_y - min_y <= 0.5)
  AND NOT (kind = 'Line' AND (mx >= diag * 0.18 OR (mx >= mn * 40 AND mx >= diag * 0.03))) AND NOT (kind = 'Polyline' AND (mx >= diag * 0.20 OR (mx >= mn * 25 AND mx >= diag * 0.05)))""")  # fmt: skip
def seed_filter(e):
    return D.seed_filter(e).select("handle")


@entry("table_border_like", "SELECT handle, kind IN ('Line', 'Polyline') AND greatest(max_x - min_x, max_y - min_y) > 0 AND (least(max_x - min_x, max_y - min_y) = 0 OR greatest(max_x - min_x, max_y - min_y) >= least(max_x - min_x, max_y - min_y) * 8) AS is_border FROM e")
def table_border_like(e):
    return e.select("handle", D.is_table_border(F.col("kind")).alias("is_border"))


@entry("arc_points", "SELECT handle, round(ax + (max_x - min_x) * 0.5 * cos(radians(handle % 360)), 6) AS x, round(ay + (max_x - min_x) * 0.5 * sin(radians(handle % 360)), 6) AS y, CAST((handle % 90 - handle % 360 + 360) % 360 AS DOUBLE) AS sweep, round((max_x - min_x) * 0.5 * radians(handle % 360), 6) AS arc_length FROM e WHERE kind = 'Arc'")
def arc_points(e):
    r, deg = (F.col("max_x") - F.col("min_x")) * 0.5, (F.col("handle") % 360).cast("double")
    p = B.arc_point(F.col("ax"), F.col("ay"), r, deg)
    return e.filter("kind = 'Arc'").select("handle", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"), B.normalized_sweep(deg, (F.col("handle") % 90).cast("double")).alias("sweep"), F.round(B.arc_length(r, deg), 6).alias("arc_length"))


@entry("polygon_measures", "SELECT handle, (max_x - min_x) * (max_y - min_y) * 0.5 AS area, (max_x > min_x AND max_y > min_y) AS corner_inside FROM e WHERE kind = 'Polyline'")
def polygon_measures(e):
    b = B.box()
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corner = F.array(point(b.min_x, b.min_y), point(b.max_x, b.min_y), point(b.min_x, b.max_y))
    rows = e.filter("kind = 'Polyline'").withColumn("points", corner)
    inside = B.point_in_polygon(F.col("points"), b.min_x + b.width * 0.25, b.min_y + b.height * 0.25)
    return rows.select("handle", B.polygon_area(F.col("points")).alias("area"), inside.alias("corner_inside"))


@entry("ellipse_perimeter", "SELECT handle, round(pi() * (3.0 * (a + b) - sqrt((3.0 * a + b) * (a + 3.0 * b))), 6) AS perimeter FROM (SELECT handle, (max_x - min_x) * 0.5 AS a, (max_y - min_y) * 0.5 AS b FROM e WHERE kind = 'Circle')")
def ellipse_perimeter(e):
    b = B.box()
    return e.filter("kind = 'Circle'").select("handle", F.round(B.ellipse_perimeter(b.width * 0.5, b.height * 0.5), 6).alias("perimeter"))


@entry("ratio_similarity", "SELECT handle, CASE WHEN greatest(w, h) > 0 THEN round(least(w, h) / greatest(w, h), 6) ELSE 0.0 END AS similarity FROM (SELECT handle, max_x - min_x AS w, max_y - min_y AS h FROM e)")
def ratio_similarity(e):
    return e.select("handle", F.round(B.ratio_similarity(B.box().width, B.box().height), 6).alias("similarity"))


@entry("preliminary_region", """SELECT handle, CASE WHEN ay <= s_min_y + (s_max_y - s_min_y) * 0.26 THEN 'title-bottom' WHEN ax >= s_max_x - (s_max_x - s_min_x) * 0.24 THEN 'meta-right' ELSE 'drawing-core' END AS region_id FROM e JOIN s USING (sheet_id)""")
def preliminary_region(e):
    return D.preliminary_region(e).select("handle", "region_id")


@entry("loose_class", f"SELECT handle, CASE WHEN kind IN {TEXT} THEN 'loose-text' WHEN kind IN {DIM} THEN 'loose-dimension' WHEN kind = 'BlockReference' THEN 'loose-block' WHEN kind IN {GEO} THEN 'loose-geometry' ELSE 'loose-other' END AS unit_key FROM e WHERE block_path IS NULL")
def loose_class(e):
    return e.filter("block_path IS NULL").select("handle", D.loose_key(F.col("kind")).alias("unit_key"))
