"""Row-wise queries over primitives: boxes, points, styles and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import kinds as K
from drawlake.functions import primitives as P
from drawlake.plans.rows import DIM, GEO, TEXT, has
from drawlake.sources.primitives import LAYER_LINETYPES, PRIMITIVES_SQL, primitives

ENTRIES: dict = {}


def entry(name: str, sql: str | None):
    """Register a query over primitives with its SQL, which may use d."""

    def register(f):
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(primitives(spark, sf_dir))), None if sql is None else f"WITH RECURSIVE {PRIMITIVES_SQL}{sql}"
        return f

    return register


r = lambda c, name=None: F.round(c, 6).alias(name or c)
ROUND = "('Circle', 'Arc', 'Ellipse')"
CORNERS = "('Polyline', 'Spline', 'Solid')"


def _axis(box: str, ends: str, centre: str, reach: str, point: str, size: str, side: int) -> str:
    pick, sign = ("least", "-") if side == 0 else ("greatest", "+")
    s, e = (f"s{ends}", f"e{ends}")
    corner = f"CASE WHEN {size} < 1e-4 THEN {point} {'' if side == 0 else f'+ {size} '}{sign} 1e-4 ELSE {point}{'' if side == 0 else f' + {size}'} END"
    return (
        f"coalesce({box}, CASE WHEN kind = 'Line' THEN CASE WHEN abs({e} - {s}) < 1e-4 THEN {pick}({s}, {e}) {sign} 1e-4 ELSE {pick}({s}, {e}) END"
        f" WHEN kind IN {ROUND} THEN CASE WHEN {reach} > 0 AND radius > 0 THEN {centre} {sign} {reach} END WHEN kind IN {CORNERS} THEN {corner} ELSE {point} {sign} 1e-4 END)"
    )


_RY = "CASE WHEN kind = 'Ellipse' THEN radius * ratio ELSE radius END"
ENSURED_SQL = ", ".join(
    f"round({_axis(*a)}, 6) AS {a[0]}"
    for a in (("min_x", "x", "cx", "radius", "x", "w", 0), ("min_y", "y", "cy", _RY, "y", "h", 0), ("max_x", "x", "cx", "radius", "x", "w", 1), ("max_y", "y", "cy", _RY, "y", "h", 1))
)


@entry("bounds_fallback", f" SELECT handle, {ENSURED_SQL} FROM d")
def bounds_fallback(d):
    b = P.ensured_box(P.vertices())
    return d.select("handle", *[r(c, n) for n, c in zip(b._fields, b, strict=True)])


@entry("geometry_fields", f""" SELECT handle, CASE WHEN kind = 'Ellipse' THEN radius END AS major, CASE WHEN kind = 'Ellipse' THEN round(radius * ratio, 6) END AS minor,
 CASE WHEN kind IN {CORNERS} THEN 4 ELSE 0 END AS vertices, CASE WHEN kind IN ('Polyline', 'Spline') THEN closed END AS is_closed, CASE WHEN kind IN {CORNERS} THEN w * h END AS area,
 CASE WHEN kind IN {CORNERS} THEN round(sqrt(h * h), 6) END AS closure_gap, CASE WHEN kind IN {CORNERS} THEN x + w * 0.5 END AS middle_x FROM d""")  # fmt: skip
def geometry_fields(d):
    """Radii of ellipses, vertices of polylines, splines (the corners of their box) and solids
    with their count, enclosed area, distance from last to first and middle."""
    from drawlake.functions.boxes import polygon_area

    kind, v = F.col("kind"), F.col("v")
    rows = d.withColumn("v", P.vertices())
    gap = F.sqrt(F.pow(v[3]["x"] - v[0]["x"], 2) + F.pow(v[3]["y"] - v[0]["y"], 2))
    mean = F.aggregate(v, F.lit(0.0), lambda a, p: a + p["x"]) / F.size(v)
    return rows.select(
        "handle", F.when(kind == "Ellipse", F.col("radius")).alias("major"), r(F.when(kind == "Ellipse", F.col("radius") * F.col("ratio")), "minor"),
        F.when(v.isNotNull(), F.size(v)).otherwise(0).alias("vertices"), F.when(kind.isin("Polyline", "Spline"), F.col("closed")).alias("is_closed"),
        F.when(v.isNotNull(), polygon_area(v)).alias("area"), r(F.when(v.isNotNull(), gap), "closure_gap"), F.when(v.isNotNull(), mean).alias("middle_x"),
    )


@entry("type_anchors", f""" SELECT handle, coalesce(CASE WHEN kind IN {TEXT} OR kind = 'BlockReference' THEN x WHEN kind IN {ROUND} THEN cx WHEN kind = 'Line' THEN (sx + ex) * 0.5 ELSE (min_x + max_x) * 0.5 END, 0.0) AS ax,
 coalesce(CASE WHEN kind IN {TEXT} OR kind = 'BlockReference' THEN y WHEN kind IN {ROUND} THEN cy WHEN kind = 'Line' THEN (sy + ey) * 0.5 ELSE (min_y + max_y) * 0.5 END, 0.0) AS ay FROM d""")  # fmt: skip
def type_anchors(d):
    x, y = P.scan_anchor()
    return d.select("handle", x.alias("ax"), y.alias("ay"))


@entry("representative_points", """, q AS (SELECT handle, kind, CASE WHEN kind IN ('Text', 'MText', 'BlockReference') THEN x WHEN kind = 'Line' THEN (sx + ex) * 0.5 WHEN kind IN ('Arc', 'Circle') THEN cx ELSE (min_x + max_x) * 0.5 END AS px,
 CASE WHEN kind IN ('Text', 'MText', 'BlockReference') THEN y WHEN kind = 'Line' THEN (sy + ey) * 0.5 WHEN kind IN ('Arc', 'Circle') THEN cy ELSE (min_y + max_y) * 0.5 END AS py FROM d)
 SELECT handle, px, py, CASE WHEN px IS NULL THEN NULL WHEN kind IN ('Text', 'MText') THEN 'Text' WHEN kind = 'BlockReference' THEN 'Block' WHEN kind IN ('Line', 'Arc', 'Circle', 'Polyline') THEN 'Curve' ELSE 'Other' END AS cell_kind FROM q""")  # fmt: skip
def representative_points(d):
    x, y, name = P.representative_point()
    return d.select("handle", x.alias("px"), y.alias("py"), name.alias("cell_kind"))


_LT_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in LAYER_LINETYPES.items())
LINETYPE_SQL = f""", lt(layer, layer_linetype) AS (VALUES {_LT_VALUES}),
 el AS (SELECT d.*, CASE WHEN linetype IS NOT NULL AND trim(linetype) <> '' AND lower(linetype) <> 'bylayer' THEN linetype WHEN trim(layer_linetype) <> '' THEN trim(layer_linetype) ELSE linetype END AS effective FROM d LEFT JOIN lt USING (layer))"""


def with_linetypes(d):
    """Adds `effective`; the table of layers is a few rows and is broadcast."""
    layers = d.sparkSession.createDataFrame(list(LAYER_LINETYPES.items()), "layer STRING, layer_linetype STRING")
    return d.join(F.broadcast(layers), "layer", "left").withColumn("effective", P.effective_linetype(F.col("linetype"), F.col("layer_linetype"))).drop("layer_linetype")


@entry("effective_linetypes", f"{LINETYPE_SQL} SELECT handle, effective FROM el")
def effective_linetypes(d):
    return with_linetypes(d).select("handle", "effective")


@entry("faded_flags", f"{LINETYPE_SQL} SELECT handle, {has('upper(trim(layer))', *P.FADED_LAYERS)} OR {has("upper(trim(coalesce(effective, '')))", *P.FADED_LINETYPES)} OR coalesce(transparency, 0) > 0 AS is_faded FROM el")
def faded_flags(d):
    return with_linetypes(d).select("handle", P.is_faded(F.col("layer"), F.col("effective"), F.col("transparency")).alias("is_faded"))


@entry("linetype_flags", f"{LINETYPE_SQL} SELECT handle, {has('upper(layer)', *K.FLAG_CENTER)} OR {has("upper(coalesce(effective, ''))", *K.FLAG_CENTER)} AS is_center_line, {has('upper(layer)', *K.FLAG_HIDDEN)} OR {has("upper(coalesce(effective, ''))", *K.FLAG_HIDDEN)} AS is_hidden_line, {has('upper(layer)', *K.FLAG_TABLE)} AS is_table_layer FROM el")
def linetype_flags(d):
    flags = K.semantic_flags(F.col("layer"), F.col("effective"))
    return with_linetypes(d).select("handle", *[flags[n].alias(n) for n in ("is_center_line", "is_hidden_line", "is_table_layer")])


CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(trim(text), '\P', ' '), '%%U', ''), '%%C', 'Ø'), '{', ''), '}', ''), ' {2,}', ' ', 'g'))"


@entry("component_texts", f" SELECT handle, {CLEAN} AS clean FROM d WHERE text IS NOT NULL")
def component_texts(d):
    return d.filter("text IS NOT NULL").select("handle", P.component_text(F.col("text")).alias("clean"))


@entry("cad_texts", r" SELECT handle, trim(regexp_replace(replace(replace(replace(text, '\P', ' '), '%%U', ''), '%%C', 'Ø'), ' {2,}', ' ', 'g')) AS plain, regexp_replace(text, '\\(?:[A-Z][^;]*;|.)|[{}]', '', 'g') AS bare FROM d WHERE text IS NOT NULL")
def cad_texts(d):
    """Texts with line ends, underlines, diameters and format codes, cleaned by both rules."""
    from drawlake.functions import cadtext as T

    return d.filter("text IS NOT NULL").select("handle", T.normalize_cad_text(F.col("text")).alias("plain"), T.strip_format_codes(F.col("text")).alias("bare"))


@entry("zone_keyword_texts", " SELECT handle, upper(translate(trim(text), concat(' ', chr(9), chr(39), '’', '.'), '')) AS word FROM d WHERE text IS NOT NULL")
def zone_keyword_texts(d):
    return d.filter("text IS NOT NULL").select("handle", P.zone_keyword_text(F.col("text")).alias("word"))


@entry("quantity_notes", r" SELECT handle, trim(text) <> '' AND length(trim(text)) <= 32 AND NOT regexp_matches(text, '[.,:;]') AND regexp_matches(text, '(?i)^\s*\d+\s*([*x×]\s*\d+\s*)?(SET|SETS|EA|EACH|PCS|PC)\s*$') AS is_note FROM d WHERE text IS NOT NULL")
def quantity_notes(d):
    return d.filter("text IS NOT NULL").select("handle", P.is_quantity_note(F.col("text")).alias("is_note"))


@entry("column_texts", r" SELECT handle, nullif(regexp_extract(text, '(?i)(X|\*)\s?(\d+)', 2), '') AS quantity, CASE WHEN regexp_matches(text, '(?i)PL\d') THEN concat(regexp_extract(text, '(?i)PL(\d+)', 1), 'T') END AS thickness, CASE WHEN contains(text, 'SUS') THEN 'SUS' END AS material FROM d WHERE text IS NOT NULL")
def column_texts(d):
    return d.filter("text IS NOT NULL").select("handle", P.column_attributes(F.col("text")).alias("a")).select("handle", "a.*")


@entry("numeric_texts", r" SELECT handle, regexp_matches(regexp_replace(text, '\s', '', 'g'), '^[0-9.+\-/()]+$') AS is_numeric, CAST(length(regexp_replace(text, '\s', '', 'g')) AS INTEGER) AS plain_length, regexp_matches(text, '^NAJV-|^DRC-') AS is_header FROM d WHERE text IS NOT NULL")
def numeric_texts(d):
    t = F.col("text")
    return d.filter("text IS NOT NULL").select("handle", P.is_numeric_like(t).alias("is_numeric"), F.length(F.regexp_replace(t, r"\s", "")).alias("plain_length"), t.rlike("^NAJV-|^DRC-").alias("is_header"))


@entry("vertical_texts", f" SELECT handle FROM d WHERE kind IN {TEXT} AND (abs(rotation - 90) <= 12 OR abs(rotation - 270) <= 12 OR coalesce(max_y - min_y > (max_x - min_x) * 2.2, false))")
def vertical_texts(d):
    return d.filter(P.is_vertical_text(F.col("kind"), F.col("rotation"), F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))).select("handle")


@entry("human_names", r""", n AS (SELECT handle, CASE handle % 6 WHEN 0 THEN concat('G$', handle) WHEN 1 THEN concat('NDRC-', handle) WHEN 2 THEN concat('bolt!', handle) WHEN 3 THEN concat('A$C', handle) WHEN 4 THEN '20240308 part-x' ELSE concat('2024_03 wrench', handle) END AS name FROM d WHERE kind = 'BlockReference')
 SELECT handle, name, CASE WHEN name LIKE 'G$%' THEN -4 ELSE 0 END + CASE WHEN name LIKE 'A$%' THEN -4 ELSE 0 END + CASE WHEN contains(name, '!') THEN -2 ELSE 0 END + CASE WHEN regexp_matches(name, '\b20\d{6}\b') THEN -2 ELSE 0 END + CASE WHEN regexp_matches(name, '\b20\d{2}[_.]\d{2}\b') THEN -1 ELSE 0 END
  + CASE WHEN contains(name, '-') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(name, '[A-Za-z]{3,}') THEN 2 ELSE 0 END + CASE WHEN contains(upper(name), 'NDRC') THEN 1 ELSE 0 END AS score FROM n""")  # fmt: skip
def human_names(d):
    h = F.col("handle").cast("string")
    k = F.col("handle") % 6
    name = F.when(k == 0, F.concat(F.lit("G$"), h)).when(k == 1, F.concat(F.lit("NDRC-"), h)).when(k == 2, F.concat(F.lit("bolt!"), h)).when(k == 3, F.concat(F.lit("A$C"), h)).when(k == 4, "20240308 part-x").otherwise(F.concat(F.lit("2024_03 wrench"), h))
    return d.filter("kind = 'BlockReference'").select("handle", name.alias("name")).withColumn("score", P.human_name_score(F.col("name")))


@entry("seed_rejects", f""" SELECT CASE WHEN kind = 'BlockReference' THEN 'blockref' WHEN kind IN {TEXT} THEN 'text' WHEN kind IN {DIM} THEN 'dimension' WHEN kind NOT IN {GEO} THEN 'non-geometry' WHEN min_x IS NULL AND kind IN {ROUND} AND NOT (radius > 0 AND {_RY} > 0) THEN 'empty-bounds' ELSE 'accepted' END AS reason, count(*) AS n FROM d GROUP BY 1""")
def seed_rejects(d):
    """Why members are no geometry seeds, with counts."""
    b, kind = P.ensured_box(P.vertices()), F.col("kind")
    reason = (
        F.when(kind == "BlockReference", "blockref").when(K.is_text(kind), "text").when(K.is_dimension(kind), "dimension").when(~K.is_geometry(kind), "non-geometry")
        .when(b.min_x.isNull() | b.min_y.isNull(), "empty-bounds").otherwise("accepted")
    )
    return d.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@entry("segment_sources", f" SELECT handle FROM d WHERE kind IN {GEO} AND NOT {has('upper(layer)', *K.STROKE_CENTER)} AND NOT {has('upper(layer)', *K.STROKE_HIDDEN)} AND NOT {has('upper(layer)', *K.STROKE_NOTE)}")
def segment_sources(d):
    """Geometry whose stroke is a visible outline or unknown."""
    stroke = K.stroke_semantic(F.col("kind"), F.col("layer"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return d.filter(K.is_geometry(F.col("kind")) & stroke.isin("VisibleOutline", "Unknown", "InteriorDivider")).select("handle")


@entry("distinct_handles", f", m AS (SELECT sheet_id, CASE WHEN handle % 10 = 0 THEN '' ELSE concat('h', handle // 3) END AS name, handle FROM d WHERE kind IN {GEO}) SELECT name, handle FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, CASE WHEN name = '' THEN CAST(handle AS VARCHAR) ELSE lower(name) END ORDER BY handle) AS k FROM m) WHERE k = 1")
def distinct_handles(d):
    """The first of each name on a sheet, in any case; blank names are all kept."""
    rows = d.filter(K.is_geometry(F.col("kind"))).withColumn("name", F.when(F.col("handle") % 10 == 0, "").otherwise(F.concat(F.lit("H"), F.floor(F.col("handle") / 3).cast("string"))))
    key = F.when(F.col("name") == "", F.col("handle").cast("string")).otherwise(F.lower("name"))
    first = rows.groupBy("sheet_id", key.alias("key")).agg(F.min(F.struct("handle", "name")).alias("f"))
    return first.select(F.lower("f.name").alias("name"), "f.handle")
