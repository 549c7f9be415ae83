"""Queries of components, blocks and units, over primitives and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import primitives as P
from drawlake.operators import components as C
from drawlake.plans.primitives import CLEAN, r
from drawlake.plans.rows import DIM, GEO, SHEETS_SQL, TEXT, has
from drawlake.sources.drawings import ENTITIES_SQL, entities
from drawlake.sources.primitives import PRIMITIVES_SQL, primitives

ENTRIES: dict = {}


def entry(name: str, sql: str | None, source=primitives, head: str = PRIMITIVES_SQL):
    def register(f):
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(source(spark, sf_dir))), None if sql is None else f"WITH RECURSIVE {head}{sql}"
        return f

    return register


def of_entities(name: str, sql: str | None):
    return entry(name, sql, entities, f"{ENTITIES_SQL}, {SHEETS_SQL}")


def parts(d):
    """Boxed primitives by block path: the components."""
    return d.filter("min_x IS NOT NULL AND block_path IS NOT NULL").withColumn("comp", F.concat_ws("/", "block_path", (F.col("handle") % 4).cast("string")))


GAP = "sqrt(power(greatest(0, b.min_x - a.max_x, a.min_x - b.max_x), 2) + power(greatest(0, b.min_y - a.max_y, a.min_y - b.max_y), 2))"


def _some(test: str) -> str:
    return f"coalesce(bool_or(kind IN {TEXT} AND coalesce(t, '') <> '' AND ({test})), false)"


COMPONENTS_SQL = f""", cm AS (SELECT *, concat_ws('/', block_path, CAST(handle % 4 AS VARCHAR)) AS comp, {CLEAN} AS t FROM d WHERE min_x IS NOT NULL AND block_path IS NOT NULL),
 cs AS (SELECT sheet_id, min(min_x) AS sx0, min(min_y) AS sy0, max(max_x) AS sx1, max(max_y) AS sy1 FROM cm GROUP BY sheet_id),
 cg AS (SELECT sheet_id, comp, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, count(*) FILTER (kind IN {TEXT}) AS texts, count(*) FILTER (kind = 'Line') AS lines, count(*) FILTER (kind = 'Circle') AS circles,
  count(*) FILTER (kind = 'Polyline') AS polylines, count(*) FILTER (kind IN {DIM}) AS dimensions, count(*) FILTER (kind = 'Ellipse') AS ellipses, count(*) FILTER (kind IN {GEO}) AS geometry, count(*) FILTER (kind = 'Line' AND contains(upper(layer), 'CENTER')) AS center_lines,
  bool_or(kind IN ('Circle', 'Ellipse', 'Region', 'Hatch')) AS closed_outline, bool_or(kind IN {TEXT} AND (abs(rotation - 90) <= 12 OR abs(rotation - 270) <= 12 OR max_y - min_y > (max_x - min_x) * 2.2)) AS vertical_text,
  {_some(r"regexp_matches(t, '^\s*[\d.\-+()]+\s*$')")} AS numeric_only, {_some("contains(upper(t), 'SCALE') OR " + r"regexp_matches(t, '\b\d+\s*:\s*\d+\b')")} AS scale_word, {_some(has('upper(t)', *P.MATERIAL_WORDS))} AS material_word,
  {_some(has('upper(t)', *P.QUANTITY_WORDS) + r" OR regexp_matches(t, '(?i)\b\d+\s*(EA|PCS|SET)\b')")} AS quantity_word, {_some(has('upper(t)', *P.TITLE_WORDS))} AS title_word, {_some(has('upper(t)', *P.CONTROL_WORDS))} AS control_word FROM cm GROUP BY sheet_id, comp),
 cn AS (SELECT a.sheet_id, a.comp, bool_or({GAP} <= 30) AS near_any, bool_or({GAP} <= 30 AND b.dimensions > 0) AS near_dimension, bool_or({GAP} <= 30 AND b.geometry > 0) AS near_geometry, bool_or({GAP} <= 35 AND b.geometry > 0) AS near_core
  FROM cg a JOIN cg b ON a.sheet_id = b.sheet_id AND a.comp <> b.comp GROUP BY a.sheet_id, a.comp),
 cc AS (SELECT DISTINCT a.sheet_id, a.comp, true AS concentric FROM cm a JOIN cm b ON a.sheet_id = b.sheet_id AND a.comp = b.comp AND a.handle < b.handle AND a.kind = 'Circle' AND b.kind = 'Circle'
  WHERE sqrt(power((a.min_x + a.max_x) * 0.5 - (b.min_x + b.max_x) * 0.5, 2) + power((a.min_y + a.max_y) * 0.5 - (b.min_y + b.max_y) * 0.5, 2)) <= 2 AND abs(least(a.max_x - a.min_x, a.max_y - a.min_y) / 2 - least(b.max_x - b.min_x, b.max_y - b.min_y) / 2) >= 1),
 cx AS (SELECT cg.*, coalesce(near_any, false) AS near_any, dimensions > 0 OR coalesce(near_dimension, false) AS by_dimension, geometry > 0 OR coalesce(near_geometry, false) AS by_geometry, coalesce(near_core, false) AS near_core, coalesce(concentric, false) AS concentric,
  least(abs(min_x - sx0), abs(sx1 - max_x), abs(min_y - sy0), abs(sy1 - max_y)) <= 20 AS near_border, greatest(0, min_y - (sy0 + (sy1 - sy0) * 0.26)) <= 50 AS near_title,
  min_x >= sx0 + (sx1 - sx0) * 0.12 AND max_x <= sx1 - (sx1 - sx0) * 0.12 AND min_y >= sy0 + (sy1 - sy0) * 0.12 AND max_y <= sy1 - (sy1 - sy0) * 0.12 AS central, lines + polylines >= 3 AND circles >= 1 AS trapezoid
  FROM cg JOIN cs USING (sheet_id) LEFT JOIN cn USING (sheet_id, comp) LEFT JOIN cc USING (sheet_id, comp)),
 cf AS (SELECT *, max_x - min_x <= 40 AND max_y - min_y <= 40 AND NOT near_any AS marker FROM cx),
 cf2 AS (SELECT *, (near_border OR marker) AND NOT by_geometry AND NOT by_dimension AS removable, ellipses > 0 AND numeric_only AND (marker OR near_border) AND NOT by_geometry AS ellipse_marker,
  concentric AND (trapezoid OR lines >= 2 OR polylines >= 1) AND dimensions = 0 AND NOT near_core AS projection_symbol FROM cf)"""
FEATURES = (
    "sheet_id", "comp", "texts", "lines", "circles", "polylines", "dimensions", "center_lines", "closed_outline", "vertical_text", "numeric_only", "scale_word", "material_word", "quantity_word", "title_word",
    "control_word", "near_border", "near_title", "central", "by_dimension", "by_geometry", "marker", "concentric", "trapezoid", "removable", "ellipse_marker", "projection_symbol",
)


@entry("component_features", f"{COMPONENTS_SQL} SELECT {', '.join(FEATURES)} FROM cf2")
def component_features(d):
    return C.component_features(parts(d)).select(*FEATURES)


def _points(rules: dict) -> str:
    names = {"has_dimension": "dimensions > 0", "has_number": "texts > 0 AND numeric_only", "meta_word": "scale_word OR material_word OR quantity_word", "has_center_line": "center_lines > 0"}
    return " + ".join(f"CASE WHEN {names.get(c, c)} THEN {n} ELSE 0 END" for c, n in rules.items())


_ROLES = " UNION ALL ".join(f"SELECT sheet_id, comp, '{role}' AS role, {i} AS place, {_points(rules)} AS score FROM cf2" for i, (role, rules) in enumerate(C.ROLE_POINTS.items()))


@entry("component_roles", f"""{COMPONENTS_SQL}, pr AS ({_ROLES}) SELECT sheet_id, comp, CASE WHEN score < 20 THEN 'Unknown' ELSE role END AS role, score AS role_score, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS confidence
 FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, comp ORDER BY score DESC, place) AS k FROM pr) WHERE k = 1""")  # fmt: skip
def component_roles(d):
    return C.component_roles(C.component_features(parts(d))).select("sheet_id", "comp", "role", "role_score", "confidence")


STATS_SQL = f""", bm AS (SELECT d.*, array_to_string(string_split(block_path, '>')[1:n.n], '>') AS block FROM d, range(1, 9) n(n) WHERE block_path IS NOT NULL AND n.n <= len(string_split(block_path, '>'))),
 bl AS (SELECT sheet_id, block, sqrt(power(ex - sx, 2) + power(ey - sy, 2)) AS len, abs(ey - sy) <= 1e-4 AS flat, abs(ex - sx) <= 1e-4 AS upright FROM bm WHERE kind = 'Line'
  UNION ALL SELECT sheet_id, block, w, true, w <= 1e-4 FROM bm WHERE kind = 'Polyline' UNION ALL SELECT sheet_id, block, h, h <= 1e-4, true FROM bm WHERE kind = 'Polyline' UNION ALL SELECT sheet_id, block, w, true, w <= 1e-4 FROM bm WHERE kind = 'Polyline'
  UNION ALL SELECT sheet_id, block, h, h <= 1e-4, true FROM bm WHERE kind = 'Polyline' AND closed),
 bt AS (SELECT sheet_id, block, sum(CASE WHEN flat THEN len ELSE 0 END) AS len_h, sum(CASE WHEN upright AND NOT flat THEN len ELSE 0 END) AS len_v, sum(CASE WHEN NOT flat AND NOT upright THEN len ELSE 0 END) AS len_o,
  count(*) FILTER (flat AND len > 100) AS long_h, count(*) FILTER (upright AND NOT flat AND len > 100) AS long_v FROM bl WHERE len > 1e-9 GROUP BY sheet_id, block),
 bg AS (SELECT sheet_id, block, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1, count(*) FILTER (kind = 'Line') AS lines, count(*) FILTER (kind = 'Arc') AS arcs, count(*) FILTER (kind = 'Circle') AS circles, count(*) FILTER (kind = 'Polyline') AS polylines,
  count(*) FILTER (kind = 'Text') AS db_texts, count(*) FILTER (kind = 'MText') AS m_texts, count(*) FILTER (kind = 'InsertAttribute') AS attributes, count(*) FILTER (kind = 'BlockReference') AS nested, coalesce(string_agg(upper(text), ' '), '') AS words_of FROM bm GROUP BY sheet_id, block),
 bs AS (SELECT bg.*, {' + '.join(f"CASE WHEN contains(words_of, '{w}') THEN 1 ELSE 0 END" for w in P.BLOCK_WORDS)} AS words, coalesce(len_h, 0) AS len_h, coalesce(len_v, 0) AS len_v, coalesce(len_o, 0) AS len_o, coalesce(long_h, 0) AS long_h, coalesce(long_v, 0) AS long_v FROM bg LEFT JOIN bt USING (sheet_id, block))"""


@entry("block_stats", f"{STATS_SQL} SELECT sheet_id, block, lines, arcs, circles, polylines, db_texts, m_texts, attributes, nested, words, round(len_h, 4) AS len_h, round(len_v, 4) AS len_v, round(len_o, 4) AS len_o, CAST(long_h AS BIGINT) AS long_h, CAST(long_v AS BIGINT) AS long_v FROM bs")
def block_stats(d):
    x = C.block_stats(d)
    return x.select("sheet_id", "block", "lines", "arcs", "circles", "polylines", "db_texts", "m_texts", "attributes", "nested", "words", *[F.round(c, 4).alias(c) for c in ("len_h", "len_v", "len_o")], "long_h", "long_v")


@entry("block_roles", f"""{STATS_SQL}, q AS (SELECT *, db_texts + m_texts + attributes AS texts, lines + arcs + circles + polylines AS g, arcs + circles AS rounds, x1 - x0 AS bw, y1 - y0 AS bh FROM bs),
 p AS (SELECT sheet_id, block, CASE WHEN db_texts > 0 THEN 20 ELSE 0 END + CASE WHEN m_texts > 0 THEN 20 ELSE 0 END + CASE WHEN attributes > 0 THEN 20 ELSE 0 END + CASE WHEN texts >= 3 THEN 15 ELSE 0 END + CASE WHEN texts >= 8 THEN 20 ELSE 0 END
   + CASE WHEN g > 0 AND texts > 0 AND texts / g >= 0.3 THEN 10 ELSE 0 END + CASE WHEN words > 0 THEN 15 + words * 5 ELSE 0 END AS meta,
  CASE WHEN g >= 10 THEN 20 ELSE 0 END + CASE WHEN g >= 30 THEN 20 ELSE 0 END + CASE WHEN texts = 0 AND g > 0 THEN 20 ELSE 0 END + CASE WHEN rounds >= 3 THEN 15 ELSE 0 END + CASE WHEN rounds >= 10 THEN 10 ELSE 0 END + CASE WHEN g >= 20 AND texts = 0 THEN 10 ELSE 0 END
   + CASE WHEN len_o > (len_h + len_v) * 0.3 THEN 10 ELSE 0 END AS geometry,
  greatest(0, CASE WHEN lines >= 4 OR polylines >= 1 THEN 5 ELSE 0 END + CASE WHEN long_h >= 2 THEN 15 ELSE 0 END + CASE WHEN long_v >= 2 THEN 15 ELSE 0 END + CASE WHEN long_h >= 2 AND long_v >= 2 THEN 15 ELSE 0 END + CASE WHEN bw > 100 AND bh > 50 THEN 10 ELSE 0 END
   + CASE WHEN texts = 0 AND long_h + long_v >= 4 THEN 10 ELSE 0 END - CASE WHEN rounds >= 3 THEN 10 ELSE 0 END - CASE WHEN rounds >= 10 THEN 10 ELSE 0 END - CASE WHEN bw * bh < 2000 THEN 15 ELSE 0 END - CASE WHEN g >= 40 AND rounds >= 3 THEN 10 ELSE 0 END) AS frame FROM q)
 SELECT sheet_id, block, meta, geometry, frame, CASE WHEN greatest(meta, geometry, frame) < 20 OR greatest(meta, geometry, frame) - (meta + geometry + frame - greatest(meta, geometry, frame) - least(meta, geometry, frame)) < 10 THEN 'Unknown'
  WHEN meta = greatest(meta, geometry, frame) THEN 'Meta' WHEN geometry = greatest(meta, geometry, frame) THEN 'Geometry' ELSE 'Frame' END AS role FROM p""")  # fmt: skip
def block_roles(d):
    return C.block_roles(C.block_stats(d)).select("sheet_id", "block", "meta", "geometry", "frame", "role")


@of_entities("unit_scores", f""", u AS (SELECT sheet_id, block_path, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1, count(*) AS total, count(*) FILTER (kind IN {GEO}) AS g, count(*) FILTER (kind IN {TEXT}) AS t, count(*) FILTER (kind IN {DIM}) AS a,
  count(*) FILTER (kind = 'Line') AS lines, count(*) FILTER (kind = 'Polyline') AS polys, count(*) FILTER (kind = 'Arc') AS arcs, count(*) FILTER (kind = 'Circle') AS circles, count(*) FILTER (kind = 'Hatch') AS hatches,
  count(DISTINCT CASE WHEN {has("upper(coalesce(text, ''))", *C.UNIT_WORDS)} THEN trim(text) END) AS hits FROM e WHERE block_path IS NOT NULL GROUP BY ALL),
 sb AS (SELECT sheet_id, min(min_x) AS s_min_x, min(min_y) AS s_min_y, max(max_x) AS s_max_x, max(max_y) AS s_max_y FROM e WHERE block_path IS NOT NULL GROUP BY sheet_id),
 q AS (SELECT *, s_min_y + (s_max_y - s_min_y) * 0.25 AS top, ((y0 + y1) * 0.5 - s_min_y) / greatest(s_max_y - s_min_y, 1e-6) AS mid FROM u JOIN sb USING (sheet_id)),
 z AS (SELECT sheet_id, block_path, g::DOUBLE / total * 35 + least(12.0::DOUBLE, circles * 4.0::DOUBLE + arcs * 3.0::DOUBLE) + least(10.0::DOUBLE, polys * 0.8::DOUBLE) + least(6.0::DOUBLE, hatches * 1.5::DOUBLE) - t::DOUBLE / total * 18 - a::DOUBLE / total * 16
  - greatest(0, least(y1, top) - greatest(y0, s_min_y)) / greatest(y1 - y0, 1e-6) * 40 - CASE WHEN y1 <= top THEN 18 ELSE 0 END - hits * 9 - CASE WHEN g > 0 AND lines >= g * 0.8 AND circles + arcs = 0 AND polys <= 2 THEN 8 ELSE 0 END - CASE WHEN mid < 0.25 THEN (0.25 - mid) * 20 ELSE 0 END AS score FROM q)
 SELECT sheet_id, block_path, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY round(score, 9) DESC, block_path) AS INTEGER) AS rank FROM z""")  # fmt: skip
def unit_scores(e):
    from pyspark.sql import Window as W

    x = C.unit_scores(e.filter("block_path IS NOT NULL"), "block_path")
    rank = F.row_number().over(W.partitionBy("sheet_id").orderBy(F.round("score", 9).desc(), "block_path"))
    return x.select("sheet_id", "block_path", r("score"), rank.alias("rank"))
