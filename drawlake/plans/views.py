"""Queries of view candidates, packs, content regions, relations and roles of views."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.operators import drawing as D
from drawlake.operators import views as V
from drawlake.plans.primitives import r
from drawlake.plans.rows import DIM, GEO, SHEETS_SQL, TEXT, has
from drawlake.plans.shapes import CLUSTERS_SQL, VIEWS_SQL, VPAIRS_SQL, block_views
from drawlake.sources.drawings import ENTITIES_SQL, entities

ENTRIES: dict = {}


def entry(name: str, sql: str | None):
    def register(f):
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(entities(spark, sf_dir))), None if sql is None else f"WITH RECURSIVE {ENTITIES_SQL}, {SHEETS_SQL}, {sql}"
        return f

    return register


MEMBERS_SQL = f"""{CLUSTERS_SQL}, ap AS (SELECT e.sheet_id, e.handle, e.kind, e.min_x, e.min_y, e.max_x, e.max_y, cluster_id, sqrt(power(greatest(0, c.min_x - e.max_x, e.min_x - c.max_x), 2) + power(greatest(0, c.min_y - e.max_y, e.min_y - c.max_y), 2)) AS d FROM e JOIN c USING (sheet_id) WHERE kind IN {TEXT} OR kind IN {DIM}),
 ak AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, handle ORDER BY d, cluster_id) AS k FROM ap WHERE d <= 80),
 vm AS (SELECT sheet_id, component AS cluster_id, kind, min_x, min_y, max_x, max_y FROM seeds JOIN cc USING (sheet_id, handle) UNION ALL SELECT sheet_id, cluster_id, kind, min_x, min_y, max_x, max_y FROM ak WHERE k = 1),
 ct AS (SELECT sheet_id, cluster_id, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, count(*) FILTER (kind IN {GEO}) AS geometry, count(*) FILTER (kind IN ('Arc', 'Circle', 'Ellipse')) AS rounds,
  count(*) FILTER (kind IN {DIM}) AS dimensions, count(*) FILTER (kind IN {TEXT}) AS texts, count(*) FILTER (kind = 'Polyline') AS polylines, count(*) FILTER (kind = 'Line') AS lines FROM vm GROUP BY sheet_id, cluster_id)"""
CANDIDATES_SQL = f"""{MEMBERS_SQL}, vq AS (SELECT ct.*, s.* EXCLUDE (sheet_id), rounds > 0 AND rounds >= greatest(1, geometry // 3) AS round_heavy, CASE WHEN least(max_x - min_x, max_y - min_y) <= 0 THEN CASE WHEN greatest(max_x - min_x, max_y - min_y) <= 0 THEN 1 ELSE 9999 END ELSE greatest(max_x - min_x, max_y - min_y) / least(max_x - min_x, max_y - min_y) END AS aspect,
  least(s_max_x - s_min_x, s_max_y - s_min_y) * 0.08 AS m, sqrt(power((min_x + max_x) * 0.5 - (s_min_x + s_max_x) * 0.5, 2) + power((min_y + max_y) * 0.5 - (s_min_y + s_max_y) * 0.5, 2)) / sqrt(power(s_max_x - s_min_x, 2) + power(s_max_y - s_min_y, 2)) AS off,
  (max_x - min_x) * (max_y - min_y) / ((s_max_x - s_min_x) * (s_max_y - s_min_y)) AS share FROM ct JOIN s USING (sheet_id)),
 vc AS (SELECT *, aspect >= 10 AS slender, round(greatest(0, least(1, CASE WHEN geometry >= 3 THEN 0.22 WHEN geometry = 2 THEN 0.12 WHEN geometry = 1 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN round_heavy THEN 0.18 WHEN rounds > 0 THEN 0.10 ELSE 0 END::DOUBLE + least(0.18::DOUBLE, dimensions * 0.06::DOUBLE)
  + CASE WHEN texts > 0 AND texts <= geometry THEN 0.05 WHEN texts > geometry * 2 THEN -0.10 ELSE 0 END::DOUBLE + CASE WHEN min_x >= s_min_x + m AND min_y >= s_min_y + m AND max_x <= s_max_x - m AND max_y <= s_max_y - m THEN 0.12 WHEN off <= 0.22 THEN 0.06 WHEN off >= 0.45 THEN -0.08 ELSE 0 END::DOUBLE
  + CASE WHEN aspect >= 18 THEN -0.20 WHEN aspect >= 10 THEN -0.08 ELSE 0 END::DOUBLE + CASE WHEN share >= 0.55 THEN -0.18 WHEN share <= 0.00008 THEN -0.08 ELSE 0.05 END::DOUBLE + CASE WHEN geometry >= 2 AND texts <= geometry + 2 THEN 0.05 ELSE 0 END::DOUBLE)), 9) AS score FROM vq)"""


@entry("view_candidates", f"{CANDIDATES_SQL} SELECT sheet_id, cluster_id, geometry, rounds, dimensions, texts, round_heavy, slender, round(score, 6) AS score, score >= 0.38 AS is_candidate FROM vc")
def view_candidates(e):
    c = V.view_candidates(V.cluster_totals(V.cluster_members(e)), D.sheet_bounds(e))
    return c.select("sheet_id", "cluster_id", "geometry", "rounds", "dimensions", "texts", "round_heavy", "slender", r("score"), (F.col("score") >= 0.38).alias("is_candidate"))


_TEST = "CASE WHEN least({0}.max_{2} - {0}.min_{2}, {1}.max_{2} - {1}.min_{2}) > 0 THEN greatest(0, least({0}.max_{2}, {1}.max_{2}) - greatest({0}.min_{2}, {1}.min_{2})) / least({0}.max_{2} - {0}.min_{2}, {1}.max_{2} - {1}.min_{2}) ELSE 0 END >= 0.28"
PACK_SQL = f"""{CANDIDATES_SQL}, tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, geometry DESC, cluster_id) AS k FROM vc WHERE score >= 0.38) WHERE k <= 8),
 pp AS (SELECT a.sheet_id, a.k AS ak, b.k AS bk, sqrt(power(greatest(0, b.min_x - a.max_x, a.min_x - b.max_x), 2) + power(greatest(0, b.min_y - a.max_y, a.min_y - b.max_y), 2)) > sqrt(power(a.s_max_x - a.s_min_x, 2) + power(a.s_max_y - a.s_min_y, 2)) * 0.42 AS far,
   abs((a.min_y + a.max_y - b.min_y - b.max_y) * 0.5) <= least(a.s_max_x - a.s_min_x, a.s_max_y - a.s_min_y) * 0.1 OR {_TEST.format('a', 'b', 'y')} AS fl, abs((a.min_x + a.max_x - b.min_x - b.max_x) * 0.5) <= least(a.s_max_x - a.s_min_x, a.s_max_y - a.s_min_y) * 0.1 OR {_TEST.format('a', 'b', 'x')} AS up,
   (a.round_heavy AND b.slender) OR (b.round_heavy AND a.slender) AS disc FROM tp a JOIN tp b ON a.sheet_id = b.sheet_id AND a.k < b.k
   WHERE CASE WHEN least((a.max_x - a.min_x) * (a.max_y - a.min_y), (b.max_x - b.min_x) * (b.max_y - b.min_y)) > 0 THEN greatest(0, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * greatest(0, least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)) / least((a.max_x - a.min_x) * (a.max_y - a.min_y), (b.max_x - b.min_x) * (b.max_y - b.min_y)) ELSE 0 END <= 0.35),
 pf AS (SELECT sheet_id, ak, bk, disc, fl AND NOT far AS flat, up AND NOT far AS upright, CASE WHEN far THEN -0.08 ELSE CASE WHEN fl OR up THEN 0.10 ELSE 0 END + CASE WHEN fl THEN 0.05 ELSE 0 END + CASE WHEN up THEN 0.05 ELSE 0 END END::DOUBLE AS part FROM pp),
 sets AS (SELECT sheet_id, [ak, bk] AS ks, part + CASE WHEN disc THEN 0.16 WHEN flat OR upright THEN 0.06 ELSE 0 END::DOUBLE AS base FROM pf
  UNION ALL SELECT x.sheet_id, [x.ak, x.bk, y.bk], x.part + y.part + z.part + 0.14::DOUBLE + CASE WHEN (x.flat OR y.flat OR z.flat) AND (x.upright OR y.upright OR z.upright) THEN 0.10 ELSE 0 END::DOUBLE + CASE WHEN (x.flat OR x.upright)::INT + (y.flat OR y.upright)::INT + (z.flat OR z.upright)::INT >= 2 THEN 0.06 ELSE 0 END::DOUBLE
  FROM pf x JOIN pf y ON x.sheet_id = y.sheet_id AND x.bk = y.ak JOIN pf z ON z.sheet_id = x.sheet_id AND z.ak = x.ak AND z.bk = y.bk),
 su AS (SELECT sets.sheet_id, ks, base, list(cluster_id ORDER BY k) AS ids, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, sum(score) / count(*) AS mean, sum(texts) AS texts, sum(geometry) AS geometry, any_value(s_min_x) AS x0, any_value(s_min_y) AS y0, any_value(s_max_x) AS x1, any_value(s_max_y) AS y1
  FROM sets JOIN tp ON tp.sheet_id = sets.sheet_id AND list_contains(ks, k) GROUP BY sets.sheet_id, ks, base),
 pk AS (SELECT sheet_id, ids[1] AS a, ids[2] AS b, ids[3] AS c, min_x, min_y, max_x, max_y, geometry, round(greatest(0, least(1, mean * 0.45 + base + CASE WHEN min_x >= x0 + least(x1 - x0, y1 - y0) * 0.06 AND min_y >= y0 + least(x1 - x0, y1 - y0) * 0.06 AND max_x <= x1 - least(x1 - x0, y1 - y0) * 0.06 AND max_y <= y1 - least(x1 - x0, y1 - y0) * 0.06 THEN 0.08 ELSE 0 END
  - CASE WHEN texts > geometry * 2 THEN 0.12 ELSE 0 END)), 9) AS score FROM su WHERE (max_x - min_x) * (max_y - min_y) / ((x1 - x0) * (y1 - y0)) <= 0.72),
 packs AS (SELECT * FROM pk WHERE score >= 0.42)"""


@entry("scored_packs", f"{PACK_SQL} SELECT sheet_id, a, b, c, CAST(geometry AS BIGINT) AS geometry, round(score, 6) AS score FROM packs")
def scored_packs(e):
    sheets = D.sheet_bounds(e)
    return V.view_packs(V.view_candidates(V.cluster_totals(V.cluster_members(e)), sheets), sheets).select("sheet_id", "a", "b", "c", "geometry", r("score"))


BEST_SQL = f"{PACK_SQL}, bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY round(score, 6) DESC, (c IS NOT NULL) DESC, geometry DESC, a, b, c NULLS FIRST) AS k FROM packs) WHERE k = 1)"


@entry("best_pack", f"{BEST_SQL} SELECT sheet_id, a, b, c, round(score, 6) AS score FROM bp")
def best_pack(e):
    sheets = D.sheet_bounds(e)
    packs = V.view_packs(V.view_candidates(V.cluster_totals(V.cluster_members(e)), sheets), sheets)
    return V.best_pack(packs.withColumn("score", F.round("score", 6))).select("sheet_id", "a", "b", "c", "score")


CONTENT_SQL = f"""{BEST_SQL}, bc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, geometry DESC, cluster_id) AS kk FROM vc WHERE geometry > 0) WHERE kk = 1),
 k0 AS (SELECT sheet_id, min_x, min_y, max_x, max_y, score FROM bp UNION ALL SELECT sheet_id, min_x, min_y, max_x, max_y, score FROM bc WHERE sheet_id NOT IN (SELECT sheet_id FROM bp)),
 rest AS (SELECT e.* FROM e JOIN k0 USING (sheet_id) WHERE NOT (ax BETWEEN k0.min_x - 4 AND k0.max_x + 4 AND ay BETWEEN k0.min_y - 4 AND k0.max_y + 4) AND NOT (k0.max_x + 6 >= e.min_x AND e.max_x + 6 >= k0.min_x AND k0.max_y + 6 >= e.min_y AND e.max_y + 6 >= k0.min_y)),
 bands AS (SELECT s.sheet_id, 'title-bottom' AS region_id, 'TitleBlock' AS region_kind, s_min_x AS x0, s_min_y AS y0, s_max_x AS x1, s_min_y + (s_max_y - s_min_y) * 0.26 AS y1 FROM s UNION ALL SELECT sheet_id, 'meta-right', 'MetaTable', s_max_x - (s_max_x - s_min_x) * 0.24, s_min_y, s_max_x, s_max_y FROM s),
 bo AS (SELECT bands.* FROM bands JOIN k0 USING (sheet_id) WHERE CASE WHEN least((x1 - x0) * (y1 - y0), (max_x - min_x) * (max_y - min_y)) > 0 THEN greatest(0, least(x1, max_x) - greatest(x0, min_x)) * greatest(0, least(y1, max_y) - greatest(y0, min_y)) / least((x1 - x0) * (y1 - y0), (max_x - min_x) * (max_y - min_y)) ELSE 0 END <= 0.30),
 bn AS (SELECT bo.sheet_id, region_id, region_kind, x0, y0, x1, y1, count(*) FILTER (kind IN {TEXT} AND ax BETWEEN x0 AND x1 AND ay BETWEEN y0 AND y1) AS t, count(*) FILTER (kind IN ('Line', 'Polyline') AND ((ax BETWEEN x0 AND x1 AND ay BETWEEN y0 AND y1) OR (min_x <= x1 AND x0 <= max_x AND min_y <= y1 AND y0 <= max_y))) AS l,
  count(*) FILTER (kind IN {TEXT} AND ax BETWEEN x0 AND x1 AND ay BETWEEN y0 AND y1 AND {has("upper(coalesce(text, ''))", *V.BAND_WORDS)}) AS w FROM bo JOIN rest USING (sheet_id) GROUP BY ALL),
 cr AS (SELECT sheet_id, 'geometry-main' AS region_id, 'Geometry' AS region_kind, min_x, min_y, max_x, max_y, score AS confidence FROM k0 UNION ALL SELECT sheet_id, 'drawing-content', 'DimensionNote', min_x, min_y, max_x, max_y, greatest(0.45::DOUBLE, score - 0.03::DOUBLE) FROM k0
  UNION ALL SELECT sheet_id, region_id, region_kind, x0, y0, x1, y1, least(0.90::DOUBLE, 0.40::DOUBLE + t * 0.05::DOUBLE + l * 0.03::DOUBLE + w * 0.10::DOUBLE) FROM bn WHERE t >= 3 AND (l >= 2 OR w >= 1) UNION ALL SELECT sheet_id, 'whole-sheet-unknown', 'Unknown', s_min_x, s_min_y, s_max_x, s_max_y, 0.15::DOUBLE FROM s WHERE sheet_id NOT IN (SELECT sheet_id FROM k0))"""


@entry("content_regions", f"{CONTENT_SQL} SELECT sheet_id, region_id, region_kind, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y, round(confidence, 6) AS confidence FROM cr")
def content_regions(e):
    return V.content_regions(e).select("sheet_id", "region_id", "region_kind", *[r(c) for c in (*V.BOX, "confidence")])


RELATIONS_SQL = f"""{VIEWS_SQL}, rp AS (SELECT a.sheet_id, a.view_id AS a, b.view_id AS b, (b.min_x + b.max_x - a.min_x - a.max_x) * 0.5 AS dx, (b.min_y + b.max_y - a.min_y - a.max_y) * 0.5 AS dy, a.max_x - a.min_x AS aw, a.max_y - a.min_y AS ah, b.max_x - b.min_x AS bw, b.max_y - b.min_y AS bh,
  greatest(0, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * greatest(0, least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)) AS common, (b.min_x + b.max_x) * 0.5 BETWEEN a.min_x - 1e-6 AND a.max_x + 1e-6 AND (b.min_y + b.max_y) * 0.5 BETWEEN a.min_y - 1e-6 AND a.max_y + 1e-6 AS b_in_a,
  (a.min_x + a.max_x) * 0.5 BETWEEN b.min_x - 1e-6 AND b.max_x + 1e-6 AND (a.min_y + a.max_y) * 0.5 BETWEEN b.min_y - 1e-6 AND b.max_y + 1e-6 AS a_in_b FROM v a JOIN v b ON a.sheet_id = b.sheet_id AND a.view_id < b.view_id),
 rq AS (SELECT *, CASE WHEN aw + bw > 2e-9 THEN abs(dx) / ((aw + bw) * 0.5) ELSE 0 END AS far_x, CASE WHEN ah + bh > 2e-9 THEN abs(dy) / ((ah + bh) * 0.5) ELSE 0 END AS far_y, ah + bh > 2e-9 AND abs(dy) <= (ah + bh) * 0.5 * 0.35 AS in_row, aw + bw > 2e-9 AND abs(dx) <= (aw + bw) * 0.5 * 0.35 AS in_column,
  CASE WHEN greatest(aw, bw) > 1e-9 THEN least(aw, bw) / greatest(aw, bw) ELSE 0 END AS wl, CASE WHEN greatest(ah, bh) > 1e-9 THEN least(ah, bh) / greatest(ah, bh) ELSE 0 END AS hl, CASE WHEN greatest(aw * ah, bw * bh) > 1e-9 THEN least(aw * ah, bw * bh) / greatest(aw * ah, bw * bh) ELSE 0 END AS al,
  b_in_a AND bw * bh > 1e-9 AND common / nullif(bw * bh, 0) >= 0.92 AS a_holds, a_in_b AND aw * ah > 1e-9 AND common / nullif(aw * ah, 0) >= 0.92 AS b_holds FROM rp),
 rr AS (SELECT *, CASE WHEN (a_holds AND bw * bh <= 0.08 * aw * ah AND bw <= 0.35 * aw AND bh <= 0.35 * ah) OR (b_holds AND aw * ah <= 0.08 * bw * bh AND aw <= 0.35 * bw AND ah <= 0.35 * bh) THEN 'EmbeddedFeature' WHEN a_holds OR b_holds THEN 'ParentChildContainment'
  WHEN (in_row OR in_column) AND wl >= 0.45 AND hl >= 0.45 AND al >= 0.20 AND far_x <= 4 AND far_y <= 4 THEN 'ProjectionCandidate' WHEN in_row OR in_column OR common > 1e-6 THEN 'WeakNeighbor' ELSE 'Unknown' END AS relation,
  CASE WHEN abs(dx) <= 1e-6 AND abs(dy) <= 1e-6 THEN 'Overlapping' WHEN in_row OR (NOT in_column AND abs(dx) >= abs(dy)) THEN CASE WHEN dx >= 0 THEN 'Right' ELSE 'Left' END ELSE CASE WHEN dy >= 0 THEN 'Above' ELSE 'Below' END END AS position FROM rq)"""


@entry("view_relations", f"{RELATIONS_SQL} SELECT a, b, relation, position, round(wl, 6) AS width_like, round(hl, 6) AS height_like, round(al, 6) AS area_like FROM rr")
def view_relations(e):
    x = V.relations(block_views(e))
    return x.select(F.col("a_view_id").alias("a"), F.col("b_view_id").alias("b"), "relation", "position", r("width_like"), r("height_like"), r("area_like"))


def _projection(position: str) -> str:
    late = lambda f: f"CASE WHEN {f} > 2.5 THEN least(0.5::DOUBLE, ({f} - 2.5) * 0.2) ELSE 0 END"
    return (
        f"CASE WHEN {position} IN ('Above', 'Below') THEN greatest(0, CASE WHEN in_column THEN 0.9 ELSE 0 END::DOUBLE + wl * 1.2 + hl * 0.15 + al * 0.1 - {late('far_y')} + 0.25)"
        f" WHEN {position} IN ('Left', 'Right') THEN greatest(0, CASE WHEN in_row THEN 0.9 ELSE 0 END::DOUBLE + hl * 1.2 + wl * 0.15 + al * 0.1 - {late('far_x')} + 0.25) ELSE 0 END"
    )


_TURN = "CASE position WHEN 'Left' THEN 'Right' WHEN 'Right' THEN 'Left' WHEN 'Above' THEN 'Below' WHEN 'Below' THEN 'Above' ELSE position END"


@entry("projection_links", f"""{RELATIONS_SQL}, pl AS (SELECT b AS view_id, a AS source_id, position, round({_projection('position')}, 9) AS score FROM rr UNION ALL SELECT a, b, {_TURN}, round({_projection(_TURN)}, 9) FROM rr)
 SELECT view_id, source_id, position, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, source_id) AS k FROM pl WHERE score > 0) WHERE k = 1""")  # fmt: skip
def projection_links(e):
    return V.projection_links(block_views(e)).select("view_id", "source_id", "position", r("score"))


@entry("projection_correspondence", f"""{RELATIONS_SQL}, an AS (SELECT sheet_id, view_id, list_distinct(list((ax - v.min_x) / (v.max_x - v.min_x))) AS p FROM v JOIN e USING (sheet_id) WHERE v.max_x > v.min_x AND ax BETWEEN v.min_x AND v.max_x AND e.kind IN ('Circle', 'Line') GROUP BY sheet_id, view_id),
 q AS (SELECT a, b, wl, 1 - least(1, far_x) AS axis, CASE WHEN p.p IS NULL OR o.p IS NULL THEN 0 ELSE greatest(0, least(1, 1 - list_avg(list_transform(p.p, lambda t: list_min(list_transform(o.p, lambda u: abs(t - u))))))) END AS anchors FROM rr LEFT JOIN an p ON p.sheet_id = rr.sheet_id AND p.view_id = a LEFT JOIN an o ON o.sheet_id = rr.sheet_id AND o.view_id = b)
 SELECT a, b, axis >= 0.6 AND wl >= 0.45 AS is_candidate, round(anchors, 6) AS anchor_match, round(greatest(0, least(1, axis * 0.45 + wl * 0.25 + anchors * 0.30)), 6) AS score FROM q""")  # fmt: skip
def projection_correspondence(e):
    """Pairs one above the other: 0.45 for aligned axes, 0.25 for equal widths, 0.30 for
    anchors (places of circles and lines along a view's width) that match."""
    v = block_views(e)
    c = e.filter("kind IN ('Circle', 'Line')").select("sheet_id", "ax")
    within = prefixed_views(v).join(c, "sheet_id").filter("v_max_x > v_min_x AND ax BETWEEN v_min_x AND v_max_x")
    places = within.groupBy("sheet_id", F.col("v_view_id").alias("view_id")).agg(F.collect_set((F.col("ax") - F.col("v_min_x")) / (F.col("v_max_x") - F.col("v_min_x"))).alias("p"))
    side = lambda s: places.select("sheet_id", F.col("view_id").alias(f"{s}_view_id"), F.col("p").alias(f"{s}_p"))
    x = V.relations(v).join(side("a"), ["sheet_id", "a_view_id"], "left").join(side("b"), ["sheet_id", "b_view_id"], "left")
    match = F.when(F.col("a_p").isNull() | F.col("b_p").isNull(), 0.0).otherwise(V.anchor_match(F.col("a_p"), F.col("b_p")))
    x = x.withColumn("axis", F.lit(1.0) - B.clamp01(F.col("far_x"))).withColumn("m", match)
    score = B.clamp01(F.col("axis") * 0.45 + F.col("width_like") * 0.25 + F.col("m") * 0.30)
    return x.select(F.col("a_view_id").alias("a"), F.col("b_view_id").alias("b"), ((F.col("axis") >= 0.6) & (F.col("width_like") >= 0.45)).alias("is_candidate"), r("m", "anchor_match"), r(score, "score"))


def prefixed_views(v):
    from drawlake.operators.spatial import prefixed

    return prefixed(v, "v_")


ROLES_SQL = f"""{VIEWS_SQL}, {VPAIRS_SQL}, dd AS (SELECT *, CASE WHEN gx <= 1e-9 AND gy <= 1e-9 THEN 'O' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'R' ELSE 'L' END WHEN dy >= 0 THEN 'A' ELSE 'B' END AS w FROM vs WHERE score >= 0.40),
 ed AS (SELECT source_id AS view_id, count(*) FILTER (w = 'A' AND xo >= 0.45) AS above, count(*) FILTER (w = 'B' AND xo >= 0.45) AS below, count(*) FILTER (w = 'L' AND yo >= 0.45) AS lefts, count(*) FILTER (w = 'R' AND yo >= 0.45) AS rights FROM dd GROUP BY source_id),
 vv AS (SELECT v.sheet_id, v.view_id, max_x - min_x AS w, max_y - min_y AS h, (max_x - min_x) * (max_y - min_y) AS area, max((max_x - min_x) * (max_y - min_y)) OVER (PARTITION BY sheet_id) AS most, coalesce(above, 0) AS above, coalesce(below, 0) AS below, coalesce(lefts, 0) AS lefts, coalesce(rights, 0) AS rights FROM v LEFT JOIN ed USING (view_id)),
 ro AS (SELECT sheet_id, view_id, 0 AS place, 'Front' AS role, round(0.45::DOUBLE * (area / greatest(1e-9, most)) + 0.20::DOUBLE * least(1, above) + 0.20::DOUBLE * least(1, below) + 0.15::DOUBLE * least(1, lefts + rights), 9) AS score FROM vv
  UNION ALL SELECT sheet_id, view_id, 1, 'Top', CASE WHEN below > 0 THEN 0.72 WHEN above > 0 THEN 0.45 ELSE 0.10 END FROM vv UNION ALL SELECT sheet_id, view_id, 2, 'Bottom', CASE WHEN above > 0 THEN 0.72 WHEN below > 0 THEN 0.45 ELSE 0.10 END FROM vv
  UNION ALL SELECT sheet_id, view_id, 3, 'Left', CASE WHEN rights > 0 THEN 0.72 WHEN lefts > 0 THEN 0.45 ELSE 0.10 END FROM vv UNION ALL SELECT sheet_id, view_id, 4, 'Right', CASE WHEN lefts > 0 THEN 0.72 WHEN rights > 0 THEN 0.45 ELSE 0.10 END FROM vv
  UNION ALL SELECT sheet_id, view_id, 5, 'Section', CASE WHEN w > h * 2 OR h > w * 2 THEN 0.40 ELSE 0.15 END FROM vv UNION ALL SELECT sheet_id, view_id, 6, 'Detail', CASE WHEN area <= most * 0.03 THEN 0.55 ELSE 0.10 END FROM vv)"""


@entry("view_roles", f"{ROLES_SQL} SELECT sheet_id, view_id, role, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sheet_id, view_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM ro) WHERE rank <= 3")
def view_roles(e):
    """The three best roles of each view."""
    return V.role_candidates(block_views(e)).filter("rank <= 3")


@entry("role_holders", f"""{ROLES_SQL}, fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, view_id ORDER BY score DESC, place) AS k FROM ro) WHERE k = 1),
 h AS (SELECT fi.sheet_id, role, fi.view_id, row_number() OVER (PARTITION BY fi.sheet_id, role ORDER BY fi.score DESC, area DESC, fi.view_id) AS k FROM fi JOIN vv USING (sheet_id, view_id))
 SELECT sheet_id, role, max(CASE WHEN k = 1 THEN view_id END) AS main_id, coalesce(string_agg(CAST(view_id AS VARCHAR), ',' ORDER BY k) FILTER (k > 1), '') AS other_ids FROM h GROUP BY sheet_id, role""")  # fmt: skip
def role_holders(e):
    """For each sheet and role the main view, the best of those whose first role it is, and
    the others in order."""
    from pyspark.sql import Window as W

    v = block_views(e)
    first = V.role_candidates(v).filter("rank = 1").join(v.select("sheet_id", "view_id", B.box().area.alias("area")), ["sheet_id", "view_id"])
    k = F.row_number().over(W.partitionBy("sheet_id", "role").orderBy(F.col("score").desc(), F.col("area").desc(), "view_id"))
    g = first.withColumn("k", k).groupBy("sheet_id", "role").agg(
        F.max(F.when(F.col("k") == 1, F.col("view_id"))).alias("main_id"), F.array_sort(F.collect_list(F.when(F.col("k") > 1, F.struct("k", "view_id")))).alias("rest")
    )
    return g.select("sheet_id", "role", "main_id", F.array_join(F.transform("rest", lambda x: x["view_id"].cast("string")), ",").alias("other_ids"))
