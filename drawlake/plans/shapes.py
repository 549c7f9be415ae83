"""Queries that relate entities in space: regions, zones, clusters, views, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.operators import drawing as D
from drawlake.operators.spatial import best_per, box_join, connected, prefixed
from drawlake.plans.rows import DIM, GEO, SHEETS_SQL, TEXT
from drawlake.sources.drawings import ENTITIES_SQL, entities

ENTRIES: dict = {}
HIT = "a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y"
REGIONS_SQL = """r AS (
  SELECT sheet_id, 'title-bottom' AS region_id, 'TitleBlock' AS region_kind, s_min_x AS x0, s_min_y AS y0, s_max_x AS x1, s_min_y + (s_max_y - s_min_y) * 0.26 AS y1, 0.7 AS confidence FROM s
  UNION ALL SELECT sheet_id, 'meta-right', 'MetaTable', s_max_x - (s_max_x - s_min_x) * 0.24, s_min_y, s_max_x, s_max_y, 0.68 FROM s
  UNION ALL SELECT sheet_id, 'drawing-core', 'Geometry', s_min_x, s_min_y + (s_max_y - s_min_y) * 0.26, s_max_x - (s_max_x - s_min_x) * 0.24, s_max_y, 0.75 FROM s)"""
SEEDS_SQL = """seeds AS (SELECT sheet_id, handle, kind, min_x, min_y, max_x, max_y FROM (SELECT *, greatest(max_x - min_x, max_y - min_y) AS mx, greatest(least(max_x - min_x, max_y - min_y), 0.001) AS mn,
  sqrt((s_max_x - s_min_x) * (s_max_x - s_min_x) + (s_max_y - s_min_y) * (s_max_y - s_min_y)) AS diag FROM e JOIN s USING (sheet_id))
WHERE kind IN ('Line', 'Polyline', 'Arc', 'Circle', 'Ellipse') AND lower(layer) NOT IN ('cl', 'hl', 'd') AND NOT (max_x - min_x <= 0.5 AND max_y - min_y <= 0.5)
  AND NOT (kind = 'Line' AND (mx >= diag * 0.18 OR (mx >= mn * 40 AND mx >= diag * 0.03))) AND NOT (kind = 'Polyline' AND (mx >= diag * 0.20 OR (mx >= mn * 25 AND mx >= diag * 0.05))))"""
EDGES_SQL = """edges AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM seeds a JOIN seeds b ON a.sheet_id = b.sheet_id AND a.handle < b.handle
  WHERE power(greatest(0, b.min_x - a.max_x, a.min_x - b.max_x), 2) + power(greatest(0, b.min_y - a.max_y, a.min_y - b.max_y), 2) <= 4.0
  AND CASE WHEN a.kind IN ('Line', 'Polyline') AND b.kind IN ('Line', 'Polyline')
      THEN greatest(least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x), least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)) > 0
        AND a.min_x - 1 <= b.max_x AND b.min_x - 1 <= a.max_x AND a.min_y - 1 <= b.max_y AND b.min_y - 1 <= a.max_y
      WHEN a.kind IN ('Arc', 'Circle', 'Ellipse') OR b.kind IN ('Arc', 'Circle', 'Ellipse')
      THEN a.min_x - 0.5 <= b.max_x AND b.min_x - 0.5 <= a.max_x AND a.min_y - 0.5 <= b.max_y AND b.min_y - 0.5 <= a.max_y
      ELSE a.min_x - 0.75 <= b.max_x AND b.min_x - 0.75 <= a.max_x AND a.min_y - 0.75 <= b.max_y AND b.min_y - 0.75 <= a.max_y END)"""


def reach(nodes: str, edges: str, name: str) -> str:
    """Components by transitive closure: name(sheet_id, handle, component)."""
    return (
        f"{name}_r(sheet_id, handle, root) AS (SELECT sheet_id, handle, handle FROM {nodes} UNION SELECT x.sheet_id, CASE WHEN g.a = x.handle THEN g.b ELSE g.a END, x.root "
        f"FROM {name}_r x JOIN {edges} g ON g.sheet_id = x.sheet_id AND (g.a = x.handle OR g.b = x.handle)), {name} AS (SELECT sheet_id, handle, min(root) AS component FROM {name}_r GROUP BY sheet_id, handle)"
    )


CLUSTERS_SQL = f"{SEEDS_SQL}, {EDGES_SQL}, {reach('seeds', 'edges', 'cc')}, c AS (SELECT sheet_id, component AS cluster_id, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, count(*) AS n, count(*) FILTER (kind IN ('Arc', 'Circle', 'Ellipse')) AS rounds FROM seeds JOIN cc USING (sheet_id, handle) GROUP BY ALL)"


def entry(name: str, sql: str | None):
    def register(f):
        text = None if sql is None else f"WITH RECURSIVE {ENTITIES_SQL}, {SHEETS_SQL}, {sql}"
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(entities(spark, sf_dir))), text
        return f

    return register


@entry("touching_pairs", f"n AS (SELECT 1) SELECT a.sheet_id, a.handle AS a_handle, b.handle AS b_handle FROM e a JOIN e b ON a.sheet_id = b.sheet_id AND a.handle < b.handle WHERE {HIT}")
def touching_pairs(e):
    k = e.select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y")
    return box_join(k, k).filter("a_handle < b_handle").select("sheet_id", "a_handle", "b_handle")


@entry("neighbour_pairs", "n AS (SELECT 1) SELECT a.sheet_id, a.handle AS a_handle, b.handle AS b_handle FROM e a JOIN e b ON a.sheet_id = b.sheet_id AND a.handle < b.handle WHERE a.min_x - 2 <= b.max_x AND b.min_x <= a.max_x + 2 AND a.min_y - 2 <= b.max_y AND b.min_y <= a.max_y + 2")
def neighbour_pairs(e):
    k = e.select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y")
    return box_join(k, k, 2.0).filter("a_handle < b_handle").select("sheet_id", "a_handle", "b_handle")


@entry("best_region", f"""{REGIONS_SQL}, p AS (SELECT e.sheet_id, handle, region_id, confidence, (x1 - x0) * (y1 - y0) AS area, ax BETWEEN x0 - 1 AND x1 + 1 AND ay BETWEEN y0 - 1 AND y1 + 1 AS inside,
  greatest(0, least(max_x, x1) - greatest(min_x, x0)) * greatest(0, least(max_y, y1) - greatest(min_y, y0)) AS common, (max_x - min_x) * (max_y - min_y) AS ea,
  sqrt(power(greatest(0, x0 - max_x, min_x - x1), 2) + power(greatest(0, y0 - max_y, min_y - y1), 2)) AS gap FROM e JOIN r USING (sheet_id)),
 t AS (SELECT *, CASE WHEN inside THEN 0 WHEN common > 0 AND least(ea, area) > 0 THEN 1 WHEN gap <= 12 THEN 2 END AS tier FROM p)
SELECT handle, region_id, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, handle ORDER BY tier, CASE tier WHEN 0 THEN 0 WHEN 1 THEN -common / least(ea, area) ELSE gap END, area, confidence DESC, region_id) AS k FROM t WHERE tier IS NOT NULL) WHERE k = 1""")  # fmt: skip
def best_region(e):
    return D.best_region(e, D.band_regions(e)).filter("region_id IS NOT NULL").select("handle", "region_id", "tier")


@entry("scored_region", f"""{REGIONS_SQL}, p AS (SELECT handle, e.sheet_id, region_id, CASE WHEN ax BETWEEN x0 AND x1 AND ay BETWEEN y0 AND y1 THEN 1.0 ELSE 0.0 END AS score FROM e JOIN r ON e.sheet_id = r.sheet_id WHERE min_x <= x1 AND x0 <= max_x AND min_y <= y1 AND y0 <= max_y)
SELECT handle, region_id, score FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, handle ORDER BY score DESC, region_id) AS k FROM p WHERE score >= 0.15) WHERE k = 1""")  # fmt: skip
def scored_region(e):
    return D.scored_region(e, D.band_regions(e)).filter("region_id IS NOT NULL").select("handle", "region_id", "score")


@entry("region_roles", f"""n AS (SELECT *, CASE WHEN ay <= s_min_y + (s_max_y - s_min_y) * 0.26 THEN 'TitleBlock' WHEN ax >= s_max_x - (s_max_x - s_min_x) * 0.24 THEN 'MetaTable' ELSE 'Geometry' END AS rk,
  kind IN ('Line', 'Polyline') AND greatest(max_x - min_x, max_y - min_y) > 0 AND (least(max_x - min_x, max_y - min_y) = 0 OR greatest(max_x - min_x, max_y - min_y) >= least(max_x - min_x, max_y - min_y) * 8) AS border,
  upper(trim(coalesce(text, ''))) AS t FROM e JOIN s USING (sheet_id)),
 m AS (SELECT *, contains(t, 'QTY') OR contains(t, 'MAT') OR contains(t, 'SCALE') OR contains(t, 'NO') OR contains(t, 'SPEC') AS lab, regexp_matches(t, '^[A-Z0-9\\-\\._/ ]{{1,40}}$') AND trim(t) <> '' AS val FROM n)
SELECT handle, CASE WHEN rk = 'Geometry' THEN CASE WHEN kind IN {DIM} THEN 'Dimension' WHEN kind IN {TEXT} THEN 'Text' WHEN kind IN {GEO} THEN 'Geometry' ELSE 'Symbol' END
  WHEN border THEN 'TableBorder' WHEN kind IN {TEXT} AND lab THEN 'MetaLabel' WHEN kind IN {TEXT} AND val THEN 'MetaValue'
  WHEN kind IN {TEXT} THEN CASE WHEN rk = 'TitleBlock' AND trim(t) <> '' AND length(t) >= 4 THEN 'TitleText' ELSE 'Text' END
  WHEN kind IN {DIM} THEN 'Dimension' WHEN kind IN {GEO} THEN 'Symbol' ELSE 'Unknown' END AS role,
 CASE WHEN rk = 'Geometry' THEN CASE WHEN kind IN {DIM} THEN 0.92 WHEN kind IN {TEXT} THEN 0.72 WHEN kind IN {GEO} THEN 0.90 ELSE 0.45 END
  WHEN rk = 'MetaTable' THEN CASE WHEN border THEN 0.92 WHEN kind IN {TEXT} AND lab THEN 0.93 WHEN kind IN {TEXT} AND val THEN 0.82 WHEN kind IN {TEXT} THEN 0.60 WHEN kind IN {DIM} THEN 0.55 WHEN kind IN {GEO} THEN 0.52 ELSE 0.20 END
  ELSE CASE WHEN border THEN 0.88 WHEN kind IN {TEXT} AND lab THEN 0.86 WHEN kind IN {TEXT} AND val THEN 0.74 WHEN kind IN {TEXT} AND trim(t) <> '' AND length(t) >= 4 THEN 0.82 WHEN kind IN {TEXT} THEN 0.58 WHEN kind IN {GEO} THEN 0.48 WHEN kind IN {DIM} THEN 0.42 ELSE 0.20 END END::DOUBLE AS confidence FROM m""")  # fmt: skip
def region_roles(e):
    role, confidence = D.region_role(F.col("region_kind"))
    joined = e.join(D.preliminary_region(e), ["sheet_id", "handle"])
    return joined.select("handle", role.alias("role"), confidence.alias("confidence"))


@entry("region_binding", "p AS (SELECT e.sheet_id, kind, CASE WHEN ay <= s_min_y + (s_max_y - s_min_y) * 0.26 THEN 'title-bottom' WHEN ax >= s_max_x - (s_max_x - s_min_x) * 0.24 THEN 'meta-right' ELSE 'drawing-core' END AS region_id FROM e JOIN s USING (sheet_id)) SELECT sheet_id, region_id, count(*) AS members FROM p GROUP BY ALL")
def region_binding(e):
    members = D.preliminary_region(e).groupBy("sheet_id", "region_id").agg(F.count(F.lit(1)).alias("members"))
    return D.band_regions(e).join(members, ["sheet_id", "region_id"]).select("sheet_id", "region_id", "members")


@entry("simple_regions", f"""z AS (SELECT *, greatest(s_max_x - s_min_x, 1) AS w, greatest(s_max_y - s_min_y, 1) AS h FROM e JOIN s USING (sheet_id)),
 m AS (SELECT *, 'meta-top' AS region_id FROM z WHERE max_y >= s_min_y + h * 0.72 UNION ALL SELECT *, 'meta-right' FROM z WHERE max_x >= s_min_x + w * 0.72
  UNION ALL SELECT *, 'geom-main' FROM z WHERE kind IN {GEO} AND min_x <= s_max_x - w * 0.12 AND max_x >= s_min_x + w * 0.08 AND min_y <= s_max_y - h * 0.12 AND max_y >= s_min_y + h * 0.08)
SELECT sheet_id, region_id, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, count(*) AS n FROM m GROUP BY sheet_id, region_id""")  # fmt: skip
def simple_regions(e):
    return D.simple_regions(e)


STRIPS_SQL = f"""wk AS (SELECT sheet_id, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM e WHERE kind NOT IN {TEXT} GROUP BY sheet_id),
 bs AS (SELECT s.sheet_id, CASE WHEN x1 > x0 AND y1 > y0 THEN greatest(s_min_x, x0 - 2) ELSE s_min_x END AS zx0, CASE WHEN x1 > x0 AND y1 > y0 THEN greatest(s_min_y, y0 - 2) ELSE s_min_y END AS zy0,
  CASE WHEN x1 > x0 AND y1 > y0 THEN least(s_max_x, x1 + 2) ELSE s_max_x END AS zx1, CASE WHEN x1 > x0 AND y1 > y0 THEN least(s_max_y, y1 + 2) ELSE s_max_y END AS zy1 FROM s LEFT JOIN wk USING (sheet_id)),
 st AS (SELECT *, 'BottomTitleBlock' AS zone, zx0 AS rx0, zy0 AS ry0, zx1 AS rx1, zy0 + (zy1 - zy0) * 0.28 AS ry1 FROM bs UNION ALL SELECT *, 'RightMetaBand', zx1 - (zx1 - zx0) * 0.22, zy0, zx1, zy1 FROM bs
  UNION ALL SELECT *, 'LeftBorderAnnotations', zx0, zy0, zx0 + (zx1 - zx0) * 0.10, zy1 FROM bs),
 zp AS (SELECT e.*, st.* EXCLUDE (sheet_id), ax BETWEEN rx0 - 2 AND rx1 + 2 AND ay BETWEEN ry0 - 2 AND ry1 + 2 AS rep, min_x >= rx0 - 2 AND max_x <= rx1 + 2 AND min_y >= ry0 - 2 AND max_y <= ry1 + 2 AS inside,
  min_x <= rx1 + 4 AND rx0 <= max_x + 4 AND min_y <= ry1 + 4 AND ry0 <= max_y + 4 AS touch,
  CASE WHEN (max_x - min_x) * (max_y - min_y) > 0 THEN greatest(0, least(max_x, rx1) - greatest(min_x, rx0)) * greatest(0, least(max_y, ry1) - greatest(min_y, ry0)) / ((max_x - min_x) * (max_y - min_y)) ELSE 0 END AS share FROM e JOIN st USING (sheet_id)),
 zm AS (SELECT * FROM zp WHERE CASE WHEN kind IN {TEXT} THEN rep OR touch WHEN kind IN ('Line', 'Polyline') THEN rep OR inside OR share >= 0.35 WHEN kind = 'BlockReference' THEN rep AND touch ELSE rep OR inside END)"""


@entry("zone_members", f"{STRIPS_SQL} SELECT handle, zone FROM zm")
def zone_members(e):
    return D.zone_members(e).select("handle", F.col("r_zone").alias("zone"))


def _hits() -> str:
    return " + ".join(
        f"max(CASE WHEN zone = '{z}' AND kind IN {TEXT} AND contains(upper(trim(text)), '{w.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END)" for z, (_, _, words) in D.ZONES.items() for w in words
    )


ZONES_SQL = f"""{STRIPS_SQL}, zg AS (SELECT sheet_id, zone, min(min_x) AS mx0, min(min_y) AS my0, max(max_x) AS mx1, max(max_y) AS my1, any_value(rx0) AS rx0, any_value(ry0) AS ry0, any_value(rx1) AS rx1, any_value(ry1) AS ry1,
  any_value(zx0) AS zx0, any_value(zy0) AS zy0, any_value(zx1) AS zx1, any_value(zy1) AS zy1, count(*) FILTER (kind IN {TEXT}) AS text_count, CAST({_hits()} AS BIGINT) AS keyword_hits,
  count(*) FILTER (kind IN ('Line', 'Polyline') AND max_x - min_x >= (zx1 - zx0) * 0.18) AS lh, count(*) FILTER (kind IN ('Line', 'Polyline') AND max_y - min_y >= (zy1 - zy0) * 0.18) AS lv FROM zm GROUP BY sheet_id, zone),
 zi AS (SELECT *, least(mx1, rx1) > greatest(mx0, rx0) AND least(my1, ry1) > greatest(my0, ry0) AS good FROM zg),
 zf AS (SELECT *, CASE WHEN good THEN greatest(mx0, rx0) ELSE rx0 END AS min_x, CASE WHEN good THEN greatest(my0, ry0) ELSE ry0 END AS min_y, CASE WHEN good THEN least(mx1, rx1) ELSE rx1 END AS max_x, CASE WHEN good THEN least(my1, ry1) ELSE ry1 END AS max_y FROM zi),
 zs AS (SELECT *, text_count * 0.25 + keyword_hits * 1.0 + lh * 0.4 + lv * 0.4 + CASE WHEN abs(min_y - zy0) <= 8 THEN 1.0 ELSE 0.0 END + CASE WHEN abs(max_x - zx1) <= 8 THEN 1.0 ELSE 0.0 END AS score,
  (max_x - min_x) * (max_y - min_y) / ((zx1 - zx0) * (zy1 - zy0)) AS part FROM zf),
 zones AS (SELECT sheet_id, zone, CASE zone WHEN 'BottomTitleBlock' THEN 'TitleBlockTable' WHEN 'RightMetaBand' THEN 'MetaTextBand' ELSE 'BorderAnnotationBand' END AS zone_kind, min_x, min_y, max_x, max_y, CAST(score AS DOUBLE) AS score, text_count, keyword_hits
  FROM zs WHERE part > 0 AND part <= CASE zone WHEN 'BottomTitleBlock' THEN 0.45 WHEN 'RightMetaBand' THEN 0.40 ELSE 0.20 END AND text_count >= 3 AND score >= 2
  AND (zone <> 'BottomTitleBlock' OR abs(min_y - zy0) <= 8) AND (zone <> 'RightMetaBand' OR abs(max_x - zx1) <= 8))"""


@entry("exclusion_zones", f"{ZONES_SQL} SELECT sheet_id, zone, zone_kind, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y, round(score, 6) AS score, text_count, keyword_hits FROM zones")
def exclusion_zones(e):
    r = lambda c: F.round(c, 6).alias(c)
    return D.exclusion_zones(e).select("sheet_id", "zone", "zone_kind", r("min_x"), r("min_y"), r("max_x"), r("max_y"), r("score"), "text_count", "keyword_hits")


FRAME_SQL = """fc AS (SELECT *, (max_x - min_x) * (max_y - min_y) / ((s_max_x - s_min_x) * (s_max_y - s_min_y)) AS coverage FROM e JOIN s USING (sheet_id) WHERE max_x > min_x AND max_y > min_y),
 fr AS (SELECT * FROM fc WHERE coverage BETWEEN 0.85 AND 1.02)"""


@entry("outer_frame", f"{FRAME_SQL} SELECT sheet_id, min(handle) AS handle FROM fr GROUP BY sheet_id")
def outer_frame(e):
    return D.outer_frame(e).select("sheet_id", "handle")


@entry("content_isolation", f"""{ZONES_SQL}, {FRAME_SQL}, gone AS (SELECT DISTINCT zm.sheet_id, handle FROM zm JOIN zones ON zm.sheet_id = zones.sheet_id AND zm.zone = zones.zone),
 kept AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.sheet_id = e.sheet_id AND g.handle = e.handle) AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.sheet_id = e.sheet_id
  AND ((e.min_x >= z.min_x - 2 AND e.max_x <= z.max_x + 2 AND e.min_y >= z.min_y - 2 AND e.max_y <= z.max_y + 2) OR (ax BETWEEN z.min_x - 2 AND z.max_x + 2 AND ay BETWEEN z.min_y - 2 AND z.max_y + 2))))
SELECT sheet_id, count(*) AS n, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM kept WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.sheet_id = kept.sheet_id) GROUP BY sheet_id""")  # fmt: skip
def content_isolation(e):
    """No sheet of these tables has an entity that covers it, so the SQL leaves the frame out."""
    return D.sheet_bounds(D.residual_content(e)).select("sheet_id", "n", "min_x", "min_y", "max_x", "max_y")


@entry("union_edges", f"{SEEDS_SQL}, {EDGES_SQL} SELECT sheet_id, a, b FROM edges")
def union_edges(e):
    return D.union_edges(D.seed_filter(e))


@entry("geometry_clusters", f"{SEEDS_SQL}, {EDGES_SQL}, {reach('seeds', 'edges', 'cc')} SELECT handle, component AS cluster_id FROM cc")
def geometry_clusters(e):
    return D.geometry_clusters(e).select("handle", "cluster_id")


@entry("cluster_boxes", f"{CLUSTERS_SQL} SELECT sheet_id, cluster_id, min_x, min_y, max_x, max_y, n FROM c")
def cluster_boxes(e):
    return D.cluster_boxes(e)


@entry("attach_nearest", f"""{CLUSTERS_SQL}, p AS (SELECT e.sheet_id, handle, cluster_id, sqrt(power(greatest(0, c.min_x - e.max_x, e.min_x - c.max_x), 2) + power(greatest(0, c.min_y - e.max_y, e.min_y - c.max_y), 2)) AS d FROM e JOIN c USING (sheet_id) WHERE kind IN {TEXT} OR kind IN {DIM}),
 k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, handle ORDER BY d, cluster_id) AS k FROM p WHERE d <= 80)
SELECT e.handle, k.cluster_id, round(k.d, 6) AS distance FROM e LEFT JOIN k ON k.handle = e.handle AND k.sheet_id = e.sheet_id AND k.k = 1 WHERE kind IN {TEXT} OR kind IN {DIM}""")  # fmt: skip
def attach_nearest(e):
    return D.attach_nearest(e, D.cluster_boxes(e)).select("handle", "cluster_id", F.round("distance", 6).alias("distance"))


@entry("frame_like", f"""{CLUSTERS_SQL}, t AS (SELECT *, (abs(min_x - s_min_x) <= tol)::INT + (abs(min_y - s_min_y) <= tol)::INT + (abs(max_x - s_max_x) <= tol)::INT + (abs(max_y - s_max_y) <= tol)::INT AS edges FROM (SELECT c.*, s.* EXCLUDE (sheet_id), greatest(s_max_x - s_min_x, s_max_y - s_min_y) * 0.015 AS tol FROM c JOIN s USING (sheet_id)))
SELECT sheet_id, cluster_id, ((max_x - min_x) * (max_y - min_y) / ((s_max_x - s_min_x) * (s_max_y - s_min_y)) >= 0.72)::INT + ((max_x - min_x) / (s_max_x - s_min_x) >= 0.9)::INT + ((max_y - min_y) / (s_max_y - s_min_y) >= 0.9)::INT + (edges >= 3)::INT
 + (sqrt(power((min_x + max_x - s_min_x - s_max_x) * 0.5, 2) + power((min_y + max_y - s_min_y - s_max_y) * 0.5, 2)) / sqrt(power(s_max_x - s_min_x, 2) + power(s_max_y - s_min_y, 2)) <= 0.05)::INT + (n <= 12 AND rounds <= n * 0.2)::INT AS points FROM t""")  # fmt: skip
def frame_like(e):
    seeds = D.geometry_clusters(e)
    c = seeds.groupBy("sheet_id", "cluster_id").agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.count(F.lit(1)).alias("n"), F.count_if(K.is_round(F.col("kind"))).alias("rounds")
    )
    return D.frame_like(c, D.sheet_bounds(e)).select("sheet_id", "cluster_id", "points")


VIEWS_SQL = "v AS (SELECT sheet_id, handle AS view_id, min_x, min_y, max_x, max_y FROM e WHERE kind = 'BlockReference')"
VPAIRS_SQL = """vp AS (SELECT a.sheet_id, a.view_id AS source_id, b.view_id AS target_id, greatest(0, b.min_x - a.max_x, a.min_x - b.max_x) AS gx, greatest(0, b.min_y - a.max_y, a.min_y - b.max_y) AS gy,
  (b.min_x + b.max_x) * 0.5 - (a.min_x + a.max_x) * 0.5 AS dx, (b.min_y + b.max_y) * 0.5 - (a.min_y + a.max_y) * 0.5 AS dy, least(a.max_x - a.min_x, b.max_x - b.min_x) AS mx, least(a.max_y - a.min_y, b.max_y - b.min_y) AS my,
  greatest(0, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) AS ox, greatest(0, least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)) AS oy,
  greatest(1e-9, least(sqrt((a.max_x - a.min_x) * (a.max_x - a.min_x) + (a.max_y - a.min_y) * (a.max_y - a.min_y)), sqrt((b.max_x - b.min_x) * (b.max_x - b.min_x) + (b.max_y - b.min_y) * (b.max_y - b.min_y)))) AS dg
  FROM v a JOIN v b ON a.sheet_id = b.sheet_id AND a.view_id <> b.view_id),
 vr AS (SELECT *, CASE WHEN mx > 1e-9 THEN ox / mx ELSE 0 END AS xo, CASE WHEN my > 1e-9 THEN oy / my ELSE 0 END AS yo, greatest(gx, gy) / dg AS gap FROM vp),
 vs AS (SELECT *, 0.6::DOUBLE * greatest(xo, yo) + 0.4::DOUBLE * (1 - least(1, gap / 1.5::DOUBLE)) AS score FROM vr)"""


def block_views(e):
    return e.filter("kind = 'BlockReference'").select("sheet_id", F.col("handle").alias("view_id"), "min_x", "min_y", "max_x", "max_y")


@entry("view_pairs", f"""{VIEWS_SQL}, {VPAIRS_SQL} SELECT source_id, target_id, CASE WHEN gx <= 1e-9 AND gy <= 1e-9 THEN 'Overlapping' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'RightOf' ELSE 'LeftOf' END WHEN dy >= 0 THEN 'Above' ELSE 'Below' END AS direction, round(xo, 6) AS x_overlap, round(yo, 6) AS y_overlap, round(score, 6) AS score FROM vs""")
def view_pairs(e):
    r = lambda c: F.round(c, 6).alias(c)
    return D.view_pairs(block_views(e)).select("source_id", "target_id", "direction", r("x_overlap"), r("y_overlap"), r("score"))


@entry("view_degree", f"{VIEWS_SQL}, {VPAIRS_SQL} SELECT sheet_id, source_id AS view_id, count(*) AS strong FROM vs WHERE score >= 0.40 GROUP BY sheet_id, source_id")
def view_degree(e):
    return D.view_pairs(block_views(e)).filter("score >= 0.40").groupBy("sheet_id", F.col("source_id").alias("view_id")).agg(F.count(F.lit(1)).alias("strong"))


@entry("dimension_owner", f"""{VIEWS_SQL}, {VPAIRS_SQL}, sg AS (SELECT source_id AS view_id, count(*) AS strong FROM vs WHERE score >= 0.40 GROUP BY source_id),
 d AS (SELECT *, CASE WHEN max_x - min_x > (max_y - min_y) * 1.25 THEN 'H' WHEN max_y - min_y > (max_x - min_x) * 1.25 THEN 'V' ELSE 'U' END AS o FROM e WHERE kind = 'Dimension'),
 p AS (SELECT d.sheet_id, d.handle, d.o, v.view_id, coalesce(strong, 0) AS strong, (ay > v.max_y OR ay < v.min_y) AS by_, (ax < v.min_x OR ax > v.max_x) AS bx_,
  CASE WHEN least(d.max_x - d.min_x, v.max_x - v.min_x) > 1e-9 THEN greatest(0, least(d.max_x, v.max_x) - greatest(d.min_x, v.min_x)) / least(d.max_x - d.min_x, v.max_x - v.min_x) ELSE 0 END AS xo,
  CASE WHEN least(d.max_y - d.min_y, v.max_y - v.min_y) > 1e-9 THEN greatest(0, least(d.max_y, v.max_y) - greatest(d.min_y, v.min_y)) / least(d.max_y - d.min_y, v.max_y - v.min_y) ELSE 0 END AS yo,
  greatest(0, v.min_x - d.max_x, d.min_x - v.max_x, v.min_y - d.max_y, d.min_y - v.max_y) / greatest(1e-9, least(sqrt((d.max_x - d.min_x) * (d.max_x - d.min_x) + (d.max_y - d.min_y) * (d.max_y - d.min_y)), sqrt((v.max_x - v.min_x) * (v.max_x - v.min_x) + (v.max_y - v.min_y) * (v.max_y - v.min_y)))) AS gap
  FROM d JOIN v USING (sheet_id) LEFT JOIN sg USING (view_id)),
 q AS (SELECT *, round(0.35::DOUBLE * CASE WHEN o = 'H' AND NOT by_ THEN 0.15 WHEN o = 'H' THEN 0.35 + 0.65 * xo WHEN o = 'V' AND NOT bx_ THEN 0.15 WHEN o = 'V' THEN 0.35 + 0.65 * yo ELSE 1 - least(1, gap / 1.2) END
  + 0.25 * CASE o WHEN 'H' THEN xo WHEN 'V' THEN yo ELSE 1 - least(1, gap / 1.2) END + 0.20 * (1 - least(1, gap / 1.5)) + 0.20 * least(1, strong / 3.0), 9) AS score FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, handle ORDER BY score DESC, view_id) AS k, lead(score) OVER (PARTITION BY sheet_id, handle ORDER BY score DESC, view_id) AS second FROM q)
SELECT handle, CASE WHEN score < 0.55 THEN 'Unresolved' WHEN second IS NOT NULL AND score - second < 0.08 THEN 'Ambiguous' ELSE 'Resolved' END AS status, round(score, 6) AS score FROM k WHERE k = 1""")  # fmt: skip
def dimension_owner(e):
    return D.dimension_owner(D.dimension_semantics(e), block_views(e)).select("handle", "status", F.round("score", 6).alias("score"))


@entry("view_merge", None)
def view_merge(e):
    """Merged views; checked against a brute-force version in the tests."""
    clusters = D.cluster_boxes(e).withColumnRenamed("cluster_id", "view_id")
    edges = D.merge_edges(clusters, D.sheet_bounds(e))
    return connected(clusters.withColumnRenamed("view_id", "handle"), edges).groupBy("sheet_id", F.col("component").alias("view_id")).agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"))


@entry("dimension_bands", f"d AS (SELECT sheet_id, handle, min_x - 4 AS min_x, min_y - 4 AS min_y, max_x + 4 AS max_x, max_y + 4 AS max_y FROM e WHERE kind = 'Dimension'), g AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM d a JOIN d b ON a.sheet_id = b.sheet_id AND a.handle < b.handle WHERE {HIT}), {reach('d', 'g', 'cc')} SELECT handle, component AS band_id FROM cc")
def dimension_bands(e):
    d = e.filter("kind = 'Dimension'").select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y")
    edges = box_join(d, d, 8.0).filter("a_handle < b_handle").select("sheet_id", F.col("a_handle").alias("a"), F.col("b_handle").alias("b"))
    return connected(d, edges).select("handle", F.col("component").alias("band_id"))


@entry("text_clusters", f"d AS (SELECT sheet_id, handle, min_x, min_y, max_x, max_y, ax, ay FROM e WHERE kind IN {TEXT}), g AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM d a JOIN d b ON a.sheet_id = b.sheet_id AND a.handle < b.handle WHERE power(greatest(0, b.min_x - a.max_x, a.min_x - b.max_x), 2) + power(greatest(0, b.min_y - a.max_y, a.min_y - b.max_y), 2) <= 144 OR power(a.ax - b.ax, 2) + power(a.ay - b.ay, 2) <= 1225), {reach('d', 'g', 'cc')} SELECT handle, component AS text_cluster FROM cc")
def text_clusters(e):
    d = e.filter(K.is_text(F.col("kind"))).select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y", "ax", "ay")
    a, b = B.box("a_"), B.box("b_")
    near = (B.box_distance(a, b) <= 12.0) | (B.point_distance(F.col("a_ax"), F.col("a_ay"), F.col("b_ax"), F.col("b_ay")) <= 35.0)
    edges = box_join(d, d, 35.0).filter((F.col("a_handle") < F.col("b_handle")) & near).select("sheet_id", F.col("a_handle").alias("a"), F.col("b_handle").alias("b"))
    return connected(d, edges).select("handle", F.col("component").alias("text_cluster"))


CELLS_SQL = """gc AS (SELECT e.sheet_id, handle, (s_max_x - s_min_x) / 30 AS cw, (s_max_y - s_min_y) / 20 AS ch, min_x, max_x, min_y, max_y, ax, ay, s_min_x, s_min_y FROM e JOIN s USING (sheet_id) WHERE s_max_x > s_min_x AND s_max_y > s_min_y),
 gr AS (SELECT sheet_id, handle, greatest(0, least(29, CAST(floor((min_x - s_min_x) / cw) AS INT))) AS c0, greatest(0, least(29, CAST(floor((max_x - s_min_x) / cw) AS INT))) AS c1, greatest(0, least(19, CAST(floor((min_y - s_min_y) / ch) AS INT))) AS r0, greatest(0, least(19, CAST(floor((max_y - s_min_y) / ch) AS INT))) AS r1,
  greatest(0, least(29, CAST(floor((ax - s_min_x) / cw) AS INT))) AS ac, greatest(0, least(19, CAST(floor((ay - s_min_y) / ch) AS INT))) AS ar FROM gc),
 cells AS (SELECT sheet_id, CAST(r.r AS INTEGER) AS row, CAST(c.c AS INTEGER) AS col, count(*) AS box_hits, count(*) FILTER (ac = c.c AND ar = r.r) AS anchor_hits, min(handle) AS first_handle FROM gr, range(20) r(r), range(30) c(c) WHERE r.r BETWEEN r0 AND r1 AND c.c BETWEEN c0 AND c1 GROUP BY sheet_id, r.r, c.c)"""


@entry("occupied_cells", f"{CELLS_SQL} SELECT * FROM cells")
def occupied_cells(e):
    return D.occupied_cells(e)


@entry("grid_islands", None)
def grid_islands(e):
    return D.grid_islands(D.occupied_cells(e.filter("kind = 'Circle'")))


@entry("island_overlaps", f"v AS (SELECT * FROM e WHERE kind = 'BlockReference') SELECT v.sheet_id, v.handle AS view_id, count(d.handle) AS dimensions FROM v LEFT JOIN e d ON d.sheet_id = v.sheet_id AND d.kind IN {DIM} AND d.min_x <= v.max_x AND v.min_x <= d.max_x AND d.min_y <= v.max_y AND v.min_y <= d.max_y GROUP BY v.sheet_id, v.handle")
def island_overlaps(e):
    k = ("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y")
    v = e.filter("kind = 'BlockReference'").select(*k)
    hits = box_join(v, e.filter(K.is_dimension(F.col("kind"))).select(*k)).groupBy("sheet_id", F.col("a_handle").alias("handle")).agg(F.count(F.lit(1)).alias("n"))
    return v.join(hits, ["sheet_id", "handle"], "left").select("sheet_id", F.col("handle").alias("view_id"), F.coalesce("n", F.lit(0)).alias("dimensions"))


@entry("island_contents", f"v AS (SELECT * FROM e WHERE kind = 'BlockReference') SELECT v.sheet_id, v.handle AS view_id, count(*) FILTER (d.kind IN {TEXT}) AS texts, count(*) FILTER (d.kind IN {GEO}) AS geometry FROM v JOIN e d ON d.sheet_id = v.sheet_id AND d.min_x <= v.max_x AND v.min_x <= d.max_x AND d.min_y <= v.max_y AND v.min_y <= d.max_y GROUP BY v.sheet_id, v.handle")
def island_contents(e):
    k = ("sheet_id", "handle", "kind", "min_x", "min_y", "max_x", "max_y")
    pairs = box_join(e.filter("kind = 'BlockReference'").select(*k), e.select(*k))
    b = F.col("b_kind")
    return pairs.groupBy("sheet_id", F.col("a_handle").alias("view_id")).agg(F.count_if(K.is_text(b)).alias("texts"), F.count_if(K.is_geometry(b)).alias("geometry"))


@entry("containment_parent", "p AS (SELECT a.handle, b.handle AS parent, row_number() OVER (PARTITION BY a.sheet_id, a.handle ORDER BY (b.max_x - b.min_x) * (b.max_y - b.min_y), b.handle) AS k FROM e a JOIN e b ON a.sheet_id = b.sheet_id AND a.handle <> b.handle WHERE a.min_x >= b.min_x AND a.max_x <= b.max_x AND a.min_y >= b.min_y AND a.max_y <= b.max_y AND (b.max_x - b.min_x) * (b.max_y - b.min_y) > (a.max_x - a.min_x) * (a.max_y - a.min_y)) SELECT handle, parent FROM p WHERE k = 1")
def containment_parent(e):
    k = e.select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y")
    a, b = B.box("a_"), B.box("b_")
    pairs = box_join(k, k).filter((F.col("a_handle") != F.col("b_handle")) & B.contains_box(b, a) & (b.area > a.area)).withColumn("_area", b.area)
    return best_per(pairs, ["sheet_id", "a_handle"], [F.col("_area"), F.col("b_handle")]).select(F.col("a_handle").alias("handle"), F.col("b_handle").alias("parent"))


@entry("nearest_value", "l AS (SELECT * FROM e WHERE text LIKE 'QTY%'), v AS (SELECT * FROM e WHERE text LIKE '% EA'), p AS (SELECT sheet_id, l.handle, v.handle AS value_handle, sqrt((l.ax - v.ax) * (l.ax - v.ax) + (l.ay - v.ay) * (l.ay - v.ay)) AS d FROM l JOIN v USING (sheet_id)), k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, handle ORDER BY d, value_handle) AS k FROM p WHERE d <= 200) SELECT sheet_id, handle, value_handle, CAST(k AS INTEGER) AS rank, round(d, 6) AS distance FROM k WHERE k <= 3")
def nearest_value(e):
    c = e.select("sheet_id", "handle", "text", *[F.col(f"a{n[-1]}").alias(n) for n in ("min_x", "min_y", "max_x", "max_y")])
    pairs = box_join(c.filter("text LIKE 'QTY%'"), c.filter("text LIKE '% EA'"), 200.0, 256.0)
    pairs = pairs.withColumn("d", B.point_distance(F.col("a_min_x"), F.col("a_min_y"), F.col("b_min_x"), F.col("b_min_y"))).filter("d <= 200")
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("sheet_id", "a_handle").orderBy("d", "b_handle"))
    return pairs.withColumn("rank", rank).filter("rank <= 3").select("sheet_id", F.col("a_handle").alias("handle"), F.col("b_handle").alias("value_handle"), "rank", F.round("d", 6).alias("distance"))


@entry("grid_cell", "n AS (SELECT 1) SELECT handle, CAST(CASE WHEN ax >= 900 THEN NULL ELSE floor(ax / 300) END AS INTEGER) AS col, CAST(1 - floor(ay / 310) AS INTEGER) AS row FROM e WHERE ax < 900 AND ay < 620")
def grid_cell(e):
    """Half-open cells of the cuts 0, 300, 600, 900 and 0, 310, 620; rows count from the top."""
    col, row = F.floor(F.col("ax") / 300).cast("int"), (F.lit(1) - F.floor(F.col("ay") / 310)).cast("int")
    return e.filter("ax < 900 AND ay < 620").select("handle", col.alias("col"), row.alias("row"))


@entry("tile_coverage", "t AS (SELECT DISTINCT sheet_id, row, col FROM (SELECT sheet_id, row, unnest(range(CAST(greatest(0, ceil((min_x - 200) / 160)) AS BIGINT), CAST(floor(max_x / 160) AS BIGINT) + 1)) AS col FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((min_y - 200) / 160)) AS BIGINT), CAST(floor(max_y / 160) AS BIGINT) + 1)) AS row FROM e))) SELECT sheet_id, count(*) AS tiles FROM t GROUP BY sheet_id")
def tile_coverage(e):
    """Distinct tiles of 200 units, from 0 on, that overlap by a fifth and meet a box."""
    low = lambda c: F.greatest(F.lit(0), F.ceil((c - 200) / 160))
    high = lambda c: F.floor(c / 160)
    span = lambda a, b: F.explode(F.when(low(F.col(a)) <= high(F.col(b)), F.sequence(low(F.col(a)), high(F.col(b)))))
    tiles = e.withColumn("col", span("min_x", "max_x")).withColumn("row", span("min_y", "max_y"))
    return tiles.select("sheet_id", "row", "col").distinct().groupBy("sheet_id").agg(F.count(F.lit(1)).alias("tiles"))
