"""Curves, packs, density and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.operators import curves as C
from drawlake.operators import drawing as D
from drawlake.operators.spatial import best_per, connected, prefixed
from drawlake.plans.rows import SHEETS_SQL
from drawlake.plans.shapes import VIEWS_SQL, VPAIRS_SQL, block_views
from drawlake.sources.drawings import ENTITIES_SQL, entities

ENTRIES: dict = {}


def entry(name: str, sql: str | None):
    def register(f):
        text = None if sql is None else f"WITH RECURSIVE {ENTITIES_SQL}, {SHEETS_SQL} {sql}"
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(entities(spark, sf_dir))), text
        return f

    return register


SEGMENTS_SQL = """, sg AS (SELECT sheet_id, handle, kind, 0 AS seq, min_x AS x0, min_y AS y0, max_x AS x1, max_y AS y1 FROM e WHERE kind = 'Line'
 UNION ALL SELECT sheet_id, handle, kind, 0, min_x, min_y, max_x, min_y FROM e WHERE kind = 'Polyline' UNION ALL SELECT sheet_id, handle, kind, 1, max_x, min_y, max_x, max_y FROM e WHERE kind = 'Polyline'
 UNION ALL SELECT sheet_id, handle, kind, 2, max_x, max_y, min_x, max_y FROM e WHERE kind = 'Polyline' UNION ALL SELECT sheet_id, handle, kind, 3, min_x, max_y, min_x, min_y FROM e WHERE kind = 'Polyline'
 UNION ALL SELECT sheet_id, handle, kind, i, ax + (max_x - min_x) * 0.5 * cos(i * pi() / 8), ay + (max_y - min_y) * 0.5 * sin(i * pi() / 8), ax + (max_x - min_x) * 0.5 * cos((i + 1) * pi() / 8), ay + (max_y - min_y) * 0.5 * sin((i + 1) * pi() / 8)
  FROM e, (SELECT CAST(unnest(range(16)) AS INTEGER) AS i) WHERE kind IN ('Circle', 'Arc'))"""


@entry("segments", f"{SEGMENTS_SQL} SELECT handle, seq, round(x0, 5) AS x0, round(y0, 5) AS y0, round(x1, 5) AS x1, round(y1, 5) AS y1 FROM sg WHERE kind IN ('Line', 'Polyline')")
def segments(e):
    r = lambda c: F.round(c, 5).alias(c)
    return C.segments(e).filter("kind IN ('Line', 'Polyline')").select("handle", "seq", r("x0"), r("y0"), r("x1"), r("y1"))


@entry("segment_lengths", f"{SEGMENTS_SQL} SELECT sheet_id, handle, count(*) AS n, round(sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))), 4) AS length FROM sg GROUP BY sheet_id, handle")
def segment_lengths(e):
    length = B.point_distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return C.segments(e).groupBy("sheet_id", "handle").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(length), 4).alias("length"))


@entry("sample_points", f"{SEGMENTS_SQL}, n AS (SELECT *, greatest(1, CAST(ceil(round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 5.0, 9)) AS INTEGER)) AS n FROM sg WHERE kind = 'Line') SELECT handle, CAST(k AS INTEGER) AS k, round(x0 + (x1 - x0) * (k / n), 6) AS x, round(y0 + (y1 - y0) * (k / n), 6) AS y FROM (SELECT *, unnest(range(n + 1)) AS k FROM n)")
def sample_points(e):
    return C.sample_points(C.segments(e.filter("kind = 'Line'")), 5.0).select("handle", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@entry("end_links", f"{SEGMENTS_SQL}, p AS (SELECT sheet_id, handle, seq, x0 AS x, y0 AS y FROM sg WHERE kind IN ('Line', 'Polyline') UNION ALL SELECT sheet_id, handle, seq, x1, y1 FROM sg WHERE kind IN ('Line', 'Polyline')), l AS (SELECT a.sheet_id, a.handle AS a_handle, a.seq AS a_seq, b.handle AS b_handle, b.seq AS b_seq, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM p a JOIN p b ON a.sheet_id = b.sheet_id AND a.handle <> b.handle AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, a_handle, a_seq ORDER BY d, b_handle, b_seq) AS k FROM l WHERE d <= 6) SELECT a_handle, a_seq, b_handle, b_seq, round(d, 6) AS distance FROM k WHERE k <= 8")
def end_links(e):
    links = C.end_links(C.segments(e.filter("kind IN ('Line', 'Polyline')")), 6.0)
    return links.select("a_handle", "a_seq", "b_handle", "b_seq", F.round("distance", 6).alias("distance"))


@entry("closed_loops", ", p AS (SELECT sheet_id, (max_x - min_x) * (max_y - min_y) AS area FROM e WHERE kind = 'Polyline' AND max_x > min_x + 1 AND max_y > min_y + 1) SELECT sheet_id, count(*) AS loops, round(sum(area), 6) AS area FROM p GROUP BY sheet_id")
def closed_loops(e):
    """Outlines of polylines, which lie apart, each close a loop."""
    outline = C.segments(e.filter("kind = 'Polyline' AND max_x > min_x + 1 AND max_y > min_y + 1"))
    return C.closed_loops(outline, 1e-6).groupBy("sheet_id").agg(F.count(F.lit(1)).alias("loops"), F.round(F.sum("area"), 6).alias("area"))


@entry("greedy_distinct", None)
def greedy_distinct(e):
    rows = e.filter("kind = 'BlockReference'").withColumn("score", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    return C.greedy_distinct(rows, 0.10)


PACKS_SQL = f""", {VIEWS_SQL}, t AS (SELECT * FROM (SELECT *, (max_x - min_x) * (max_y - min_y) AS area, row_number() OVER (PARTITION BY sheet_id ORDER BY (max_x - min_x) * (max_y - min_y) DESC, view_id) AS k FROM v) WHERE k <= 8),
 o AS (SELECT a.sheet_id, a.view_id AS a, b.view_id AS b, CASE WHEN least(a.area, b.area) > 0 THEN greatest(0, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * greatest(0, least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)) / least(a.area, b.area) ELSE 0 END AS ov FROM t a JOIN t b ON a.sheet_id = b.sheet_id AND a.view_id < b.view_id)"""


def pack_pairs(e):
    v = block_views(e).withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    top = best_per(v, ["sheet_id"], [F.col("area").desc(), F.col("view_id")], 8)
    pairs = prefixed(top, "a_").join(prefixed(top, "b_"), "sheet_id").filter("a_view_id < b_view_id")
    return pairs.filter(B.overlap_of_smaller(B.box("a_"), B.box("b_")) <= 0.35).select("sheet_id", F.col("a_view_id").alias("a"), F.col("b_view_id").alias("b"))


@entry("view_packs", f"{PACKS_SQL}, g AS (SELECT * FROM o WHERE ov <= 0.35) SELECT sheet_id, a, b, NULL::BIGINT AS c FROM g UNION ALL SELECT x.sheet_id, x.a, x.b, y.b AS c FROM g x JOIN g y ON x.sheet_id = y.sheet_id AND x.b = y.a JOIN g z ON z.sheet_id = x.sheet_id AND z.a = x.a AND z.b = y.b")
def view_packs(e):
    """Sets of two and three of a sheet's eight largest views that overlap little."""
    g = pack_pairs(e)
    y = g.select("sheet_id", F.col("a").alias("b"), F.col("b").alias("c"))
    z = g.select("sheet_id", "a", F.col("b").alias("c"))
    return g.withColumn("c", F.lit(None).cast("bigint")).unionByName(g.join(y, ["sheet_id", "b"]).join(z, ["sheet_id", "a", "c"], "left_semi").select("sheet_id", "a", "b", "c"))


@entry("projection_chains", f", {VIEWS_SQL}, {VPAIRS_SQL}, d AS (SELECT source_id, target_id, CASE WHEN gx <= 1e-9 AND gy <= 1e-9 THEN 'Overlapping' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'RightOf' ELSE 'LeftOf' END WHEN dy >= 0 THEN 'Above' ELSE 'Below' END AS direction FROM vs WHERE score >= 0.4) SELECT source_id, direction, string_agg(CAST(target_id AS VARCHAR), '>' ORDER BY target_id) AS chain FROM d GROUP BY ALL")
def projection_chains(e):
    strong = D.view_pairs(block_views(e)).filter("score >= 0.4")
    return strong.groupBy("source_id", "direction").agg(F.array_join(F.array_sort(F.collect_list("target_id")).cast("array<string>"), ">").alias("chain"))


@entry("anchor_position", f""", {VIEWS_SQL}, {VPAIRS_SQL}, an AS (SELECT sheet_id, min(view_id) AS anchor FROM v GROUP BY sheet_id), d AS (SELECT vs.sheet_id, source_id, target_id, score, CASE WHEN gx <= 1e-9 AND gy <= 1e-9 THEN 'Overlapping' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'RightOf' ELSE 'LeftOf' END WHEN dy >= 0 THEN 'Above' ELSE 'Below' END AS direction FROM vs)
SELECT v.view_id, coalesce(f.direction, CASE r.direction WHEN 'RightOf' THEN 'LeftOf' WHEN 'LeftOf' THEN 'RightOf' WHEN 'Above' THEN 'Below' WHEN 'Below' THEN 'Above' ELSE r.direction END) AS position FROM v JOIN an ON an.sheet_id = v.sheet_id AND v.view_id <> anchor LEFT JOIN d f ON f.source_id = anchor AND f.target_id = v.view_id AND f.score >= 0.4 LEFT JOIN d r ON r.source_id = v.view_id AND r.target_id = anchor""")  # fmt: skip
def anchor_position(e):
    """Position of each view relative to the sheet's first: by a strong edge from the anchor,
    else by the reversed edge."""
    v = block_views(e)
    pairs = D.view_pairs(v)
    anchors = v.groupBy("sheet_id").agg(F.min("view_id").alias("anchor"))
    base = v.join(anchors, "sheet_id").filter("view_id != anchor").select("sheet_id", "view_id", "anchor")
    forth = pairs.filter("score >= 0.4").select("sheet_id", F.col("source_id").alias("anchor"), F.col("target_id").alias("view_id"), F.col("direction").alias("forth"))
    back = pairs.select("sheet_id", F.col("source_id").alias("view_id"), F.col("target_id").alias("anchor"), F.col("direction").alias("back"))
    keys = ["sheet_id", "view_id", "anchor"]
    turned = F.when(F.col("back") == "RightOf", "LeftOf").when(F.col("back") == "LeftOf", "RightOf").when(F.col("back") == "Above", "Below").when(F.col("back") == "Below", "Above").otherwise(F.col("back"))
    return base.join(forth, keys, "left").join(back, keys, "left").select("view_id", F.coalesce("forth", turned).alias("position"))


@entry("divided_pairs", ", c AS (SELECT sheet_id, handle, ax, ay FROM e WHERE kind = 'Circle') SELECT a.handle AS a_handle, b.handle AS b_handle FROM c a JOIN c b ON a.sheet_id = b.sheet_id AND a.handle < b.handle WHERE EXISTS (SELECT 1 FROM e l WHERE l.sheet_id = a.sheet_id AND l.kind = 'Line' AND l.max_x - l.min_x <= 2 AND l.ax > least(a.ax, b.ax) AND l.ax < greatest(a.ax, b.ax) AND l.min_y <= greatest(a.ay, b.ay) AND l.max_y >= least(a.ay, b.ay))")
def divided_pairs(e):
    """Pairs of circles with an upright line between them."""
    c = e.filter("kind = 'Circle'").select("sheet_id", "handle", "ax", "ay")
    pairs = prefixed(c, "a_").join(prefixed(c, "b_"), "sheet_id").filter("a_handle < b_handle")
    lines = e.filter("kind = 'Line' AND max_x - min_x <= 2").select(F.col("sheet_id").alias("l_sheet"), F.col("ax").alias("lx"), F.col("min_y").alias("l0"), F.col("max_y").alias("l1"))
    between = (F.col("lx") > F.least("a_ax", "b_ax")) & (F.col("lx") < F.greatest("a_ax", "b_ax")) & (F.col("l0") <= F.greatest("a_ay", "b_ay")) & (F.col("l1") >= F.least("a_ay", "b_ay"))
    return pairs.join(lines, (F.col("sheet_id") == F.col("l_sheet")) & between, "left_semi").select("a_handle", "b_handle")


@entry("dense_cores", ", c AS (SELECT sheet_id, handle, ax, ay FROM e), g AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM c a JOIN c b ON a.sheet_id = b.sheet_id WHERE (a.ax - b.ax) * (a.ax - b.ax) + (a.ay - b.ay) * (a.ay - b.ay) <= 3600), core AS (SELECT sheet_id, a AS handle FROM g GROUP BY ALL HAVING count(*) >= 5), ce AS (SELECT g.* FROM g JOIN core x ON g.a = x.handle JOIN core y ON g.b = y.handle WHERE g.a < g.b), r(sheet_id, handle, root) AS (SELECT sheet_id, handle, handle FROM core UNION SELECT r.sheet_id, CASE WHEN ce.a = r.handle THEN ce.b ELSE ce.a END, r.root FROM r JOIN ce ON ce.sheet_id = r.sheet_id AND (ce.a = r.handle OR ce.b = r.handle)), cl AS (SELECT sheet_id, handle, min(root) AS cluster FROM r GROUP BY ALL) SELECT handle, cluster FROM cl UNION ALL SELECT g.a AS handle, min(cl.cluster) AS cluster FROM g JOIN cl ON cl.handle = g.b WHERE g.a NOT IN (SELECT handle FROM core) GROUP BY g.a")
def dense_cores(e):
    """Density clusters of anchors: radius 60, five points; border points go to the smallest
    cluster among their cores, noise is left out."""
    from drawlake.operators.spatial import box_join

    p = e.select("sheet_id", "handle", F.col("ax").alias("min_x"), F.col("ay").alias("min_y"), F.col("ax").alias("max_x"), F.col("ay").alias("max_y"))
    dx, dy = F.col("a_min_x") - F.col("b_min_x"), F.col("a_min_y") - F.col("b_min_y")
    near = box_join(p, p, 60.0, 128.0).filter(dx * dx + dy * dy <= 3600).select("sheet_id", F.col("a_handle").alias("a"), F.col("b_handle").alias("b"))
    core = near.groupBy("sheet_id", F.col("a").alias("handle")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").select("sheet_id", "handle")
    both = near.join(core.withColumnRenamed("handle", "a"), ["sheet_id", "a"], "left_semi").join(core.withColumnRenamed("handle", "b"), ["sheet_id", "b"], "left_semi").filter("a < b")
    clusters = connected(core, both).select("sheet_id", "handle", F.col("component").alias("cluster"))
    border = near.join(core.withColumnRenamed("handle", "a"), ["sheet_id", "a"], "left_anti").join(clusters.withColumnRenamed("handle", "b"), ["sheet_id", "b"])
    return clusters.select("handle", "cluster").unionByName(border.groupBy("sheet_id", F.col("a").alias("handle")).agg(F.min("cluster").alias("cluster")).select("handle", "cluster"))


@entry("kmeans_boxes", None)
def kmeans_boxes(e):
    """Centres and sizes of each sheet, scaled to its range, in as many clusters as it has texts.
    Iteration has no SQL; tested against its definition."""
    return C.sheet_clusters(e)


@entry("robust_bounds", ", k AS (SELECT e.*, s.* EXCLUDE (sheet_id), max_x - min_x <= 1e-9 AND max_y - min_y <= 1e-9 AND depth > 0 AS point FROM e JOIN s USING (sheet_id)) SELECT sheet_id, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM k WHERE NOT point GROUP BY sheet_id")
def robust_bounds(e):
    """Bounds without nested point-like entities."""
    b = B.box()
    ghost = (b.width <= 1e-9) & (b.height <= 1e-9) & (F.col("depth") > 0)
    return D.sheet_bounds(e.filter(~ghost)).drop("n")


UNITS_SQL = """, m AS (SELECT *, 'Branch' AS unit_kind, block_path AS unit_key FROM e WHERE block_path IS NOT NULL UNION ALL SELECT *, 'BlockFamily', block_name FROM e WHERE block_path IS NOT NULL
 UNION ALL SELECT *, 'Loose', CASE WHEN kind IN ('Text', 'MText') THEN 'loose-text' WHEN kind IN ('Dimension', 'Leader') THEN 'loose-dimension' WHEN kind = 'BlockReference' THEN 'loose-block' ELSE 'loose-geometry' END FROM e WHERE block_path IS NULL),
 g AS (SELECT sheet_id, unit_kind, unit_key, count(*) AS total, count(*) FILTER (kind IN ('Text', 'MText')) AS texts, count(*) FILTER (kind IN ('Dimension', 'Leader')) AS dims,
  count(*) FILTER (kind IN ('Circle', 'Arc', 'Polyline', 'Line', 'Hatch')) AS geometry, count(*) FILTER (kind = 'Line') AS lines, max(max_x) - min(min_x) AS w, max(max_y) - min(min_y) AS h,
  count(*) FILTER (kind IN ('Text', 'MText') AND regexp_matches(upper(text), 'SCALE|UNIT|DATE|DRAWN|CHECK|APPROVED|GENERAL|TOL|TITLE|DWG|NO|REV')) AS meta_hits, string_agg(CAST(handle AS VARCHAR), '|' ORDER BY handle) AS members FROM m GROUP BY ALL),
 ur AS (SELECT *, CASE WHEN geometry >= 4 AND lines >= 4 AND texts <= 2 AND dims = 0 AND w > 50 AND h > 50 THEN 'Frame' WHEN dims > 0 AND dims >= total * 0.6 THEN 'Annotation' WHEN texts > 0 AND texts >= total * 0.6 AND meta_hits >= 1 THEN 'Metadata'
  WHEN geometry >= total * 0.55 AND texts <= total * 0.45 AND dims <= total * 0.2 THEN 'Geometry' ELSE 'Mixed' END AS role FROM g)"""


@entry("unit_roles", f"{UNITS_SQL} SELECT sheet_id, unit_kind, unit_key, total, role FROM ur")
def unit_roles(e):
    """No unit of these tables has the fields of a table row, so the SQL leaves that role out."""
    from drawlake.operators import units as U

    return U.unit_roles(e).select("sheet_id", "unit_kind", "unit_key", "total", "role")


@entry("unit_separation", f"{UNITS_SQL} SELECT sheet_id, CASE role WHEN 'TitleBlock' THEN 'Metadata' ELSE role END AS bucket, count(*) AS n FROM ur GROUP BY ALL")
def unit_separation(e):
    from drawlake.operators import units as U

    bucket = F.when(F.col("role") == "TitleBlock", "Metadata").otherwise(F.col("role"))
    return U.unit_roles(e).groupBy("sheet_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@entry("representative_units", f"{UNITS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, members ORDER BY geometry DESC, geometry / total DESC, total DESC, texts, CASE unit_kind WHEN 'Branch' THEN 0 WHEN 'BlockFamily' THEN 1 ELSE 2 END, unit_key) AS k FROM ur WHERE role = 'Geometry') SELECT sheet_id, unit_kind, unit_key, total FROM k WHERE k = 1")
def representative_units(e):
    from drawlake.operators import units as U

    return U.representative_units(U.unit_roles(e)).select("sheet_id", "unit_kind", "unit_key", "total")


@entry("block_decisions", ", c AS (SELECT sheet_id, block_path, count(*) AS n, count(*) FILTER (kind = 'BlockReference') AS b, count(*) FILTER (kind IN ('Circle', 'Arc', 'Polyline', 'Line', 'Hatch')) AS g, count(*) FILTER (kind IN ('Text', 'MText', 'Dimension', 'Leader')) AS t FROM e WHERE block_path IS NOT NULL GROUP BY ALL) SELECT sheet_id, block_path, NOT ((n = 1 AND b = 1) OR (n <= 2 AND g = 0 AND t <= 1)) AS preserve FROM c")
def block_decisions(e):
    from drawlake.operators import units as U

    return U.block_decisions(e).select("sheet_id", "block_path", "preserve")


def pack_units(e):
    return e.filter("kind IN ('Circle', 'Polyline')").select("sheet_id", "handle", "min_x", "min_y", "max_x", "max_y", F.lit(1).cast("bigint").alias("geometry"), F.when(F.col("layer") == "TITLE", 1).otherwise(0).cast("bigint").alias("meta_hits"))


@entry("connect_gaps", ", u AS (SELECT * FROM e WHERE kind IN ('Circle', 'Polyline')), p AS (SELECT a.sheet_id, a.handle, sqrt(power(greatest(0, b.min_x - a.max_x, a.min_x - b.max_x), 2) + power(greatest(0, b.min_y - a.max_y, a.min_y - b.max_y), 2)) AS gap FROM u a JOIN u b ON a.sheet_id = b.sheet_id AND a.handle <> b.handle), n AS (SELECT sheet_id, handle, min(gap) AS gap FROM p WHERE gap > 1 AND gap <= 120 GROUP BY ALL), q AS (SELECT sheet_id, quantile_cont(gap, 0.65) * 1.45 AS near FROM n GROUP BY sheet_id), sp AS (SELECT sheet_id, quantile_cont(greatest(max_x - min_x, max_y - min_y), 0.5) FILTER (greatest(max_x - min_x, max_y - min_y) > 0) * 0.12 AS span FROM u GROUP BY sheet_id) SELECT sp.sheet_id, round(least(80, greatest(8, coalesce(near, span, 8))), 6) AS connect_gap FROM sp LEFT JOIN q USING (sheet_id)")
def connect_gaps(e):
    from drawlake.operators import units as U

    return U.connect_gaps(pack_units(e)).select("sheet_id", F.round("connect_gap", 6).alias("connect_gap"))


@entry("unit_packs", None)
def unit_packs(e):
    from drawlake.operators import units as U

    return U.unit_packs(pack_units(e)).select("sheet_id", "pack_id", "units", "geometry", "meta_hits", F.round("score", 6).alias("score"))


@entry("analysis_fields", None)
def analysis_fields(e):
    """Fields of the whole analysis; its parts have SQL of their own."""
    from drawlake.plans.analyze import Analysis

    return Analysis().run(e)["fields"]


@entry("part_documents", ", p AS (SELECT sheet_id, count(*) AS n FROM e WHERE kind = 'Circle' GROUP BY sheet_id) SELECT sheet_id, n AS part_count FROM p")
def part_documents(e):
    from drawlake.sources.sinks import part_list

    parts = e.filter("kind = 'Circle'").select("sheet_id", "handle", "min_x", "min_y")
    return part_list(parts, "demo").select("sheet_id", F.get_json_object("document", "$.part_count").cast("bigint").alias("part_count"))


@entry("island_semantics", """, v AS (SELECT * FROM e WHERE kind = 'BlockReference'), g AS (SELECT v.handle AS view_id, any_value(v.min_x) AS x0, any_value(v.min_y) AS y0, any_value(v.max_x) AS x1, any_value(v.max_y) AS y1, any_value(v.sheet_id) AS sheet_id,
 count(*) FILTER (d.kind IN ('Dimension', 'Leader')) AS od, count(*) FILTER (d.kind IN ('Text', 'MText')) AS t, count(*) FILTER (d.kind IN ('Text', 'MText') AND regexp_matches(coalesce(d.text, ''), '[0-9]')) AS nt, count(*) FILTER (d.kind IN ('Text', 'MText') AND length(coalesce(d.text, '')) <= 8) AS st,
 count(*) FILTER (d.kind IN ('Line', 'Polyline', 'Hatch')) AS ge, count(*) FILTER (d.kind IN ('Arc', 'Circle')) AS cu, bool_or(d.kind = 'Circle') AS cc
 FROM v JOIN e d ON d.sheet_id = v.sheet_id AND d.min_x <= v.max_x AND v.min_x <= d.max_x AND d.min_y <= v.max_y AND v.min_y <= d.max_y GROUP BY v.handle),
 f AS (SELECT *, floor((x1 - x0) * (y1 - y0) / 16) AS cells, (x1 - x0) * (y1 - y0) <= greatest((s_max_x - s_min_x) * (s_max_y - s_min_y) * 0.015, 1) OR floor((x1 - x0) * (y1 - y0) / 16) <= 48 AS small, y1 >= s_min_y + (s_max_y - s_min_y) * 0.78 AND x0 <= s_min_x + (s_max_x - s_min_x) * 0.22 AS corner, t > 0 AND nt >= 1 AND st >= t AS num FROM g JOIN s USING (sheet_id)),
 sc AS (SELECT view_id, round((CASE WHEN od > 0 THEN 3.0 ELSE 0 END + CASE WHEN od >= 2 THEN 1.5 ELSE 0 END + CASE WHEN cells >= 50 THEN 1.0 ELSE 0 END + CASE WHEN ge + cu >= 6 OR od >= 2 THEN 1.5 ELSE 0 END + CASE WHEN cu >= 3 THEN 0.5 ELSE 0 END - CASE WHEN small THEN 1.2 ELSE 0 END - CASE WHEN num AND cc THEN 1.5 ELSE 0 END)::DOUBLE, 6) AS g,
  round((CASE WHEN small THEN 1.5 ELSE 0 END + CASE WHEN corner THEN 1.0 ELSE 0 END + CASE WHEN od = 0 THEN 1.0 ELSE 0 END + CASE WHEN num THEN 2.0 ELSE 0 END + CASE WHEN cc THEN 2.0 ELSE 0 END + CASE WHEN t BETWEEN 1 AND 3 THEN 0.7 ELSE 0 END + CASE WHEN ge + cu <= 6 THEN 0.7 ELSE 0 END - CASE WHEN od >= 2 THEN 1.5 ELSE 0 END)::DOUBLE, 6) AS b,
  round((CASE WHEN t >= greatest(1, ge) THEN 1.5 ELSE 0 END + CASE WHEN od = 0 THEN 0.5 ELSE 0 END + CASE WHEN t >= 2 THEN 1.0 ELSE 0 END - CASE WHEN num AND cc THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS a FROM f)
SELECT view_id, g AS score_geometry, b AS score_badge, a AS score_annotation, CASE WHEN b >= g AND b >= a AND b >= 3 THEN 'BadgeMarker' WHEN g >= b AND g >= a AND g >= 2.5 THEN 'GeometryView' WHEN a >= 2 THEN 'AnnotationLike' ELSE 'Unknown' END AS role FROM sc""")  # fmt: skip
def island_semantics(e):
    """Block boxes as islands of 4 by 4 cells, with what they touch."""
    from drawlake.functions import kinds as K
    from drawlake.operators import units as U
    from drawlake.operators.spatial import box_join

    k = ("sheet_id", "handle", "kind", "text", "min_x", "min_y", "max_x", "max_y")
    d, t = F.col("b_kind"), F.coalesce("b_text", F.lit(""))
    pairs = box_join(e.filter("kind = 'BlockReference'").select(*k), e.select(*k))
    text = K.is_text(d)
    g = pairs.groupBy("sheet_id", F.col("a_handle").alias("view_id")).agg(
        *[F.first(f"a_{c}").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")],
        F.count_if(K.is_dimension(d)).alias("overlap_dims"), F.count_if(text).alias("texts"), F.count_if(text & t.rlike("[0-9]")).alias("numeric_texts"), F.count_if(text & (F.length(t) <= 8)).alias("short_texts"),
        F.count_if(d.isin("Line", "Polyline", "Hatch")).alias("geometry"), F.count_if(d.isin("Arc", "Circle")).alias("curves"), F.bool_or(d == "Circle").alias("closed_curve"),
    )
    cells = F.floor((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) / 16)
    islands = D.with_sheet(g.withColumn("cells", cells).withColumn("bridge", F.lit(False)), D.sheet_bounds(e))
    return U.island_semantics(islands).select("view_id", "score_geometry", "score_badge", "score_annotation", "role")


def block_zones(e):
    """Blocks grown by 40 as zones, with the entities whose anchor they hold."""
    from drawlake.operators.spatial import box_join

    z = e.filter("kind = 'BlockReference'").select("sheet_id", F.col("handle").alias("zone_id"), (F.col("max_x") - F.col("min_x") + F.col("max_y") - F.col("min_y")).alias("score"), *[(F.col(c) + (-40.0 if c.startswith("min") else 40.0)).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    p = e.select("sheet_id", "handle", *[F.col(f"a{c[-1]}").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    return z, box_join(z, p, 0.0, 128.0).select("sheet_id", F.col("a_zone_id").alias("zone_id"), F.col("b_handle").alias("handle"))


@entry("distinct_zones", None)
def distinct_zones(e):
    """What is kept follows the order; tests compare it with plain loops."""
    from drawlake.operators.zones import distinct_zones as distinct

    return distinct(*block_zones(e)).select("sheet_id", "zone_id", "score")
