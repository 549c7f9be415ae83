"""Queries of cluster clean-up, sheet owners, grid cells, values beside headers, loose texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.functions import primitives as P
from drawlake.operators import cells as C
from drawlake.operators import drawing as D
from drawlake.operators import prefilter as R
from drawlake.operators import views as V
from drawlake.operators.spatial import best_per, box_join
from drawlake.plans.primitives import r
from drawlake.plans.rows import GEO, SHEETS_SQL, TEXT
from drawlake.plans.shapes import reach
from drawlake.plans.views import MEMBERS_SQL
from drawlake.sources.drawings import ENTITIES_SQL, entities
from drawlake.sources.primitives import PRIMITIVES_SQL, primitives

ENTRIES: dict = {}


def entry(name: str, sql: str | None, source=primitives, head: str = PRIMITIVES_SQL):
    def register(f):
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(source(spark, sf_dir))), None if sql is None else f"WITH RECURSIVE {head}, {sql}"
        return f

    return register


def of_entities(name: str, sql: str | None):
    return entry(name, sql, entities, f"{ENTITIES_SQL}, {SHEETS_SQL}")


# --- clusters -----------------------------------------------------------------------------------

VERDICTS_SQL = f"""{MEMBERS_SQL}, ci AS (SELECT a.sheet_id, a.cluster_id, count(*) AS inside FROM ct a JOIN ct b ON a.sheet_id = b.sheet_id AND a.cluster_id <> b.cluster_id AND b.min_x >= a.min_x - 2 AND b.max_x <= a.max_x + 2 AND b.min_y >= a.min_y - 2 AND b.max_y <= a.max_y + 2 GROUP BY a.sheet_id, a.cluster_id),
 cv AS (SELECT ct.*, coalesce(inside, 0) AS inside, CASE WHEN geometry > 0 AND ((geometry <= 4 AND (polylines >= 1 OR lines >= 4) AND ((max_x - min_x >= (s_max_x - s_min_x) * 0.75 AND max_y - min_y >= (s_max_y - s_min_y) * 0.75) OR coalesce(inside, 0) >= 6)) OR (geometry <= 2 AND (max_x - min_x) * (max_y - min_y) >= 50000 AND (polylines >= 1 OR lines >= 1))) THEN 'outer_frame'
  WHEN rounds = 0 AND ((geometry <= 2 AND ((max_x - min_x <= 6 AND max_y - min_y <= 6) OR (max_x - min_x) * (max_y - min_y) <= 25)) OR (geometry = 1 AND (max_x - min_x <= 1e-9 OR max_y - min_y <= 1e-9))) THEN 'tiny_noise' ELSE 'kept' END AS verdict FROM ct JOIN s USING (sheet_id) LEFT JOIN ci USING (sheet_id, cluster_id))"""


def totals(e):
    return V.cluster_totals(V.cluster_members(e))


@of_entities("prefilter_verdicts", f"{VERDICTS_SQL} SELECT sheet_id, cluster_id, inside, verdict FROM cv")
def prefilter_verdicts(e):
    return R.verdicts(totals(e), D.sheet_bounds(e)).select("sheet_id", "cluster_id", "inside", "verdict")


_ROW = "least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y) >= 2 AND greatest(0, b.min_x - a.max_x, a.min_x - b.max_x) <= {0}"
_COL = "least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x) >= 2 AND greatest(0, b.min_y - a.max_y, a.min_y - b.max_y) <= {0}"
MERGES_SQL = f"""{VERDICTS_SQL}, kc AS (SELECT *, cluster_id AS handle FROM cv WHERE verdict = 'kept'), ke AS (SELECT a.sheet_id, a.cluster_id AS a, b.cluster_id AS b FROM kc a JOIN kc b ON a.sheet_id = b.sheet_id AND a.cluster_id < b.cluster_id
  WHERE ({_ROW.format(8)}) OR ({_COL.format(8)}) OR ((a.rounds > 0 OR b.rounds > 0 OR a.geometry + b.geometry <= 20) AND (({_ROW.format(12)}) OR ({_COL.format(12)})))), {reach('kc', 'ke', 'kr')}"""


@of_entities("cluster_merges", f"{MERGES_SQL} SELECT kr.sheet_id, component AS cluster_id, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, CAST(sum(geometry) AS BIGINT) AS geometry, count(*) AS parts FROM kr JOIN kc USING (sheet_id, handle) GROUP BY kr.sheet_id, component")
def cluster_merges(e):
    c = totals(e)
    kept = R.verdicts(c, D.sheet_bounds(e)).filter("verdict = 'kept'")
    return R.merged(kept.select(*c.columns)).select("sheet_id", "cluster_id", "min_x", "min_y", "max_x", "max_y", "geometry", "parts")


@of_entities("pre_filter", None)
def pre_filter(e):
    """Clusters after the whole clean-up; its sequential steps are tested against brute force."""
    return R.pre_filtered(totals(e), D.sheet_bounds(e))


# --- sheets -------------------------------------------------------------------------------------

FRAMES_SQL = "fr AS (SELECT sheet_id, handle AS frame_id, min_x, min_y, max_x, max_y FROM e WHERE kind = 'BlockReference')"
OWNERS_SQL = f"""{FRAMES_SQL}, op AS (SELECT e.sheet_id, e.handle, frame_id, e.ax BETWEEN fr.min_x - 1e-6 AND fr.max_x + 1e-6 AND e.ay BETWEEN fr.min_y - 1e-6 AND fr.max_y + 1e-6 AS inside, greatest(0, least(e.max_x, fr.max_x) - greatest(e.min_x, fr.min_x)) * greatest(0, least(e.max_y, fr.max_y) - greatest(e.min_y, fr.min_y)) AS area
  FROM e JOIN fr ON fr.sheet_id = e.sheet_id WHERE e.kind <> 'BlockReference'), ob AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, handle ORDER BY inside DESC, area DESC, frame_id) AS k FROM op WHERE inside OR area > 1e-6) WHERE k = 1),
 ow AS (SELECT e.sheet_id, e.handle, frame_id AS owner FROM e LEFT JOIN ob USING (sheet_id, handle) WHERE e.kind <> 'BlockReference')"""


def frames(e):
    return e.filter("kind = 'BlockReference'").select("sheet_id", F.col("handle").alias("frame_id"), "min_x", "min_y", "max_x", "max_y")


@of_entities("sheet_owners", f"{OWNERS_SQL} SELECT handle, owner FROM ow")
def sheet_owners(e):
    """Blocks as sheets; sheets themselves have no owner."""
    return C.owner_sheets(e.filter("kind != 'BlockReference'"), frames(e)).select("handle", "owner")


@of_entities("sheet_partition", f"{OWNERS_SQL} SELECT sheet_id, coalesce(CAST(owner AS VARCHAR), 'global') AS bucket, count(*) AS n FROM ow GROUP BY ALL")
def sheet_partition(e):
    owned = C.owner_sheets(e.filter("kind != 'BlockReference'"), frames(e))
    return owned.groupBy("sheet_id", F.coalesce(F.col("owner").cast("string"), F.lit("global")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@of_entities("first_sheets", f"{FRAMES_SQL} SELECT e.handle, min(frame_id) AS owner FROM e LEFT JOIN fr ON fr.sheet_id = e.sheet_id AND ax BETWEEN fr.min_x AND fr.max_x AND ay BETWEEN fr.min_y AND fr.max_y WHERE kind <> 'BlockReference' GROUP BY e.handle")
def first_sheets(e):
    return C.first_sheets(e.filter("kind != 'BlockReference'"), frames(e)).select("handle", "owner")


@of_entities("block_attachments", f"{FRAMES_SQL}, p AS (SELECT e.handle, frame_id, power(ax - (fr.min_x + fr.max_x) * 0.5, 2) + power(ay - (fr.min_y + fr.max_y) * 0.5, 2) AS d FROM e JOIN fr ON fr.sheet_id = e.sheet_id WHERE kind IN {TEXT} AND ax BETWEEN fr.min_x - 25 AND fr.max_x + 25 AND ay BETWEEN fr.min_y - 25 AND fr.max_y + 25) SELECT handle, frame_id AS block FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY d, frame_id) AS k FROM p) WHERE k = 1")
def block_attachments(e):
    return C.block_attachments(e.filter("kind = 'BlockReference'"), e.filter(K.is_text(F.col("kind"))), 25.0).select("handle", "block")


# --- cells --------------------------------------------------------------------------------------

LONG = "kind = 'Line' AND sqrt(power(ex - sx, 2) + power(ey - sy, 2)) > 200"
CELLS_SQL = f"""cuts AS (SELECT DISTINCT sheet_id, axis, cut FROM (SELECT sheet_id, 'x' AS axis, sx AS cut FROM d WHERE {LONG} UNION ALL SELECT sheet_id, 'x', ex FROM d WHERE {LONG} UNION ALL SELECT sheet_id, 'y', sy FROM d WHERE {LONG} UNION ALL SELECT sheet_id, 'y', ey FROM d WHERE {LONG})),
 nx AS (SELECT *, lead(cut) OVER w AS nxt, CAST(row_number() OVER w - 1 AS INTEGER) AS place FROM cuts WINDOW w AS (PARTITION BY sheet_id, axis ORDER BY cut)),
 cells AS (SELECT x.sheet_id, y.place AS row, x.place AS col, x.cut AS x0, y.cut AS y0, x.nxt AS x1, y.nxt AS y1 FROM nx x JOIN nx y ON x.sheet_id = y.sheet_id AND x.axis = 'x' AND y.axis = 'y' WHERE x.nxt - x.cut >= 100 AND y.nxt - y.cut >= 100)"""


def lines(d):
    return d.filter("kind = 'Line'")


@entry("grid_cuts", f"{CELLS_SQL} SELECT sheet_id, axis, cut, nxt AS next FROM nx WHERE nxt IS NOT NULL")
def grid_cuts(d):
    return C.line_cuts(lines(d))


@entry("logical_cells", f"{CELLS_SQL} SELECT sheet_id, row, col, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y FROM cells")
def logical_cells(d):
    return C.logical_cells(lines(d))


@entry("cut_cells", f"{CELLS_SQL}, nr AS (SELECT *, count(*) OVER (PARTITION BY sheet_id, axis) AS n, nxt = max(nxt) OVER (PARTITION BY sheet_id, axis) AS is_last FROM nx WHERE nxt IS NOT NULL) SELECT d.handle, x.place AS col, CAST(y.n - 1 - y.place AS INTEGER) AS row FROM d JOIN nr x ON x.sheet_id = d.sheet_id AND x.axis = 'x' AND d.x >= x.cut AND (d.x < x.nxt OR (x.is_last AND d.x = x.nxt)) JOIN nr y ON y.sheet_id = d.sheet_id AND y.axis = 'y' AND d.y >= y.cut AND (d.y < y.nxt OR (y.is_last AND d.y = y.nxt)) WHERE text IS NOT NULL")
def cut_cells(d):
    """The cell of each text between the cuts of its sheet: half-open, the last one closed, rows
    counted from the top. The few cuts of a sheet travel as two sorted arrays."""
    cuts = C.line_cuts(lines(d))
    some = lambda axis: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("axis") == axis, F.array("cut", "next"))))))
    packed = cuts.groupBy("sheet_id").agg(some("x").alias("xs"), some("y").alias("ys"))
    # How many cuts are not above a place gives its cell; the last cut belongs to the last cell.
    at = lambda v, c: F.least(F.size(F.filter(c, lambda k: k <= F.col(v))), F.size(c) - 1) - 1
    inside = lambda v, c: (F.col(v) >= F.get(F.col(c), F.lit(0))) & (F.col(v) <= F.get(F.col(c), F.size(c) - 1))
    x = d.filter("text IS NOT NULL").join(packed, "sheet_id").filter(inside("x", "xs") & inside("y", "ys"))
    return x.select("handle", at("x", F.col("xs")).alias("col"), (F.size("ys") - 2 - at("y", F.col("ys"))).alias("row"))


def text_points(d):
    return d.filter("text IS NOT NULL").select("sheet_id", "handle", F.col("x").alias("px"), F.col("y").alias("py"))


@entry("cell_contents", f"{CELLS_SQL}, pt AS (SELECT sheet_id, handle, x AS px, y AS py, true AS is_text FROM d WHERE text IS NOT NULL UNION ALL SELECT sheet_id, handle, sx, sy, false FROM d WHERE kind = 'Line') SELECT cells.sheet_id, row, col, count(*) FILTER (is_text) AS texts, count(*) FILTER (NOT is_text) AS curves FROM cells JOIN pt ON pt.sheet_id = cells.sheet_id AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY ALL")
def cell_contents(d):
    """Texts by their point and curves by their start in each cell, borders included."""
    cells = C.logical_cells(lines(d))
    starts = lines(d).select("sheet_id", "handle", F.col("sx").alias("px"), F.col("sy").alias("py"))
    found = C.points_in_cells(text_points(d), cells).withColumn("t", F.lit(1)).unionByName(C.points_in_cells(starts, cells).withColumn("t", F.lit(0)))
    return found.groupBy("sheet_id", "row", "col").agg(F.count_if(F.col("t") == 1).alias("texts"), F.count_if(F.col("t") == 0).alias("curves"))


@entry("cell_parts", f"{CELLS_SQL}" + r""", tx AS (SELECT cells.sheet_id, row, col, handle, text FROM cells JOIN d ON d.sheet_id = cells.sheet_id AND text IS NOT NULL AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
 SELECT sheet_id, row, col, max_by(text, handle) FILTER (regexp_matches(text, '^NAJV-|^DRC-')) AS header, max_by(nullif(regexp_extract(text, '(?i)(X|\*)\s?(\d+)', 2), ''), handle) FILTER (regexp_matches(text, '(?i)(X|\*)\s?\d')) AS quantity, max(CASE WHEN contains(text, 'SUS') THEN 'SUS' END) AS material,
  max_by(concat(regexp_extract(text, '(?i)PL(\d+)', 1), 'T'), handle) FILTER (regexp_matches(text, '(?i)PL\d')) AS thickness, CASE WHEN count(*) FILTER (regexp_matches(text, '(?i)(X|\*)\s?\d')) > 0 THEN 'OK' ELSE 'Warning' END AS status FROM tx GROUP BY sheet_id, row, col""")  # fmt: skip
def cell_parts(d):
    """What the texts of a cell say of its part; the last text of each sort counts."""
    found = C.points_in_cells(text_points(d), C.logical_cells(lines(d))).join(d.select("sheet_id", "handle", "text"), ["sheet_id", "handle"])
    a = P.column_attributes(F.col("text"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("handle")))
    header = F.when(F.col("text").rlike("^NAJV-|^DRC-"), F.col("text"))
    g = found.groupBy("sheet_id", "row", "col").agg(last(header).alias("header"), last(a["quantity"]).alias("quantity"), F.max(a["material"]).alias("material"), last(a["thickness"]).alias("thickness"))
    return g.withColumn("status", F.when(F.col("quantity").isNull(), "Warning").otherwise("OK"))


@entry("grid_lines", f"""{CELLS_SQL}, cc AS (SELECT sheet_id, list_distinct(list_concat(list(x0), list(x1))) AS xs, list_distinct(list_concat(list(y0), list(y1))) AS ys, avg(x1 - x0) AS mw, avg(y1 - y0) AS mh FROM cells GROUP BY sheet_id),
 q AS (SELECT d.*, abs(ex - sx) AS dx, abs(ey - sy) AS dy, xs, ys, mw, mh FROM d LEFT JOIN cc USING (sheet_id) WHERE kind = 'Line')
 SELECT handle, coalesce(CASE WHEN dy <= 1 THEN len(list_filter(ys, lambda c: abs(c - sy) <= 1)) > 0 AND len(list_filter(xs, lambda c: abs(c - sx) <= 2)) > 0 AND len(list_filter(xs, lambda c: abs(c - ex) <= 2)) > 0
  WHEN dx <= 1 THEN len(list_filter(xs, lambda c: abs(c - sx) <= 1)) > 0 AND len(list_filter(ys, lambda c: abs(c - sy) <= 2)) > 0 AND len(list_filter(ys, lambda c: abs(c - ey) <= 2)) > 0 ELSE false END OR (dy < 1e-6 AND dx > mw * 2) OR (dx < 1e-6 AND dy > mh * 2), false) AS is_grid FROM q""")  # fmt: skip
def grid_lines(d):
    return C.grid_lines(lines(d), C.logical_cells(lines(d))).select("handle", "is_grid")


@entry("cell_exports", f"""{CELLS_SQL}, q AS (SELECT d.*, row, col, x0, y0, x1, y1, max_x - min_x AS bw, max_y - min_y AS bh, greatest(0, least(max_x, x1) - greatest(min_x, x0)) * greatest(0, least(max_y, y1) - greatest(min_y, y0)) AS common FROM d JOIN cells ON cells.sheet_id = d.sheet_id AND min_x <= x1 AND x0 <= max_x AND min_y <= y1 AND y0 <= max_y WHERE min_x IS NOT NULL)
 SELECT handle, row, col, CASE WHEN kind = 'BlockReference' AND (bw > (x1 - x0) * 0.95 OR bh > (y1 - y0) * 0.95) THEN 'too_large' WHEN NOT ((min_x + max_x) * 0.5 BETWEEN x0 AND x1 AND (min_y + max_y) * 0.5 BETWEEN y0 AND y1) AND CASE WHEN bw * bh > 0 THEN common / (bw * bh) ELSE 0 END < CASE WHEN kind = 'BlockReference' THEN 0.25 ELSE 0.60 END THEN 'not_local'
  WHEN kind = 'BlockReference' THEN 'block' ELSE 'primitive' END AS verdict FROM q""")  # fmt: skip
def cell_exports(d):
    return C.cell_exports(d.filter("min_x IS NOT NULL"), C.logical_cells(lines(d))).select("handle", "row", "col", "verdict")


@entry("frame_sides", f"ext AS (SELECT sheet_id, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM d GROUP BY sheet_id), q AS (SELECT d.sheet_id, handle, sqrt(power(ex - sx, 2) + power(ey - sy, 2)) AS len, CASE WHEN abs(sx - ex) < 0.001 AND abs(sx - x0) < 1 THEN 'left' WHEN abs(sx - ex) < 0.001 AND abs(sx - x1) < 1 THEN 'right' WHEN abs(sy - ey) < 0.001 AND abs(sy - y0) < 1 THEN 'bottom' WHEN abs(sy - ey) < 0.001 AND abs(sy - y1) < 1 THEN 'top' END AS side FROM d JOIN ext USING (sheet_id) WHERE kind = 'Line') SELECT sheet_id, side, handle FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, side ORDER BY len DESC, handle) AS k FROM q WHERE side IS NOT NULL) WHERE k = 1")
def frame_sides(d):
    """The longest line on each side of a sheet's extent."""
    ext = d.groupBy("sheet_id").agg(F.min("min_x").alias("x0"), F.min("min_y").alias("y0"), F.max("max_x").alias("x1"), F.max("max_y").alias("y1"))
    q = lines(d).join(ext, "sheet_id")
    upright, level = F.abs(F.col("sx") - F.col("ex")) < 0.001, F.abs(F.col("sy") - F.col("ey")) < 0.001
    at = lambda c, e: F.abs(F.col(c) - F.col(e)) < 1
    side = F.when(upright & at("sx", "x0"), "left").when(upright & at("sx", "x1"), "right").when(level & at("sy", "y0"), "bottom").when(level & at("sy", "y1"), "top")
    long = F.sqrt(F.pow(F.col("ex") - F.col("sx"), 2) + F.pow(F.col("ey") - F.col("sy"), 2))
    return best_per(q.withColumn("side", side).withColumn("len", long).filter("side IS NOT NULL"), ["sheet_id", "side"], [F.col("len").desc(), F.col("handle")]).select("sheet_id", "side", "handle")


# --- headers ------------------------------------------------------------------------------------

HEAD = "contains(text, concat('MAT', chr(39), 'L'))"
_SEG = "sqrt(power(px + t * (qx - px) - hx, 2) + power(py + t * (qy - py) - hy, 2))"
OUTLINES_SQL = f"""hd AS (SELECT sheet_id, handle, x AS hx, y AS hy FROM d WHERE text IS NOT NULL AND {HEAD}), ol AS (SELECT sheet_id, handle, x, y, w, h FROM d WHERE kind = 'Polyline' AND closed AND min_x IS NOT NULL),
 sd AS (SELECT sheet_id, handle, x AS px, y AS py, x + w AS qx, y AS qy FROM ol UNION ALL SELECT sheet_id, handle, x + w, y, x + w, y + h FROM ol UNION ALL SELECT sheet_id, handle, x + w, y + h, x, y + h FROM ol UNION ALL SELECT sheet_id, handle, x, y + h, x, y FROM ol),
 sg AS (SELECT hd.sheet_id, hd.handle, sd.handle AS outline, hx, hy, px, py, qx, qy, CASE WHEN power(qx - px, 2) + power(qy - py, 2) > 0 THEN greatest(0, least(1, ((hx - px) * (qx - px) + (hy - py) * (qy - py)) / nullif(power(qx - px, 2) + power(qy - py, 2), 0))) ELSE 0 END AS t FROM hd JOIN sd USING (sheet_id)),
 od AS (SELECT handle, outline, min({_SEG}) AS distance FROM sg GROUP BY handle, outline)"""


@entry("header_outlines", f"{OUTLINES_SQL} SELECT handle, outline, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY round(distance, 9), outline) AS k FROM od WHERE distance < 300) WHERE k = 1")
def header_outlines(d):
    """The closed polyline nearest to each material header, by any of its sides."""
    heads = d.filter(F.contains("text", F.lit("MAT'L"))).select("sheet_id", "handle", F.col("x").alias("px"), F.col("y").alias("py"))
    outlines = d.filter("kind = 'Polyline' AND closed AND min_x IS NOT NULL").withColumn("vertices", P.vertices())
    return C.outline_distance(heads, outlines, 300.0).select("handle", "outline", r("distance"))


@entry("header_values", f"hd AS (SELECT sheet_id, handle, x, y FROM d WHERE text IS NOT NULL AND {HEAD}), vl AS (SELECT sheet_id, handle, x, y FROM d WHERE text IS NOT NULL AND NOT {HEAD}), p AS (SELECT hd.handle, vl.handle AS value, sqrt(power(hd.x - vl.x, 2) + power(hd.y - vl.y, 2)) AS dist FROM hd JOIN vl USING (sheet_id)) SELECT handle, value, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY dist, value) AS k FROM p WHERE dist < 200) WHERE k = 1")
def header_values(d):
    """The text nearest to each material header."""
    point = lambda rows: rows.select("sheet_id", "handle", F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"))
    head = F.contains("text", F.lit("MAT'L"))
    pairs = box_join(point(d.filter(head)), point(d.filter(F.col("text").isNotNull() & ~head)), 200.0, 256.0)
    pairs = pairs.withColumn("distance", B.point_distance(F.col("a_min_x"), F.col("a_min_y"), F.col("b_min_x"), F.col("b_min_y"))).filter("distance < 200")
    return best_per(pairs, ["sheet_id", "a_handle"], [F.col("distance"), F.col("b_handle")]).select(F.col("a_handle").alias("handle"), F.col("b_handle").alias("value"), r("distance"))


@entry("table_values", f"""{CELLS_SQL}, hd AS (SELECT sheet_id, handle, x AS hx, y AS hy FROM d WHERE text IS NOT NULL AND {HEAD}),
 hc AS (SELECT * FROM (SELECT hd.*, x0, y0, x1, y1, row_number() OVER (PARTITION BY handle ORDER BY (x1 - x0) * (y1 - y0), row, col) AS k FROM hd JOIN cells ON cells.sheet_id = hd.sheet_id AND hx BETWEEN x0 AND x1 AND hy BETWEEN y0 AND y1) WHERE k = 1)
 SELECT hc.handle, min(d.handle) AS value FROM hc LEFT JOIN d ON d.sheet_id = hc.sheet_id AND d.text IS NOT NULL AND NOT {HEAD.replace('text', 'd.text')} AND d.x > x1 AND d.x < x1 + (x1 - x0) * 1.2 AND d.y > y0 AND d.y < y1 GROUP BY hc.handle""")  # fmt: skip
def table_values(d):
    """For each header in a cell, the first text in the strip to the right of the tightest one."""
    heads = d.filter(F.contains("text", F.lit("MAT'L"))).select("sheet_id", "handle", F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"))
    inside = box_join(heads, C.logical_cells(lines(d)), 0.0, 256.0)
    tight = best_per(inside, ["sheet_id", "a_handle"], [B.box("b_").area, F.col("b_row"), F.col("b_col")])
    b = B.box("b_")
    strip = tight.select("sheet_id", F.col("a_handle").alias("handle"), b.max_x.alias("min_x"), b.min_y.alias("min_y"), (b.max_x + b.width * 1.2).alias("max_x"), b.max_y.alias("max_y"))
    texts = d.filter(F.col("text").isNotNull() & ~F.contains("text", F.lit("MAT'L"))).select("sheet_id", "handle", F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"))
    a, t = B.box("a_"), B.box("b_")
    hits = box_join(strip, texts, 0.0, 256.0).filter((t.min_x > a.min_x) & (t.min_x < a.max_x) & (t.min_y > a.min_y) & (t.min_y < a.max_y))
    first = hits.groupBy("sheet_id", F.col("a_handle").alias("handle")).agg(F.min("b_handle").alias("value"))
    return strip.select("sheet_id", "handle").join(first, ["sheet_id", "handle"], "left").select("handle", "value")


COLUMNS_SQL = "hd AS (SELECT sheet_id, handle, x AS x0, y AS hy, lead(x) OVER (PARTITION BY sheet_id ORDER BY x, handle) AS x1 FROM d WHERE text IS NOT NULL AND regexp_matches(text, '^NAJV-|^DRC-'))"


@entry("column_contents", f"{COLUMNS_SQL}, pt AS (SELECT sheet_id, handle, sx AS px, sy AS py, 'curve' AS sort FROM d WHERE kind = 'Line' UNION ALL SELECT sheet_id, handle, x, y, 'text' FROM d WHERE text IS NOT NULL) SELECT hd.handle AS header, count(*) FILTER (sort = 'curve' AND py < hy - 100) AS curves, count(*) FILTER (sort = 'text' AND py < hy) AS texts FROM hd JOIN pt ON pt.sheet_id = hd.sheet_id AND px >= x0 AND px <= coalesce(x1, 1e9) GROUP BY hd.handle")
def column_contents(d):
    """Curves 100 below and texts below each header, up to the next header to the right."""
    nxt = F.lead("x").over(W.partitionBy("sheet_id").orderBy("x", "handle"))
    heads = d.filter(F.col("text").rlike("^NAJV-|^DRC-")).select("sheet_id", F.col("handle").alias("header"), F.col("x").alias("x0"), F.col("y").alias("hy"), F.coalesce(nxt, F.lit(1e9)).alias("x1"))
    curves = lines(d).select("sheet_id", F.col("sx").alias("px"), F.col("sy").alias("py"), F.lit("curve").alias("sort"))
    points = curves.unionByName(d.filter("text IS NOT NULL").select("sheet_id", F.col("x").alias("px"), F.col("y").alias("py"), F.lit("text").alias("sort")))
    # A few headers a sheet, in one array; each point finds its columns there.
    packed = heads.groupBy("sheet_id").agg(F.collect_list(F.struct("header", "x0", "x1", "hy")).alias("hs"))
    hit = points.join(packed, "sheet_id").select("px", "py", "sort", F.explode(F.filter("hs", lambda q: (F.col("px") >= q["x0"]) & (F.col("px") <= q["x1"]))).alias("q"))
    c = F.col
    return hit.groupBy("q.header").agg(
        F.count_if((c("sort") == "curve") & (c("py") < c("q.hy") - 100)).alias("curves"), F.count_if((c("sort") == "text") & (c("py") < c("q.hy"))).alias("texts")
    )


# --- loose texts --------------------------------------------------------------------------------

LOOSE = "min_x IS NOT NULL AND block_path IS NULL"
_AX = "(min_x + max_x) * 0.5 AS ax, (min_y + max_y) * 0.5 AS ay"
BADGES_SQL = rf"""bs AS (SELECT *, {_AX} FROM d WHERE {LOOSE} AND kind IN {GEO} AND max_x - min_x <= 60 AND max_y - min_y <= 35 AND (max_x - min_x) * (max_y - min_y) <= 2000), bt AS (SELECT *, {_AX} FROM d WHERE {LOOSE} AND text IS NOT NULL AND regexp_matches(trim(text), '^[\p{{L}}\p{{Nd}}]{{1,4}}$')),
 bp AS (SELECT s.sheet_id, s.handle AS badge, t.handle AS text, sqrt(power(t.ax - s.ax, 2) + power(t.ay - s.ay, 2)) AS away, sqrt(power(greatest(0, t.min_x - s.max_x, s.min_x - t.max_x), 2) + power(greatest(0, t.min_y - s.max_y, s.min_y - t.max_y), 2)) AS gap,
  t.ax BETWEEN s.min_x - 10 AND s.max_x + 10 AND t.ay BETWEEN s.min_y - 10 AND s.max_y + 10 AS inside, greatest(18, greatest(s.max_x - s.min_x, s.max_y - s.min_y) * 1.5) AS reach FROM bs s JOIN bt t ON t.sheet_id = s.sheet_id)"""


def loose(d):
    b = B.box()
    return d.filter(LOOSE).withColumn("ax", b.center_x).withColumn("ay", b.center_y)


def loose_badges(d):
    x = loose(d)
    return C.badge_candidates(x.filter(C.is_badge_shape(F.col("kind"))), x.filter(C.is_badge_text(F.col("text"))))


@entry("badge_candidates", f"{BADGES_SQL} SELECT badge, text, round(away + gap * 0.5, 6) AS score FROM bp WHERE inside OR gap <= 12 OR away <= reach")
def badge_candidates(d):
    return loose_badges(d).select("badge", "text", r("score"))


@entry("badge_pairs", None)
def badge_pairs(d):
    """Taking turns has no SQL; tested against plain loops."""
    return C.badge_pairs(loose_badges(d))


NOTES_SQL = rf"""un AS (SELECT sheet_id, handle AS unit_id, min_x, min_y, max_x, max_y, (min_x + max_x) * 0.5 AS ux, (min_y + max_y) * 0.5 AS uy FROM d WHERE {LOOSE} AND kind IN ('Dimension', 'Leader')), lt AS (SELECT sheet_id, handle, {_AX} FROM d WHERE {LOOSE} AND text IS NOT NULL AND NOT regexp_matches(trim(text), '^[\p{{L}}\p{{Nd}}]{{1,4}}$')),
 np AS (SELECT lt.handle, unit_id, round(sqrt(power(greatest(0, min_x - ax, ax - max_x), 2) + power(greatest(0, min_y - ay, ay - max_y), 2)) + sqrt(power(ax - ux, 2) + power(ay - uy, 2)) * 0.2, 9) AS score FROM lt JOIN un USING (sheet_id))"""


def annotation_units(d):
    return loose(d).filter("kind IN ('Dimension', 'Leader')").select("sheet_id", F.col("handle").alias("unit_id"), "min_x", "min_y", "max_x", "max_y", F.col("ax").alias("ux"), F.col("ay").alias("uy"))


@entry("annotation_texts", f"{NOTES_SQL} SELECT handle, unit_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY score, unit_id) AS k FROM np WHERE score <= 20) WHERE k = 1")
def annotation_texts(d):
    texts = loose(d).filter(F.col("text").isNotNull() & ~C.is_badge_text(F.col("text")))
    return C.annotation_texts(texts, annotation_units(d)).select("handle", "unit_id", r("score"))


@entry("loose_remainder", None)
def loose_remainder(d):
    """Where every loose text ends: annotation, badge, quantity note or free note."""
    texts = loose(d).filter("text IS NOT NULL")
    noted = C.annotation_texts(texts.filter(~C.is_badge_text(F.col("text"))), annotation_units(d))
    return C.loose_fate(texts, noted, C.badge_pairs(loose_badges(d)))
