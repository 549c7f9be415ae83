"""Queries of proximity, grids, strokes, loops, sub-clusters, and of sheets with a frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.operators import drawing as D
from drawlake.operators import grids as G
from drawlake.operators import views as V
from drawlake.plans.primitives import r
from drawlake.plans.rows import DIM, GEO, SHEETS_SQL, TEXT
from drawlake.plans.shapes import VIEWS_SQL, VPAIRS_SQL, ZONES_SQL, block_views, reach
from drawlake.plans.views import CONTENT_SQL
from drawlake.sources.drawings import ENTITIES_SQL, entities, with_derived
from drawlake.sources.primitives import PRIMITIVES_SQL, primitives

ENTRIES: dict = {}


def entry(name: str, sql: str | None, source=entities, head: str = f"{ENTITIES_SQL}, {SHEETS_SQL}"):
    def register(f):
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(source(spark, sf_dir))), None if sql is None else f"WITH RECURSIVE {head}, {sql}"
        return f

    return register


def of_primitives(name: str, sql: str | None):
    return entry(name, sql, primitives, PRIMITIVES_SQL)


# --- proximity ----------------------------------------------------------------------------------

_NEAR = "power(greatest(0, b.min_x - a.max_x, a.min_x - b.max_x), 2) + power(greatest(0, b.min_y - a.max_y, a.min_y - b.max_y), 2)"
_OUT = "('Line', 'Polyline', 'Arc', 'Circle', 'Ellipse', 'Spline')"


def _proximity(rows: str, eps: float, name: str, same: str = "true") -> str:
    cell = lambda t, c: f"floor(({t}.min_{c} + {t}.max_{c}) * 0.5 / {eps})"
    edges = (
        f"{name}_e AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM {rows} a JOIN {rows} b ON a.sheet_id = b.sheet_id AND a.handle < b.handle AND {same}"
        f" AND abs({cell('a', 'x')} - {cell('b', 'x')}) <= 1 AND abs({cell('a', 'y')} - {cell('b', 'y')}) <= 1 WHERE {_NEAR} <= {eps} * {eps}), "
    )
    return edges + reach(rows, f"{name}_e", name)


@entry("proximity_clusters", f"o AS (SELECT * FROM e WHERE kind IN {_OUT}), {_proximity('o', 20.0, 'px')} SELECT handle, component FROM px")
def proximity_clusters(e):
    return G.proximity_clusters(e.filter(F.col("kind").isin(*G.OUTLINES)), 20.0).select("handle", "component")


BLOCKS_SQL = f"""o AS (SELECT * FROM e WHERE kind IN {_OUT}), {_proximity('o', 30.0, 'px')}, vb AS (SELECT px.sheet_id, component AS block, count(*) AS n FROM px JOIN o USING (sheet_id, handle) JOIN s USING (sheet_id) GROUP BY px.sheet_id, component, s_min_x, s_min_y, s_max_x, s_max_y
  HAVING count(*) >= 3 AND (max(max_x) - min(min_x)) * (max(max_y) - min(min_y)) >= (s_max_x - s_min_x) * (s_max_y - s_min_y) * 0.001)"""


@entry("visual_blocks", f"{BLOCKS_SQL} SELECT sheet_id, block, n FROM vb")
def visual_blocks(e):
    return G.visual_blocks(e, 30.0)[0].select("sheet_id", "block", "n")


@entry("block_parts", f"{BLOCKS_SQL}, vm AS (SELECT o.*, component AS block FROM px JOIN o USING (sheet_id, handle) WHERE (px.sheet_id, component) IN (SELECT (sheet_id, block) FROM vb)), {_proximity('vm', 10.5, 'py')} SELECT py.sheet_id, component AS part, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'OUTLINE_GROUP' ELSE 'MIXED_GROUP' END AS label FROM py GROUP BY py.sheet_id, component")
def block_parts(e):
    """Groups inside visual blocks with their labels."""
    parts = G.visual_blocks(e, 30.0)[1]
    return parts.groupBy("sheet_id", "part").agg(F.count(F.lit(1)).alias("n"), G.group_label(F.col("kind")).alias("label"))


@entry("group_labels", f"SELECT sheet_id, layer, CASE WHEN o >= greatest(t, d) AND o >= 3 THEN 'OUTLINE_GROUP' WHEN t >= greatest(o, d) AND t >= 2 THEN 'TEXT_GROUP' WHEN d >= greatest(o, t) AND d >= 2 THEN 'DIM_GROUP' ELSE 'MIXED_GROUP' END AS label FROM (SELECT sheet_id, concat(layer, floor(ay / 60)) AS layer, count(*) FILTER (kind IN {_OUT}) AS o, count(*) FILTER (kind IN ('Text', 'MText')) AS t, count(*) FILTER (kind IN {DIM}) AS d FROM e GROUP BY ALL)")
def group_labels(e):
    """Labels of groups by layer and band of 60 units."""
    band = F.concat("layer", F.format_string("%.1f", F.floor(F.col("ay") / 60).cast("double")))
    return e.groupBy("sheet_id", band.alias("layer")).agg(G.group_label(F.col("kind")).alias("label"))


@entry("dimension_groups", None)
def dimension_groups(e):
    """Groups that grow in order have no SQL; tested against a plain version."""
    return G.dimension_groups(e)


# --- grids --------------------------------------------------------------------------------------


def _point_islands(parts: int) -> str:
    at = lambda v: f"CAST(floor(round((a{v} - {v}0) / (CASE WHEN span > 0 THEN span / {parts} ELSE 1 END), 9)) AS BIGINT)"
    return (
        f"sp AS (SELECT sheet_id, min(ax) AS x0, min(ay) AS y0, greatest(max(ax) - min(ax), max(ay) - min(ay)) AS span FROM e WHERE kind = 'Circle' GROUP BY sheet_id),"
        f" pc AS (SELECT DISTINCT e.sheet_id, {at('x')} AS cx, {at('y')} AS cy FROM e JOIN sp USING (sheet_id) WHERE kind = 'Circle'), pn AS (SELECT *, cy * {parts + 1} + cx AS handle FROM pc),"
        f" pe AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM pn a JOIN pn b ON a.sheet_id = b.sheet_id AND a.handle < b.handle WHERE power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2) <= 2.25), {reach('pn', 'pe', 'pi')}"
    )


@entry("point_islands", f"{_point_islands(30)} SELECT pi.sheet_id, cx, cy, component AS island FROM pi JOIN pn USING (sheet_id, handle)")
def point_islands(e):
    """Anchors of circles on a grid of a thirtieth of the range; neighbours within 1.5 cells."""
    return G.point_islands(e.filter("kind = 'Circle'").select("sheet_id", F.col("ax").alias("x"), F.col("ay").alias("y")), 30)


@entry("fine_islands", f"{_point_islands(200)} SELECT pi.sheet_id, component AS island, count(*) AS cells FROM pi GROUP BY pi.sheet_id, component")
def fine_islands(e):
    x = G.point_islands(e.filter("kind = 'Circle'").select("sheet_id", F.col("ax").alias("x"), F.col("ay").alias("y")), 200)
    return x.groupBy("sheet_id", "island").agg(F.count(F.lit(1)).alias("cells"))


STROKES_SQL = """ls AS (SELECT sheet_id, handle, sx / 40 AS x0, sy / 40 AS y0, ex / 40 AS x1, ey / 40 AS y1 FROM d WHERE kind = 'Line'),
 tt AS (SELECT *, CASE WHEN x0 <> x1 THEN list_transform(range(CAST(ceil(least(x0, x1)) AS BIGINT), CAST(floor(greatest(x0, x1)) AS BIGINT) + 1), lambda k: round((k - x0) / (x1 - x0), 12)) ELSE [] END AS tx, CASE WHEN y0 <> y1 THEN list_transform(range(CAST(ceil(least(y0, y1)) AS BIGINT), CAST(floor(greatest(y0, y1)) AS BIGINT) + 1), lambda k: round((k - y0) / (y1 - y0), 12)) ELSE [] END AS ty FROM ls),
 ts AS (SELECT *, list_sort(list_distinct(list_concat([0.0::DOUBLE, 1.0::DOUBLE], tx, ty))) AS t, list_intersect(tx, ty) AS b FROM tt),
 sc AS (SELECT sheet_id, handle, floor(x0 + (x1 - x0) * (t[i] + t[i + 1]) * 0.5) AS cx, floor(y0 + (y1 - y0) * (t[i] + t[i + 1]) * 0.5) AS cy FROM (SELECT *, unnest(range(1, len(t))) AS i FROM ts)
  UNION SELECT sheet_id, handle, floor(x0 + (x1 - x0) * (u + 1e-7)), floor(y0 + (y1 - y0) * (u - 1e-7)) FROM (SELECT *, unnest(b) AS u FROM ts) WHERE u > 0 AND u < 1),
 cells AS (SELECT DISTINCT sheet_id, handle, CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy FROM sc)"""


@of_primitives("stroke_cells", f"{STROKES_SQL} SELECT handle, cx, cy FROM cells")
def stroke_cells(d):
    """Cells of 40 units that lines pass, corners by both sides."""
    return G.stroke_cells(d.filter("kind = 'Line'").select("sheet_id", "handle", "sx", "sy", "ex", "ey"), 40.0).select("handle", "cx", "cy")


@of_primitives("corner_gaps", f"{STROKES_SQL}, q AS (SELECT sheet_id, handle, cx - dx AS x, cy - dy AS y, dx, dy FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dx, dy)), g AS (SELECT sheet_id, handle, x, y, sum(x + dx) AS sx, sum(y + dy) AS sy FROM q GROUP BY sheet_id, handle, x, y HAVING count(*) = 3) SELECT DISTINCT g.sheet_id, CAST(4 * x + 2 - sx AS BIGINT) AS cx, CAST(4 * y + 2 - sy AS BIGINT) AS cy FROM g")
def corner_gaps(d):
    """Cells that close a corner: the fourth of two by two of which one stroke passes three."""
    cells = G.stroke_cells(d.filter("kind = 'Line'").select("sheet_id", "handle", "sx", "sy", "ex", "ey"), 40.0)
    four = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (0, 1) for b in (0, 1)]))
    q = cells.select("sheet_id", "handle", "cx", "cy", four.alias("s")).groupBy("sheet_id", "handle", (F.col("cx") - F.col("s.dx")).alias("x"), (F.col("cy") - F.col("s.dy")).alias("y"))
    g = q.agg(F.count(F.lit(1)).alias("n"), F.sum("cx").alias("tx"), F.sum("cy").alias("ty")).filter("n = 3")
    return g.select("sheet_id", (F.col("x") * 4 + 2 - F.col("tx")).alias("cx"), (F.col("y") * 4 + 2 - F.col("ty")).alias("cy")).distinct()


def grid_rows(e):
    """Cells of a 30 by 20 grid along the border of every sheet, and those of circles inside."""
    return D.occupied_cells(e.filter("kind = 'Circle'")).select("sheet_id", "row", "col")


@entry("frame_islands", f"""gq AS (SELECT e.sheet_id, (c_max_x - c_min_x) / 30 AS cw, (c_max_y - c_min_y) / 20 AS ch, c_min_x, c_min_y, min_x, min_y, max_x, max_y FROM e JOIN (SELECT sheet_id, min(min_x) AS c_min_x, min(min_y) AS c_min_y, max(max_x) AS c_max_x, max(max_y) AS c_max_y FROM e WHERE kind = 'Circle' GROUP BY sheet_id) USING (sheet_id) WHERE kind = 'Circle' AND c_max_x > c_min_x AND c_max_y > c_min_y),
 go AS (SELECT DISTINCT sheet_id, CAST(rr.r AS INTEGER) AS row, CAST(cc.c AS INTEGER) AS col FROM gq, range(20) rr(r), range(30) cc(c) WHERE rr.r BETWEEN greatest(0, least(19, floor((min_y - c_min_y) / ch))) AND greatest(0, least(19, floor((max_y - c_min_y) / ch))) AND cc.c BETWEEN greatest(0, least(29, floor((min_x - c_min_x) / cw))) AND greatest(0, least(29, floor((max_x - c_min_x) / cw))) AND rr.r > 2 AND rr.r < 17 AND cc.c > 2 AND cc.c < 27
  UNION SELECT DISTINCT sheet_id, CAST(0 AS INTEGER), CAST(c AS INTEGER) FROM gq, range(30) t(c) UNION SELECT DISTINCT sheet_id, CAST(19 AS INTEGER), CAST(c AS INTEGER) FROM gq, range(30) t(c) WHERE sheet_id % 2 = 0 UNION SELECT DISTINCT sheet_id, CAST(r AS INTEGER), CAST(0 AS INTEGER) FROM gq, range(20) t(r) WHERE sheet_id % 2 = 0 UNION SELECT DISTINCT sheet_id, CAST(r AS INTEGER), CAST(29 AS INTEGER) FROM gq, range(20) t(r) WHERE sheet_id % 2 = 0),
 gn AS (SELECT *, CAST(row * 30 + col AS BIGINT) AS handle FROM go), ge AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM gn a JOIN gn b ON a.sheet_id = b.sheet_id AND a.handle < b.handle AND abs(a.row - b.row) + abs(a.col - b.col) = 1), {reach('gn', 'ge', 'gi')},
 gs AS (SELECT gi.sheet_id, component, count(*) AS n, count(*) FILTER (row IN (0, 19) OR col IN (0, 29)) AS touch, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM gi JOIN gn USING (sheet_id, handle) GROUP BY gi.sheet_id, component)
 SELECT sheet_id, component AS island, n, touch >= greatest(6, n * 0.35) AND ((c0 = 0 AND c1 = 29 AND r1 - r0 + 1 <= 2) OR (r0 = 0 AND r1 = 19 AND c1 - c0 + 1 <= 2) OR (r0 = 0 AND r1 = 19 AND c0 = 0 AND c1 = 29 AND n <= 100)) AS is_frame FROM gs""")  # fmt: skip
def frame_islands(e):
    """Rings on every second sheet and bands on the others, around cells of circles."""
    from drawlake.operators.spatial import connected

    cells = grid_rows(e)
    sheets = cells.select("sheet_id").distinct()
    inner = cells.filter("row > 2 AND row < 17 AND col > 2 AND col < 27")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    even = sheets.filter("sheet_id % 2 = 0")
    line = lambda rows, row, col: rows.select("sheet_id", row.alias("row"), col.alias("col"))
    edges = line(sheets, F.lit(0), span(30)).unionByName(line(even, F.lit(19), span(30))).unionByName(line(even, span(20), F.lit(0))).unionByName(line(even, span(20), F.lit(29)))
    nodes = inner.unionByName(edges).distinct().withColumn("handle", (F.col("row") * 30 + F.col("col")).cast("bigint"))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")), F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc"))))
    moved = nodes.select("*", steps.alias("s")).select("sheet_id", F.col("handle").alias("a"), (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    pairs = moved.join(nodes.withColumnRenamed("handle", "b"), ["sheet_id", "row", "col"]).select("sheet_id", "a", "b")
    islands = connected(nodes, pairs).select("sheet_id", "row", "col", F.col("component").alias("island"))
    return G.frame_islands(islands).groupBy("sheet_id", "island").agg(F.count(F.lit(1)).alias("n"), F.first("is_frame").alias("is_frame"))


# --- loops, styles, spans -----------------------------------------------------------------------


@of_primitives("nested_loops", """lp AS (SELECT sheet_id, handle * 4 + k AS loop_id, x - k * 6 AS min_x, y - k * 6 AS min_y, x + w + k * 6 AS max_x, y + h + k * 6 AS max_y FROM d, range(3) t(k) WHERE kind IN ('Polyline', 'Solid') AND closed),
 pp AS (SELECT a.sheet_id, a.loop_id, b.loop_id AS parent, row_number() OVER (PARTITION BY a.loop_id ORDER BY (b.max_x - b.min_x) * (b.max_y - b.min_y), b.loop_id) AS k FROM lp a JOIN lp b ON a.sheet_id = b.sheet_id AND (b.max_x - b.min_x) * (b.max_y - b.min_y) > (a.max_x - a.min_x) * (a.max_y - a.min_y)
  AND (a.min_x + a.max_x) * 0.5 BETWEEN b.min_x - 1e-9 AND b.max_x + 1e-9 AND (a.min_y + a.max_y) * 0.5 BETWEEN b.min_y - 1e-9 AND b.max_y + 1e-9), pr AS (SELECT loop_id, parent FROM pp WHERE k = 1),
 dp(loop_id, up, depth) AS (SELECT lp.loop_id, parent, CASE WHEN parent IS NULL THEN 0 ELSE 1 END FROM lp LEFT JOIN pr USING (loop_id) UNION ALL SELECT dp.loop_id, pr.parent, dp.depth + 1 FROM dp JOIN pr ON pr.loop_id = dp.up)
 SELECT m.loop_id, pr.parent, CAST(m.depth AS INTEGER) AS depth, m.depth % 2 = 1 AS is_hole FROM (SELECT loop_id, max(depth) AS depth FROM dp GROUP BY loop_id) m LEFT JOIN pr USING (loop_id)""")  # fmt: skip
def nested_loops(d):
    """Closed polylines and solids, each with two outlines around it."""
    ring = d.filter("kind IN ('Polyline', 'Solid') AND closed").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    loops = ring.select(
        "sheet_id", (F.col("handle") * 4 + F.col("k")).alias("loop_id"), (F.col("x") - F.col("k") * 6).alias("min_x"), (F.col("y") - F.col("k") * 6).alias("min_y"),
        (F.col("x") + F.col("w") + F.col("k") * 6).alias("max_x"), (F.col("y") + F.col("h") + F.col("k") * 6).alias("max_y"),
    )
    return G.nested_loops(loops).select("loop_id", "parent", "depth", "is_hole")


@entry("covered_share", "cl AS (SELECT sheet_id, handle, greatest(min_x, 200) AS a, least(max_x, 500) AS b FROM e WHERE kind = 'Line'), l AS (SELECT *, max(b) OVER (PARTITION BY sheet_id ORDER BY a, handle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cl WHERE b > a) SELECT sheet_id, round(sum(greatest(0, b - greatest(a, coalesce(reach, a)))) / 300, 6) AS share FROM l GROUP BY sheet_id")
def covered_share(e):
    return G.covered_share(e.filter("kind = 'Line'"), 200.0, 500.0).select("sheet_id", r("share"))


@of_primitives("style_shares", "g AS (SELECT sheet_id, block_path, layer, linetype, count(*) AS n FROM d WHERE kind IN ('Line', 'Polyline', 'Arc') GROUP BY ALL) SELECT sheet_id, block_path, round(max(n) / sum(n), 6) AS consistency FROM g GROUP BY sheet_id, block_path")
def style_shares(d):
    """How much of a unit's strokes are of its most frequent style; null styles are one style."""
    g = d.filter("kind IN ('Line', 'Polyline', 'Arc')").groupBy("sheet_id", "block_path", "layer", "linetype").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("sheet_id", "block_path").agg(F.round(F.max("n") / F.sum("n"), 6).alias("consistency"))


@entry("canonical_counts", f"SELECT sheet_id, count(DISTINCT CASE WHEN p THEN block_path END) AS preserved, count(DISTINCT CASE WHEN NOT p THEN block_path END) AS collapsed, count(*) FILTER (kind IN {GEO}) AS geometry, count(*) FILTER (kind IN {TEXT}) AS texts, count(*) FILTER (kind IN {DIM}) AS dimensions FROM (SELECT e.*, c.p FROM e LEFT JOIN (SELECT sheet_id, block_path, NOT ((count(*) = 1 AND count(*) FILTER (kind = 'BlockReference') = 1) OR (count(*) <= 2 AND count(*) FILTER (kind IN {GEO}) = 0 AND count(*) FILTER (kind IN {TEXT} OR kind IN {DIM}) <= 1)) AS p FROM e WHERE block_path IS NOT NULL GROUP BY ALL) c USING (sheet_id, block_path)) GROUP BY sheet_id")
def canonical_counts(e):
    """Nodes of each sheet's tree by kind: preserved and collapsed blocks and three sorts of leaves."""
    from drawlake.operators import units as U

    kind = F.col("kind")
    x = e.join(U.block_decisions(e).select("sheet_id", "block_path", "preserve"), ["sheet_id", "block_path"], "left")
    return x.groupBy("sheet_id").agg(
        F.count_distinct(F.when(F.col("preserve"), F.col("block_path"))).alias("preserved"), F.count_distinct(F.when(~F.col("preserve"), F.col("block_path"))).alias("collapsed"),
        F.count_if(K.is_geometry(kind)).alias("geometry"), F.count_if(K.is_text(kind)).alias("texts"), F.count_if(K.is_dimension(kind)).alias("dimensions"),
    )


@of_primitives("form_lines", """x AS (SELECT sheet_id, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM d GROUP BY sheet_id), q AS (SELECT d.*, x0, y0, x1, y1, x1 - x0 AS tw, y1 - y0 AS th, max_x - min_x AS bw, max_y - min_y AS bh FROM d JOIN x USING (sheet_id) WHERE kind IN ('Line', 'Polyline') AND min_x IS NOT NULL)
 SELECT handle FROM q WHERE (kind = 'Polyline' AND abs(min_x - x0) <= tw * 0.025 AND abs(max_x - x1) <= tw * 0.025 AND abs(min_y - y0) <= th * 0.025 AND abs(max_y - y1) <= th * 0.025 AND bw >= tw * 0.85 AND bh >= th * 0.85) OR (bw / tw >= 0.6 AND bh / th <= 0.04 AND (min_y <= y0 + th * 0.025 OR max_y >= y1 - th * 0.025))
  OR (bh / th >= 0.6 AND bw / tw <= 0.04 AND (min_x <= x0 + tw * 0.025 OR max_x >= x1 - tw * 0.025)) OR (max_y <= y0 + th * 0.22 AND ((bw / tw >= 0.18 AND bh / th <= 0.04) OR (bh / th >= 0.18 AND bw / tw <= 0.04)))""")  # fmt: skip
def form_lines(d):
    return D.with_sheet(d, D.sheet_bounds(d)).filter("min_x IS NOT NULL").filter(G.is_form_line()).select("handle")


@entry("sub_clusters", f"""um AS (SELECT * FROM e WHERE block_path IS NOT NULL), sd AS (SELECT * FROM um WHERE kind IN {GEO}), md AS (SELECT sheet_id, block_path, quantile_cont(sqrt(power(max_x - min_x, 2) + power(max_y - min_y, 2)), 0.5) AS m FROM sd WHERE max_x > min_x OR max_y > min_y GROUP BY ALL),
 gp AS (SELECT DISTINCT um.sheet_id, um.block_path, greatest(1.5, least(8, coalesce(m, 0) * 0.2)) AS gap FROM um LEFT JOIN md USING (sheet_id, block_path)),
 sx AS (SELECT sd.*, gap FROM sd JOIN gp USING (sheet_id, block_path)), ue AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM sx a JOIN sx b ON a.sheet_id = b.sheet_id AND a.block_path = b.block_path AND a.handle < b.handle
  WHERE (greatest(0, b.min_x - a.max_x, a.min_x - b.max_x) <= a.gap AND greatest(0, b.min_y - a.max_y, a.min_y - b.max_y) <= a.gap) OR power(a.ax - b.ax, 2) + power(a.ay - b.ay, 2) <= a.gap * a.gap), {reach('sd', 'ue', 'uc')},
 ub AS (SELECT uc.sheet_id, sx.block_path, component AS cluster_id, any_value(gap) AS gap, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM uc JOIN sx USING (sheet_id, handle) GROUP BY ALL),
 ut AS (SELECT um.handle, cluster_id, sqrt(power(greatest(0, x0 - ax, ax - x1), 2) + power(greatest(0, y0 - ay, ay - y1), 2)) AS dist, gap FROM um JOIN ub USING (sheet_id, block_path) WHERE kind IN {TEXT}),
 uk AS (SELECT handle, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY dist, cluster_id) AS k FROM ut WHERE dist <= greatest(8, least(30, gap * 3))) WHERE k = 1)
 SELECT handle, component AS cluster_id FROM uc UNION ALL SELECT um.handle, cluster_id FROM um LEFT JOIN uk USING (handle) WHERE kind IN {TEXT}""")  # fmt: skip
def sub_clusters(e):
    return G.sub_clusters(e.filter("block_path IS NOT NULL"), "block_path").select("handle", "cluster_id")


@entry("position_holders", f"""{VIEWS_SQL}, {VPAIRS_SQL}, an AS (SELECT * FROM (SELECT sheet_id, view_id AS anchor, row_number() OVER (PARTITION BY sheet_id ORDER BY (max_x - min_x) * (max_y - min_y) DESC, view_id) AS k FROM v) WHERE k = 1),
 q AS (SELECT vs.sheet_id, target_id, round(score, 9) AS score, CASE WHEN gx <= 1e-9 AND gy <= 1e-9 THEN 'Overlapping' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'RightOf' ELSE 'LeftOf' END WHEN dy >= 0 THEN 'Above' ELSE 'Below' END AS position FROM vs JOIN an ON an.sheet_id = vs.sheet_id AND source_id = anchor)
 SELECT sheet_id, position, target_id AS view_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, position ORDER BY score DESC, target_id) AS k FROM q) WHERE k = 1""")  # fmt: skip
def position_holders(e):
    """For each position around a sheet's largest view the view that relates best to it."""
    from drawlake.operators.spatial import best_per

    v = block_views(e)
    anchor = best_per(v.withColumn("area", B.box().area), ["sheet_id"], [F.col("area").desc(), F.col("view_id")]).select("sheet_id", F.col("view_id").alias("source_id"))
    pairs = D.view_pairs(v).join(anchor, ["sheet_id", "source_id"]).withColumn("score", F.round("score", 9))
    best = best_per(pairs, ["sheet_id", "direction"], [F.col("score").desc(), F.col("target_id")])
    return best.select("sheet_id", F.col("direction").alias("position"), F.col("target_id").alias("view_id"), r("score"))


# --- refined roles ------------------------------------------------------------------------------

_NEARBY = "(ax BETWEEN {p}x0 - {t} AND {p}x1 + {t} AND ay BETWEEN {p}y0 - {t} AND {p}y1 + {t}) OR (min_x <= {p}x1 + {t} AND {p}x0 - {t} <= max_x AND min_y <= {p}y1 + {t} AND {p}y0 - {t} <= max_y)"


@entry("refined_roles", f"""{CONTENT_SQL}, kk AS (SELECT sheet_id, min_x AS gx0, min_y AS gy0, max_x AS gx1, max_y AS gy1 FROM cr WHERE region_id = 'geometry-main'),
 q AS (SELECT e.*, CASE WHEN ay <= s_min_y + (s_max_y - s_min_y) * 0.26 THEN 'TitleBlock' WHEN ax >= s_max_x - (s_max_x - s_min_x) * 0.24 THEN 'MetaTable' ELSE 'Geometry' END AS rk, coalesce({_NEARBY.format(p='g', t=3)}, false) AS near3, coalesce({_NEARBY.format(p='g', t=6)}, false) AS near6, upper(trim(coalesce(text, ''))) AS t FROM e JOIN s USING (sheet_id) LEFT JOIN kk USING (sheet_id)),
 m AS (SELECT *, contains(t, 'QTY') OR contains(t, 'MAT') OR contains(t, 'SCALE') OR contains(t, 'NO') OR contains(t, 'SPEC') OR (regexp_matches(t, '^[A-Z0-9\\-\\._/ ]{{1,40}}$') AND trim(t) <> '' AND length(t) <= 12) AS strong FROM q)
 SELECT handle, CASE WHEN kind IN {GEO} AND near3 THEN 'geometry-main' WHEN kind IN {DIM} AND near6 THEN 'drawing-content' WHEN kind IN {TEXT} AND near6 AND NOT strong THEN 'drawing-content' WHEN rk IN ('MetaTable', 'TitleBlock') AND kind IN {GEO} AND near6 THEN 'geometry-main' ELSE 'unchanged' END AS region_id,
  CASE WHEN kind IN {GEO} AND near3 THEN 'Geometry' WHEN kind IN {DIM} AND near6 THEN 'Dimension' WHEN kind IN {TEXT} AND near6 AND NOT strong THEN 'Text' WHEN rk IN ('MetaTable', 'TitleBlock') AND kind IN {GEO} AND near6 THEN 'Geometry' ELSE 'unchanged' END AS role FROM m""")  # fmt: skip
def refined_roles(e):
    """Entities that the drawing content takes back from bands of metadata."""
    from drawlake.functions import cadtext as T

    content = V.content_regions(e).filter("region_id = 'geometry-main'").select("sheet_id", *[F.col(c).alias(f"k_{c}") for c in V.BOX])
    x = D.preliminary_region(e).select("sheet_id", "handle", "region_kind").join(e, ["sheet_id", "handle"]).join(content, "sheet_id", "left")
    b, c, kind = B.box(), B.box("k_"), F.col("kind")
    near = lambda t: F.coalesce(B.contains_point(B.inflated(c, t), F.col("ax"), F.col("ay")) | B.intersects(B.inflated(c, t), b), F.lit(False))
    t = K.plain(F.col("text"))
    strong = T.is_meta_label(t) | (T.is_meta_value(t) & (F.length(t) <= 12))
    geo, dim, text, meta = K.is_geometry(kind), K.is_dimension(kind), K.is_text(kind), F.col("region_kind").isin("MetaTable", "TitleBlock")
    pick = lambda a, d, w, g: F.when(geo & near(3.0), a).when(dim & near(6.0), d).when(text & near(6.0) & ~strong, w).when(meta & geo & near(6.0), g).otherwise("unchanged")
    return x.select("handle", pick("geometry-main", "drawing-content", "drawing-content", "geometry-main").alias("region_id"), pick("Geometry", "Dimension", "Text", "Geometry").alias("role"))


# --- sheets with a frame ------------------------------------------------------------------------

#: Every sheet gets a frame around it and a slightly smaller one inside; handles below zero.
FRAMED_SQL = ENTITIES_SQL.replace("e AS (", "e0 AS (", 1) + (
    ", s0 AS (SELECT sheet_id, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM e0 GROUP BY sheet_id),"
    " e1 AS (SELECT sheet_id, -2 * sheet_id - 1 - k AS handle, 'Polyline' AS kind, 'FRAME' AS layer, x0 - 12 + 3 * k AS min_x, y0 - 12 + 3 * k AS min_y, x1 + 12 - 3 * k AS max_x, y1 + 12 - 3 * k AS max_y, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS block_path FROM s0, range(2) t(k)),"
    " e AS (SELECT * FROM e0 UNION ALL SELECT *, (min_x + max_x) * 0.5 AS ax, (min_y + max_y) * 0.5 AS ay, CAST(NULL AS VARCHAR) AS block_name, CAST(0 AS INTEGER) AS depth FROM e1)"
)


def framed_entities(spark, sf_dir):
    e = entities(spark, sf_dir)
    s = D.sheet_bounds(e).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1))))
    edge = F.lit(12.0) - F.col("k") * 3
    frame = s.select(
        "sheet_id", (F.col("sheet_id") * -2 - 1 - F.col("k")).alias("handle"), F.lit("Polyline").alias("kind"), F.lit("FRAME").alias("layer"), (F.col("min_x") - edge).alias("min_x"), (F.col("min_y") - edge).alias("min_y"),
        (F.col("max_x") + edge).alias("max_x"), (F.col("max_y") + edge).alias("max_y"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("block_path"),
    )
    return e.unionByName(with_derived(frame))


def framed(name: str, sql: str):
    return entry(name, sql, framed_entities, f"{FRAMED_SQL}, {SHEETS_SQL}")


_SIDE = "CASE WHEN abs({0} - s_{0}) <= 1.25 THEN 1.0 WHEN abs({0} - s_{0}) <= 2.5 THEN 0.7 WHEN abs({0} - s_{0}) <= 5 THEN 0.4 WHEN abs({0} - s_{0}) <= 10 THEN 0.1 ELSE 0 END"
FRAME_SQL = f"""fc AS (SELECT e.*, (max_x - min_x) * (max_y - min_y) / ((s_max_x - s_min_x) * (s_max_y - s_min_y)) AS coverage, s.* EXCLUDE (sheet_id) FROM e JOIN s USING (sheet_id) WHERE max_x > min_x AND max_y > min_y),
 fs AS (SELECT *, 1 - abs(1 - coverage) + {' + '.join(_SIDE.format(c) for c in ('min_x', 'max_x', 'min_y', 'max_y'))} AS score FROM fc WHERE coverage BETWEEN 0.85 AND 1.02), fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, handle) AS k FROM fs) WHERE k = 1)"""


@framed("framed_outer_frame", f"{FRAME_SQL} SELECT sheet_id, handle, round(score, 6) AS score FROM fr")
def framed_outer_frame(e):
    return D.outer_frame(e).select("sheet_id", "handle", r("score"))


@framed("framed_content", f"""{ZONES_SQL}, {FRAME_SQL}, gone AS (SELECT zm.sheet_id, handle FROM zm JOIN zones ON zm.sheet_id = zones.sheet_id AND zm.zone = zones.zone UNION SELECT sheet_id, handle FROM fr),
 kept AS (SELECT e.*, fr.min_x AS fx0, fr.min_y AS fy0, fr.max_x AS fx1, fr.max_y AS fy1 FROM e LEFT JOIN fr ON fr.sheet_id = e.sheet_id WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.sheet_id = e.sheet_id AND g.handle = e.handle) AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.sheet_id = e.sheet_id
  AND ((e.min_x >= z.min_x - 2 AND e.max_x <= z.max_x + 2 AND e.min_y >= z.min_y - 2 AND e.max_y <= z.max_y + 2) OR (e.ax BETWEEN z.min_x - 2 AND z.max_x + 2 AND e.ay BETWEEN z.min_y - 2 AND z.max_y + 2))))
 SELECT sheet_id, count(*) AS n, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM kept WHERE fx0 IS NULL OR (min_x <= fx1 - 2 AND fx0 + 2 <= max_x AND min_y <= fy1 - 2 AND fy0 + 2 <= max_y
  AND NOT ((kind IN {TEXT} OR kind IN ('Line', 'Polyline', 'Leader')) AND ax BETWEEN fx0 AND fx1 AND ay BETWEEN fy0 AND fy1 AND NOT (ax BETWEEN fx0 + 2 AND fx1 - 2 AND ay BETWEEN fy0 + 2 AND fy1 - 2))) GROUP BY sheet_id""")  # fmt: skip
def framed_content(e):
    """Content of sheets whose frame is found and taken away."""
    return D.sheet_bounds(D.residual_content(e)).select("sheet_id", "n", "min_x", "min_y", "max_x", "max_y")


@framed("framed_like", """c AS (SELECT sheet_id, handle AS cluster_id, min_x, min_y, max_x, max_y, 4 AS n, 0 AS rounds FROM e WHERE handle < 0 OR kind = 'Circle'), t AS (SELECT c.*, s.* EXCLUDE (sheet_id), greatest(s_max_x - s_min_x, s_max_y - s_min_y) * 0.015 AS tol FROM c JOIN s USING (sheet_id)),
 p AS (SELECT sheet_id, cluster_id, ((max_x - min_x) * (max_y - min_y) / ((s_max_x - s_min_x) * (s_max_y - s_min_y)) >= 0.72)::INT + ((max_x - min_x) / (s_max_x - s_min_x) >= 0.9)::INT + ((max_y - min_y) / (s_max_y - s_min_y) >= 0.9)::INT
  + ((abs(min_x - s_min_x) <= tol)::INT + (abs(min_y - s_min_y) <= tol)::INT + (abs(max_x - s_max_x) <= tol)::INT + (abs(max_y - s_max_y) <= tol)::INT >= 3)::INT + (sqrt(power((min_x + max_x - s_min_x - s_max_x) * 0.5, 2) + power((min_y + max_y - s_min_y - s_max_y) * 0.5, 2)) / sqrt(power(s_max_x - s_min_x, 2) + power(s_max_y - s_min_y, 2)) <= 0.05)::INT + 1 AS points FROM t)
 SELECT sheet_id, cluster_id, points, points >= 4 AS is_frame FROM p""")  # fmt: skip
def framed_like(e):
    c = e.filter("handle < 0 OR kind = 'Circle'").select("sheet_id", F.col("handle").alias("cluster_id"), *V.BOX, F.lit(4).alias("n"), F.lit(0).alias("rounds"))
    return D.frame_like(c, D.sheet_bounds(e))


REGION_BOXES = "rg AS (SELECT sheet_id, 'a' AS region_id, s_min_x + 40 AS x0, s_min_y + 40 AS y0, s_min_x + 260 AS x1, s_min_y + 200 AS y1, 0.5 AS confidence FROM s UNION ALL SELECT sheet_id, 'b', s_min_x + 280, s_min_y + 210, s_min_x + 500, s_min_y + 420, 0.6 FROM s UNION ALL SELECT sheet_id, 'c', s_min_x + 60, s_min_y + 60, s_min_x + 120, s_min_y + 100, 0.4 FROM s)"


@entry("region_tiers", f"""{REGION_BOXES}, p AS (SELECT e.sheet_id, handle, region_id, confidence, (x1 - x0) * (y1 - y0) AS area, ax BETWEEN x0 - 1 AND x1 + 1 AND ay BETWEEN y0 - 1 AND y1 + 1 AS inside,
  greatest(0, least(max_x, x1) - greatest(min_x, x0)) * greatest(0, least(max_y, y1) - greatest(min_y, y0)) AS common, (max_x - min_x) * (max_y - min_y) AS ea, sqrt(power(greatest(0, x0 - max_x, min_x - x1), 2) + power(greatest(0, y0 - max_y, min_y - y1), 2)) AS gap FROM e JOIN rg USING (sheet_id)),
 t AS (SELECT *, CASE WHEN inside THEN 0 WHEN common > 0 AND least(ea, area) > 0 THEN 1 WHEN gap <= 12 THEN 2 END AS tier FROM p)
 SELECT e.handle, k.region_id, CAST(k.tier AS INTEGER) AS tier FROM e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, handle ORDER BY tier, CASE tier WHEN 0 THEN 0 WHEN 1 THEN -common / least(ea, area) ELSE gap END, area, confidence DESC, region_id) AS k FROM t WHERE tier IS NOT NULL) WHERE k = 1) k ON k.handle = e.handle""")  # fmt: skip
def region_tiers(e):
    """Regions that hold some anchors, meet other boxes, are near others and miss the rest."""
    s = D.sheet_bounds(e)
    at = lambda c, v: (F.col(c) + v)
    box = lambda n, x0, y0, x1, y1, k: F.struct(F.lit(n).alias("region_id"), F.lit("Geometry").alias("region_kind"), at("min_x", x0).alias("min_x"), at("min_y", y0).alias("min_y"), at("min_x", x1).alias("max_x"), at("min_y", y1).alias("max_y"), F.lit(k).alias("confidence"))
    regions = s.select("sheet_id", F.explode(F.array(box("a", 40, 40, 260, 200, 0.5), box("b", 280, 210, 500, 420, 0.6), box("c", 60, 60, 120, 100, 0.4))).alias("r")).select("sheet_id", "r.*")
    return D.best_region(e, regions).select("handle", "region_id", "tier")


@entry("deep_prefixes", "p AS (SELECT sheet_id, layer, list(string_split(concat('ROOT>', CASE WHEN layer = 'hl' THEN 'SUB>' ELSE '' END, block_path), '>')) AS ps FROM e WHERE block_path IS NOT NULL GROUP BY sheet_id, layer) SELECT sheet_id, layer, array_to_string(ps[1][1:coalesce(list_max(list_filter(range(1, 9), lambda n: n <= list_min(list_transform(ps, lambda p: len(p))) AND len(list_distinct(list_transform(ps, lambda p: array_to_string(p[1:n], '>')))) = 1)), 0)], '>') AS prefix FROM p")
def deep_prefixes(e):
    """The longest path that all of a layer's entities share, of paths below a common root."""
    path = F.split(F.concat(F.lit("ROOT>"), F.when(F.col("layer") == "hl", "SUB>").otherwise(""), "block_path"), ">")
    g = e.filter("block_path IS NOT NULL").withColumn("p", path).groupBy("sheet_id", "layer").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    # Of sorted paths the first and the last share what all share.
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), lambda n: F.slice("lo", F.lit(1), n) == F.slice("hi", F.lit(1), n))
    return g.select("sheet_id", "layer", F.array_join(F.slice("lo", F.lit(1), F.size(F.filter(same, lambda x: x))), ">").alias("prefix"))
