"""Queries of outer contours and closed chains, over views of drawn parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import kinds as K
from drawlake.operators import grids as G
from drawlake.operators import tracing as T
from drawlake.operators import viewsets as VS
from drawlake.operators.spatial import box_of
from drawlake.sources.strokes import STROKES_SQL, strokes
from drawlake.storage import joinable

ENTRIES: dict = {}


def entry(name: str, sql: str | None):
    def register(f):
        # Written once: columns made of columns would be computed anew wherever they are used.
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(joinable(strokes(spark, sf_dir), "strokes"))), None if sql is None else f"WITH RECURSIVE {STROKES_SQL}, {sql}"
        return f

    return register


def ring_views(d):
    """The boxes of the rings, grown by 2, as views."""
    v = box_of(d.filter("ring < 11 AND kind <> 'Text'"), "sheet_id", F.col("ring").alias("view_id"))
    return v.select("sheet_id", "view_id", *[(F.col(c) + (-2.0 if c.startswith("min") else 2.0)).alias(c) for c in T.BOX])


def _mentions(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_LAY, _LT = "upper(trim(coalesce(layer, '')))", "upper(trim(coalesce(linetype, '')))"
_BOTH = lambda words: f"({_mentions(_LAY, words)} OR {_mentions(_LT, words)})"
_SMOOTH = f"({_LT} = '' OR contains({_LT}, 'CONTINUOUS') OR contains({_LT}, 'BYLAYER'))"
_V = "v_min_x, v_min_y, v_max_x, v_max_y"
VIEWS_SQL = (
    "vw AS (SELECT sheet_id, ring AS view_id, min(min_x) - 2 AS v_min_x, min(min_y) - 2 AS v_min_y, max(max_x) + 2 AS v_max_x, max(max_y) + 2 AS v_max_y"
    " FROM d WHERE ring < 11 AND kind <> 'Text' GROUP BY ALL)"
)
STROKES_IN_VIEWS_SQL = (
    f"{VIEWS_SQL}, st AS (SELECT vw.sheet_id, view_id, {_V}, d.* EXCLUDE (sheet_id, ring), {_LT} AS lt, {_LAY} AS lay, {_SMOOTH} AS smooth,"
    f" CASE WHEN {_SMOOTH} THEN '' ELSE {_LT} END AS loose, {_mentions(_LAY, K.FLAG_CONTOUR)} AS contour"
    " FROM vw JOIN d ON vw.sheet_id = d.sheet_id AND min_x <= v_max_x AND max_x >= v_min_x AND min_y <= v_max_y AND max_y >= v_min_y"
    f" WHERE kind IN ('Line', 'Polyline', 'Arc', 'Circle', 'Ellipse') AND NOT {_BOTH(K.FLAG_CENTER)} AND NOT {_BOTH(K.FLAG_HIDDEN)} AND NOT {_mentions(_LAY, K.FLAG_TITLE)} AND NOT {_mentions(_LAY, K.FLAG_TABLE)})"
)
_SHORT = "greatest(1.0, least(v_max_x - v_min_x, v_max_y - v_min_y))"
_TOL = f"greatest(2.0, {_SHORT} * 0.015)"
_BAND = "greatest(4.0, least(v_max_x - v_min_x, v_max_y - v_min_y) * 0.10)"
_ARC = "radius * radians(((end_deg - start_deg) % 360 + 360) % 360)"
_OVAL = "pi() * (radius + radius * ratio) * (1 + 3 * pow((radius - radius * ratio) / (radius + radius * ratio), 2) / (10 + sqrt(4 - 3 * pow((radius - radius * ratio) / (radius + radius * ratio), 2))))"
_KEEP = f"sheet_id, view_id, {_V}, handle, color, weight, lt, lay, smooth, loose, contour"
_PTS = "least(x0, x1) AS e_min_x, least(y0, y1) AS e_min_y, greatest(x0, x1) AS e_max_x, greatest(y0, y1) AS e_max_y"
_OWN = "min_x AS e_min_x, min_y AS e_min_y, max_x AS e_max_x, max_y AS e_max_y"


def edges_sql(source: str, s: str) -> str:
    """ed{s}: the edges of a table of strokes in views."""
    dist = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
    return (
        f"raw{s} AS (SELECT {_KEEP}, 'Line' AS edge_kind, 0 AS seq, x0, y0, x1, y1, {_PTS}, {dist} AS length, false AS is_closed FROM (SELECT *, sx AS x0, sy AS y0, ex AS x1, ey AS y1 FROM {source} WHERE kind = 'Line')"
        f" UNION ALL SELECT {_KEEP}, 'PolylineSegment', i - 1, x0, y0, x1, y1, {_PTS}, {dist}, i = len(vx) FROM (SELECT *, vx[i] AS x0, vy[i] AS y0, vx[i % len(vx) + 1] AS x1, vy[i % len(vx) + 1] AS y1 FROM (SELECT *, unnest(range(1, CASE WHEN closed THEN len(vx) + 1 ELSE len(vx) END))::INTEGER AS i FROM {source} WHERE kind = 'Polyline'))"
        f" UNION ALL SELECT {_KEEP}, 'Arc', 0, sx, sy, ex, ey, {_OWN}, {_ARC}, false FROM {source} WHERE kind = 'Arc'"
        f" UNION ALL SELECT {_KEEP}, 'Circle', 0, cx + radius, cy, cx + radius, cy, {_OWN}, 2 * pi() * radius, true FROM {source} WHERE kind = 'Circle'"
        f" UNION ALL SELECT {_KEEP}, 'Ellipse', 0, cx + radius, cy, cx + radius, cy, {_OWN}, {_OVAL}, true FROM {source} WHERE kind = 'Ellipse'),"
        f" ed{s} AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, view_id ORDER BY handle, seq) AS edge FROM raw{s} WHERE edge_kind IN ('Circle', 'Ellipse') OR length >= greatest(0.5, {_SHORT} * 0.005))"
    )


STYLES_SQL = (
    "sg AS (SELECT sheet_id, view_id, color, weight, lt, lay, smooth, loose, count(*) AS entities,"
    " round(sum(CASE kind WHEN 'Line' THEN sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) WHEN 'Polyline' THEN sqrt((vx[-1] - vx[1]) * (vx[-1] - vx[1]) + (vy[-1] - vy[1]) * (vy[-1] - vy[1]))"
    f" WHEN 'Arc' THEN {_ARC} WHEN 'Circle' THEN 2 * pi() * radius ELSE {_OVAL} END), 6) AS length,"
    f" count(*) FILTER (min_x <= v_max_x + {_BAND} AND max_x >= v_min_x - {_BAND} AND min_y <= v_max_y + {_BAND} AND max_y >= v_min_y - {_BAND}) AS touching, count(*) FILTER (contour) AS contour_like FROM st GROUP BY ALL),"
    " sc AS (SELECT *, round(length * 3 + touching * 600 + contour_like * 400 + CASE WHEN smooth THEN 500 ELSE 0 END, 6) AS score FROM sg),"
    " sa AS (SELECT *, score >= max(score) OVER v * 0.55 AND (entities >= 3 OR contour_like > 0) AS able, row_number() OVER (PARTITION BY sheet_id, view_id ORDER BY score DESC, color NULLS FIRST, weight, lt, lay) AS nr FROM sc WINDOW v AS (PARTITION BY sheet_id, view_id)),"
    " sl AS (SELECT * EXCLUDE (able, nr), able OR (nr = 1 AND NOT max(able) OVER (PARTITION BY sheet_id, view_id)) AS selected FROM sa),"
    " pf AS (SELECT * FROM st WHERE EXISTS (SELECT 1 FROM sl WHERE selected AND sl.sheet_id = st.sheet_id AND sl.view_id = st.view_id AND sl.color IS NOT DISTINCT FROM st.color AND sl.weight IS NOT DISTINCT FROM st.weight AND sl.loose = st.loose))"
)


def seeds_sql(s: str) -> str:
    close = lambda off: f"greatest(0.0, 100 - abs({off}))"
    sides = (
        (0, "Top", "v_max_y - e_max_y", f"e_max_y >= v_max_y - {_BAND} AND e_min_y <= v_max_y AND e_min_x <= v_max_x AND e_max_x >= v_min_x"),
        (1, "Bottom", "e_min_y - v_min_y", f"e_min_y <= v_min_y + {_BAND} AND e_max_y >= v_min_y AND e_min_x <= v_max_x AND e_max_x >= v_min_x"),
        (2, "Left", "e_min_x - v_min_x", f"e_min_x <= v_min_x + {_BAND} AND e_max_x >= v_min_x AND e_min_y <= v_max_y AND e_max_y >= v_min_y"),
        (3, "Right", "v_max_x - e_max_x", f"e_max_x >= v_max_x - {_BAND} AND e_min_x <= v_max_x AND e_min_y <= v_max_y AND e_max_y >= v_min_y"),
    )
    parts = " UNION ALL ".join(
        f"SELECT sheet_id, view_id, edge, handle, seq, {i} AS rank, '{n}' AS side, round(length + CASE WHEN smooth THEN 1000 ELSE 0 END + CASE WHEN contour THEN 400 ELSE 0 END + {close(off)}, 6) AS score FROM ed{s} WHERE {test}"
        for i, n, off, test in sides
    )
    return f"sd{s} AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, view_id ORDER BY score DESC, edge, rank)::INTEGER AS place FROM ({parts}))"


def links_sql(s: str) -> str:
    ends = (
        f"en{s} AS (SELECT sheet_id, view_id, edge, color, weight, lt, lay, loose, {_TOL} AS tol, 1 AS nd, x0 AS x, y0 AS y, x1 - x0 AS dx, y1 - y0 AS dy FROM ed{s}"
        f" UNION ALL SELECT sheet_id, view_id, edge, color, weight, lt, lay, loose, {_TOL}, 0, x1, y1, x0 - x1, y0 - y1 FROM ed{s})"
    )
    exact = "a.color IS NOT DISTINCT FROM b.color AND a.weight IS NOT DISTINCT FROM b.weight AND a.lt = b.lt AND a.lay = b.lay"
    loose = "a.color IS NOT DISTINCT FROM b.color AND a.weight IS NOT DISTINCT FROM b.weight AND a.loose = b.loose"
    size = lambda t: f"sqrt({t}.dx * {t}.dx + {t}.dy * {t}.dy)"
    pairs = (
        f"pr{s} AS (SELECT a.sheet_id, a.view_id, a.edge, b.edge AS next, a.nd AS a_nd, b.nd AS b_nd, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance,"
        f" CASE WHEN {size('a')} <= 1e-9 OR {size('b')} <= 1e-9 THEN 0.0 ELSE (greatest(-1.0, least(1.0, -(a.dx * b.dx + a.dy * b.dy) / ({size('a')} * {size('b')}))) + 1) * 0.5 END AS direction,"
        f" {exact} AS exact, {loose} AS loose FROM en{s} a JOIN en{s} b ON a.sheet_id = b.sheet_id AND a.view_id = b.view_id AND a.edge <> b.edge AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= a.tol)"
    )
    return (
        f"{ends}, {pairs}, ps{s} AS (SELECT *, round(greatest(0.0, 100 - distance * 10) + direction * 50 + CASE WHEN exact THEN 80 WHEN loose THEN 40 ELSE 0 END, 6) AS score FROM pr{s}),"
        f" po{s} AS (SELECT * FROM ps{s} QUALIFY row_number() OVER (PARTITION BY sheet_id, view_id, edge, next ORDER BY score DESC, a_nd, b_nd DESC) = 1),"
        f" lk{s} AS (SELECT * EXCLUDE (a_nd, b_nd), row_number() OVER (PARTITION BY sheet_id, view_id, edge ORDER BY score DESC, round(distance, 6), next)::INTEGER AS place FROM po{s} QUALIFY place <= 8)"
    )


def loops_sql(s: str) -> str:
    p = lambda i: f"pts[{i}]"
    meets = " OR ".join(
        f"sqrt(pow({p(1)}.{a} - {p(-1)}.{b}, 2) + pow({p(1)}.{a.replace('x', 'y')} - {p(-1)}.{b.replace('x', 'y')}, 2)) <= {_TOL}" for a in ("x0", "x1") for b in ("x0", "x1")
    )
    offs = ["abs(min_x - v_min_x)", "abs(max_x - v_max_x)", "abs(min_y - v_min_y)", "abs(max_y - v_max_y)"]
    touch = " + ".join(f"CASE WHEN {o} <= {_TOL} * 2 THEN 1 ELSE 0 END" for o in offs)
    around, area_v = "greatest(1.0, v_max_x - v_min_x + v_max_y - v_min_y)", "((v_max_x - v_min_x) * (v_max_y - v_min_y))"
    key = "sheet_id, view_id, place, side"
    return (
        f"fw{s} AS (SELECT sheet_id, view_id, edge, list(next ORDER BY place) AS following FROM lk{s} GROUP BY ALL),"
        f" wk{s} AS (SELECT {key}, [edge] AS path, edge AS here FROM sd{s} UNION ALL SELECT {key}, list_append(path, step), step FROM"
        f" (SELECT w.*, list_filter(following, lambda q: NOT list_contains(path, q))[1] AS step FROM wk{s} w JOIN fw{s} f ON w.sheet_id = f.sheet_id AND w.view_id = f.view_id AND w.here = f.edge WHERE len(path) < 256) WHERE step IS NOT NULL),"
        f" wl{s} AS (SELECT * FROM wk{s} QUALIFY row_number() OVER (PARTITION BY sheet_id, view_id, place ORDER BY len(path) DESC) = 1),"
        f" wd{s} AS (SELECT * FROM wl{s} QUALIFY row_number() OVER (PARTITION BY sheet_id, view_id, list_sort(path) ORDER BY place) = 1),"
        f" we{s} AS (SELECT {key}, unnest(path) AS edge, generate_subscripts(path, 1) AS pos FROM wd{s}),"
        f" wx{s} AS (SELECT w.{key.replace(', ', ', w.')}, w.pos, e.* EXCLUDE (sheet_id, view_id) FROM we{s} w JOIN ed{s} e ON w.sheet_id = e.sheet_id AND w.view_id = e.view_id AND w.edge = e.edge),"
        f" sy{s} AS (SELECT {key}, max(k) AS most FROM (SELECT {key}, color, weight, lt, lay, count(*) AS k FROM wx{s} GROUP BY ALL) GROUP BY ALL),"
        f" lp{s} AS (SELECT {key}, count(*) AS n, round(sum(length), 6) AS perimeter, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY pos) AS pts, {', '.join(f'any_value({c}) AS {c}' for c in _V.split(', '))},"
        f" min(e_min_x) AS min_x, min(e_min_y) AS min_y, max(e_max_x) AS max_x, max(e_max_y) AS max_y FROM wx{s} GROUP BY {key}),"
        f" lc{s} AS (SELECT l.*, most, n > 1 AND ({meets}) AS closed, CASE WHEN n >= 3 THEN abs(list_sum(list_transform(range(1, n + 1), lambda i: pts[i].x0 * pts[i % n + 1].y0 - pts[i % n + 1].x0 * pts[i].y0))) * 0.5 ELSE 0.0 END AS area,"
        f" {' + '.join(offs)} AS gap, {touch} AS touching FROM lp{s} l JOIN sy{s} USING ({key})),"
        f" lr{s} AS (SELECT *, area / greatest(1.0, {area_v}) AS area_ratio, greatest(0.0, 1 - gap / {around}) AS coverage, most / n AS style_share FROM lc{s}),"
        f" ls{s} AS (SELECT *, round(CASE WHEN closed THEN 1000000 ELSE 0 END + area_ratio * 400000 + coverage * 220000 + touching * 120000 + style_share * 80000 + perimeter * 1.5 - gap / {around} * 180000, 3) AS outer_score,"
        f" closed AND perimeter >= {_SHORT} * 0.15 AND area >= greatest(1.0, {area_v} * 0.01) AND touching >= 2 AS valid FROM lr{s})"
    )


def best_sql(s: str) -> str:
    return f"bl{s} AS (SELECT * FROM ls{s} WHERE valid QUALIFY row_number() OVER (PARTITION BY sheet_id, view_id ORDER BY round(outer_score, 6) DESC, touching DESC, round(area_ratio, 6) DESC, round(coverage, 6) DESC, round(perimeter, 6) DESC, place) = 1)"


_LOOP = "sheet_id, view_id, place, side, n, perimeter, area, closed, area_ratio, coverage, touching, style_share, gap, outer_score, valid, min_x, min_y, max_x, max_y"


@entry("contour_edges", f"{STROKES_IN_VIEWS_SQL}, {edges_sql('st', '')} SELECT sheet_id, view_id, edge, handle, seq, edge_kind, x0, y0, x1, y1, length, is_closed, e_min_x, e_min_y, e_max_x, e_max_y FROM ed")
def contour_edges(d):
    e = T.contour_edges(T.view_strokes(d, ring_views(d)))
    return e.select("sheet_id", "view_id", "edge", "handle", "seq", "edge_kind", "x0", "y0", "x1", "y1", "length", "is_closed", "e_min_x", "e_min_y", "e_max_x", "e_max_y")


@entry("contour_styles", f"{STROKES_IN_VIEWS_SQL}, {STYLES_SQL} SELECT sheet_id, view_id, color, weight, lt, lay, entities, length, touching, contour_like, score, selected FROM sl")
def contour_styles(d):
    return T.style_groups(T.view_strokes(d, ring_views(d))).drop("smooth", "loose")


@entry("contour_preferred", f"{STROKES_IN_VIEWS_SQL}, {STYLES_SQL} SELECT sheet_id, view_id, handle FROM pf")
def contour_preferred(d):
    s = T.view_strokes(d, ring_views(d))
    return T.preferred(s, T.style_groups(s)).select("sheet_id", "view_id", "handle")


@entry("contour_seeds", f"{STROKES_IN_VIEWS_SQL}, {edges_sql('st', '')}, {seeds_sql('')} SELECT * EXCLUDE (rank) FROM sd")
def contour_seeds(d):
    return T.contour_seeds(T.contour_edges(T.view_strokes(d, ring_views(d))))


@entry("contour_links", f"{STROKES_IN_VIEWS_SQL}, {edges_sql('st', '')}, {links_sql('')} SELECT * FROM lk")
def contour_links(d):
    return T.contour_links(T.contour_edges(T.view_strokes(d, ring_views(d))))


@entry("contour_loops", f"{STROKES_IN_VIEWS_SQL}, {STYLES_SQL}, {edges_sql('pf', '')}, {seeds_sql('')}, {links_sql('')}, {loops_sql('')} SELECT {_LOOP} FROM ls")
def contour_loops(d):
    s = T.view_strokes(d, ring_views(d))
    return T.traced(T.preferred(s, T.style_groups(s)))[1]


@entry(
    "outer_contours",
    f"{STROKES_IN_VIEWS_SQL}, {STYLES_SQL}, {edges_sql('pf', '')}, {seeds_sql('')}, {links_sql('')}, {loops_sql('')}, {best_sql('')},"
    " rs AS (SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.sheet_id = st.sheet_id AND bl.view_id = st.view_id)),"
    f" {edges_sql('rs', '2')}, {seeds_sql('2')}, {links_sql('2')}, {loops_sql('2')}, {best_sql('2')}"
    f" SELECT {_LOOP}, false AS again FROM bl UNION ALL SELECT {_LOOP}, true FROM bl2",
)
def outer_contours(d):
    return T.outer_contours(d, ring_views(d))


_BY = lambda length, degrees: f"greatest(ceil(round({length} / 2.0, 9)), ceil(round({degrees} / 8.0, 9)))"
_TURN = "(((end_deg - start_deg) % 360 + 360) % 360)"
_PT = lambda deg: f"{{'x': cx + radius * cos(radians({deg})), 'y': cy + radius * sin(radians({deg}))}}"
_OUT = (
    f"ol AS (SELECT * FROM d WHERE kind IN {K.GEOMETRY_KINDS} AND NOT {_mentions(_LAY, K.STROKE_CENTER)} AND NOT {_mentions(_LAY, K.STROKE_HIDDEN)} AND NOT {_mentions(_LAY, K.STROKE_NOTE)})"
)
_OVAL_PT = (
    "{'x': cx + radius * cos(radians(i * 360.0 / m)) * cos(radians(rotation)) - radius * ratio * sin(radians(i * 360.0 / m)) * sin(radians(rotation)),"
    " 'y': cy + radius * cos(radians(i * 360.0 / m)) * sin(radians(rotation)) + radius * ratio * sin(radians(i * 360.0 / m)) * cos(radians(rotation))}"
)
SEGMENTS_SQL = (
    f"{_OUT}, cn AS (SELECT *, CASE kind WHEN 'Circle' THEN greatest(12, {_BY('2 * pi() * radius', '360.0')}) WHEN 'Arc' THEN greatest(2, {_BY(f'radius * radians({_TURN})', _TURN)}) WHEN 'Ellipse' THEN greatest(16, {_BY(_OVAL, '360.0')}) END AS m FROM ol),"
    " pt AS (SELECT sheet_id, handle, kind, CASE kind WHEN 'Line' THEN [{'x': sx, 'y': sy}, {'x': ex, 'y': ey}]"
    f" WHEN 'Circle' THEN list_transform(range(0, m::BIGINT + 1), lambda j: {_PT('(j % m) * 360.0 / m')}) WHEN 'Arc' THEN list_transform(range(0, m::BIGINT + 1), lambda j: {_PT(f'start_deg + {_TURN} * j / m')})"
    f" WHEN 'Ellipse' THEN list_transform(list_transform(range(0, m::BIGINT + 1), lambda j: j % m), lambda i: {_OVAL_PT})"
    " ELSE list_transform(range(1, CASE WHEN closed THEN len(vx) + 2 ELSE len(vx) + 1 END), lambda j: {'x': vx[(j - 1) % len(vx) + 1], 'y': vy[(j - 1) % len(vx) + 1]}) END AS p FROM cn),"
    " ss AS (SELECT sheet_id, handle, kind, i - 1 AS seq, p[i].x AS x0, p[i].y AS y0, p[i + 1].x AS x1, p[i + 1].y AS y1 FROM (SELECT *, unnest(range(1, len(p)))::INTEGER AS i FROM pt))"
)


@entry("chain_segments", f"{SEGMENTS_SQL} SELECT sheet_id, handle, kind, seq, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('x0', 'y0', 'x1', 'y1'))} FROM ss WHERE (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 1e-12")
def chain_segments(d):
    s = T.chain_segments(T.outline_strokes(d))
    return s.select("sheet_id", "handle", "kind", "seq", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])


@entry("closed_chains", None)
def closed_chains(d):
    """Walks in order have no SQL; tests compare them with plain loops."""
    return T.closed_chains(T.chain_segments(T.outline_strokes(d))).drop("vx", "vy")


@entry("chain_holes", None)
def chain_holes(d):
    """Built on closed_chains."""
    return T.chain_holes(T.closed_chains(T.chain_segments(T.outline_strokes(d))))


_AT = "sqrt(pow(col * 12.0 + p.u * 3.0 - cx, 2) + pow(row * 12.0 + p.v * 3.0 - cy, 2))"
_WAY = "((atan2(row * 12.0 + p.v * 3.0 - cy, col * 12.0 + p.u * 3.0 - cx) - s) % (2 * pi()) + 2 * pi()) % (2 * pi())"
_HELD = lambda a: f"(cx + radius * cos({a}) BETWEEN col * 12.0 - 1e-9 AND col * 12.0 + 12.0 + 1e-9 AND cy + radius * sin({a}) BETWEEN row * 12.0 - 1e-9 AND row * 12.0 + 12.0 + 1e-9)"


@entry("arc_cells", f"""ac AS (SELECT sheet_id, handle, cx, cy, radius, radians(start_deg) AS s, CASE WHEN (end_deg - start_deg + 360) % 360 = 0 THEN 2 * pi() ELSE radians((end_deg - start_deg + 360) % 360) END AS turn FROM d WHERE kind = 'Arc'),
 cc AS (SELECT *, unnest(range(CAST(floor((cx - radius) / 12) AS BIGINT) - 1, CAST(floor((cx + radius) / 12) AS BIGINT) + 2)) AS col FROM ac), cr AS (SELECT *, unnest(range(CAST(floor((cy - radius) / 12) AS BIGINT) - 1, CAST(floor((cy + radius) / 12) AS BIGINT) + 2)) AS row FROM cc),
 tp AS (SELECT u, v FROM range(5) a(u), range(5) b(v) WHERE u IN (0, 4) OR v IN (0, 4) OR (u = 2 AND v = 2))
 SELECT sheet_id, handle, col, row FROM cr WHERE {_HELD('s')} OR {_HELD('s + turn')} OR EXISTS (SELECT 1 FROM tp p WHERE abs({_AT} - radius) <= 4.2 AND round({_WAY}, 9) <= round(turn, 9))""")
def arc_cells(d):
    return G.arc_cells(d.filter("kind = 'Arc'"), 12.0).select("sheet_id", "handle", "col", "row")


def drawn_views(d):
    """Parts as views, with made-up evidence by sheet and ring; the frame of the sheet is none."""
    c = F.col
    v = box_of(d.filter("ring BETWEEN 1 AND 10 AND kind <> 'Text'"), "sheet_id", c("ring").cast("bigint").alias("view_id"))
    n = c("sheet_id") * 7 + c("view_id")
    roles = F.when(n % 9 == 0, "SparseBridge").when(n % 9 == 1, "BadgeMarker").when(n % 9 == 2, "Unknown").when(n % 9 == 4, "AnnotationLike").when(n % 9 == 5, None).otherwise("GeometryView")
    return v.select(
        "sheet_id", "view_id", "min_x", "min_y", (c("max_x") - c("sheet_id") * c("view_id") % 4 * 15.0).alias("max_x"), (c("max_y") - c("sheet_id") * c("view_id") % 3 * 20.0).alias("max_y"),
        roles.alias("initial_role"), ((c("sheet_id") * 3 + c("view_id") * 5) % 4).alias("dimensions"), c("n").alias("geometry"), ((c("sheet_id") + c("view_id")) % 3 == 0).alias("has_center"),
        ((c("sheet_id") + c("view_id") * 2) % 5 == 1).alias("has_hidden"), (n % 13 == 3).alias("is_bridge"),
    )


@entry("resolved_views", None)
def resolved_views(d):
    """A chain of choices that build on each other; tests compare it with plain loops."""
    return VS.resolved_views(drawn_views(d))
