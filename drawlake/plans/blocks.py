"""Queries of block instances: nested inserts from nations, leaves from suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.operators import blocks as K

ENTRIES: dict = {}

_NUMBERS = {
    "x": "CAST({k} * 10 AS DOUBLE)", "y": "CAST({k} * 5 - 20 AS DOUBLE)", "degrees": "CAST({k} % 4 * 30 AS DOUBLE)",
    "sx": "CASE WHEN {k} % 3 = 0 THEN 2.0 ELSE 1.0 END", "sy": "CASE WHEN {k} % 5 = 0 THEN -1.0 ELSE 1.0 END",
}


def _numbers(key: str) -> str:
    return ", ".join(f"{v.format(k=key)} AS {n}" for n, v in _NUMBERS.items())


#: Block n holds the blocks 2 n + 1 and 2 n + 2 and block 24 holds block 0 again; each region is a sheet with one insert.
INSERTS = f"SELECT CAST(n_nationkey div 2 AS BIGINT) AS parent, CAST(n_nationkey + 1 AS BIGINT) AS child, CAST(n_nationkey AS BIGINT) AS handle, {_numbers('n_nationkey')} FROM {{nation}} WHERE n_nationkey < 24 UNION ALL SELECT 24, 0, 24, {_numbers('7')}"
ROOTS = f"SELECT CAST(r_regionkey AS BIGINT) AS sheet_id, CAST(r_regionkey AS BIGINT) AS child, CAST(100 + r_regionkey AS BIGINT) AS handle, {_numbers('r_regionkey')} FROM {{region}}"
LEAVES = "SELECT CAST(s_nationkey AS BIGINT) AS node, s_suppkey AS handle, CASE s_suppkey % 3 WHEN 0 THEN 'Line' WHEN 1 THEN 'Circle' ELSE 'Text' END AS kind, CAST(s_suppkey % 7 AS DOUBLE) AS min_x, CAST(s_suppkey % 5 AS DOUBLE) AS min_y, CAST(s_suppkey % 7 + 3 AS DOUBLE) AS max_x, CAST(s_suppkey % 5 + 1 + s_suppkey % 4 AS DOUBLE) AS max_y FROM {supplier}"
ATTRIBUTES = "SELECT CAST(n_nationkey AS BIGINT) AS insert, CAST(1000 + n_nationkey AS BIGINT) AS handle, CAST(n_nationkey AS DOUBLE) AS min_x, 0.0 AS min_y, CAST(n_nationkey + 2 AS DOUBLE) AS max_x, 1.0 AS max_y FROM {nation} WHERE n_nationkey % 2 = 0"


def instances_and_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "region", "supplier")}
    matrix = lambda rows, *keep: rows.select(*keep, *K.insert_matrix(*[F.col(c) for c in ("x", "y", "degrees", "sx", "sy")]))
    inserts, roots = matrix(spark.sql(INSERTS, nation=t["nation"]), "parent", "child", "handle"), matrix(spark.sql(ROOTS, region=t["region"]), "sheet_id", "child", "handle")
    leaves, attributes = spark.sql(LEAVES, supplier=t["supplier"]), spark.sql(ATTRIBUTES.replace("AS insert", "AS `insert`"), nation=t["nation"])
    return K.expand_inserts(roots, inserts), leaves, attributes


def _duck(sql: str) -> str:
    for n in ("nation", "region", "supplier"):
        sql = sql.replace("{" + n + "}", n)
    return sql.replace(" div ", " // ").replace("AS insert", 'AS "insert"')


_M = "cos(radians(degrees)) * sx AS a, -sin(radians(degrees)) * sy AS b, sin(radians(degrees)) * sx AS c, cos(radians(degrees)) * sy AS d, x AS tx, y AS ty"
_CORNERS = lambda e: ", ".join(e.format(x=x, y=y) for x in ("l.min_x", "l.max_x") for y in ("l.min_y", "l.max_y"))
_MX, _MY = "m.a * {x} + m.b * {y} + m.tx", "m.c * {x} + m.d * {y} + m.ty"
_WORLD = f"least({_CORNERS(_MX)}) AS min_x, least({_CORNERS(_MY)}) AS min_y, greatest({_CORNERS(_MX)}) AS max_x, greatest({_CORNERS(_MY)}) AS max_y"
WORLD_SQL = f"""WITH RECURSIVE ins AS (SELECT parent, child, handle, {_M} FROM ({_duck(INSERTS)})), roots AS (SELECT sheet_id, child, handle, {_M} FROM ({_duck(ROOTS)})), leaves AS ({_duck(LEAVES)}), marks AS ({_duck(ATTRIBUTES)}),
 inst(sheet_id, node, handle, path, handles, depth, a, b, c, d, tx, ty) AS (SELECT sheet_id, child, handle, [child], [handle], 0, a, b, c, d, tx, ty FROM roots UNION ALL
  SELECT i.sheet_id, s.child, s.handle, list_append(i.path, s.child), list_append(i.handles, s.handle), i.depth + 1, i.a * s.a + i.b * s.c, i.a * s.b + i.b * s.d, i.c * s.a + i.d * s.c, i.c * s.b + i.d * s.d, i.a * s.tx + i.b * s.ty + i.tx, i.c * s.tx + i.d * s.ty + i.ty
  FROM inst i JOIN ins s ON s.parent = i.node WHERE NOT list_contains(i.path, s.child)),
 lw AS (SELECT m.sheet_id, 'Leaf' AS source, l.kind, l.handle, m.path, m.handles, m.depth + 1 AS depth, {_WORLD} FROM inst m JOIN leaves l ON l.node = m.node),
 up AS (SELECT i.sheet_id, i.handle, i.path, i.handles, i.depth, coalesce(o.a, 1) AS a, coalesce(o.b, 0) AS b, coalesce(o.c, 0) AS c, coalesce(o.d, 1) AS d, coalesce(o.tx, 0) AS tx, coalesce(o.ty, 0) AS ty FROM inst i LEFT JOIN inst o ON o.sheet_id = i.sheet_id AND o.handles = i.handles[1:len(i.handles) - 1]),
 aw AS (SELECT m.sheet_id, 'Attribute' AS source, 'InsertAttribute' AS kind, l.handle, m.path, m.handles, m.depth + 1 AS depth, {_WORLD} FROM up m JOIN marks l ON l."insert" = m.handle),
 cw AS (SELECT i.sheet_id, 'Container' AS source, 'BlockReference' AS kind, i.handle, i.path, i.handles, i.depth, min(lw.min_x) AS min_x, min(lw.min_y) AS min_y, max(lw.max_x) AS max_x, max(lw.max_y) AS max_y
  FROM inst i LEFT JOIN lw ON lw.sheet_id = i.sheet_id AND lw.handles[1:len(i.handles)] = i.handles GROUP BY i.sheet_id, i.handle, i.path, i.handles, i.depth),
 world AS (SELECT * FROM cw UNION ALL SELECT * FROM aw UNION ALL SELECT * FROM lw)"""


def block_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, attributes and leaves of all instances in world space."""
    world = K.block_entities(*instances_and_parts(spark, sf_dir))
    return world.select("sheet_id", "source", "kind", "handle", "path", "depth", *[(F.round(c, 6) + 0.0).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


def block_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of every instance to world space."""
    instances, _, _ = instances_and_parts(spark, sf_dir)
    return instances.select("sheet_id", "node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "depth", *[(F.round(n, 6) + 0.0).alias(n) for n in K.MATRIX])


ENTRIES["block_entities"] = block_entities, f"{WORLD_SQL} SELECT sheet_id, source, kind, handle, array_to_string(path, '>') AS path, depth, round(min_x, 6) + 0.0 AS min_x, round(min_y, 6) + 0.0 AS min_y, round(max_x, 6) + 0.0 AS max_x, round(max_y, 6) + 0.0 AS max_y FROM world"
ENTRIES["block_maps"] = block_maps, f"{WORLD_SQL} SELECT sheet_id, node, array_to_string(path, '>') AS path, depth, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in K.MATRIX)} FROM inst"


#: Leaves with parameters of their own, in the space of their block.
PRIMITIVES = (
    "SELECT CAST(s_nationkey AS BIGINT) AS node, s_suppkey AS handle, kind, CASE WHEN kind = 'Text' THEN 'A7' END AS text,"
    " CASE WHEN kind = 'Line' THEN u END AS sx, CASE WHEN kind = 'Line' THEN v END AS sy, CASE WHEN kind = 'Line' THEN u + 3 END AS ex, CASE WHEN kind = 'Line' THEN v + 4 END AS ey,"
    " CASE WHEN kind <> 'Line' THEN u END AS cx, CASE WHEN kind <> 'Line' THEN v END AS cy, CASE WHEN kind IN ('Circle', 'Arc', 'Ellipse') THEN 2.0 + s_suppkey % 3 END AS radius,"
    " CASE WHEN kind = 'Ellipse' THEN 0.5 END AS ratio, CASE WHEN kind IN ('Ellipse', 'Text') THEN s_suppkey % 11 * 15.0 END AS rotation,"
    " CASE WHEN kind = 'Arc' THEN s_suppkey % 7 * 50.0 END AS start_deg, CASE WHEN kind = 'Arc' THEN s_suppkey % 5 * 70.0 + 20.0 END AS end_deg, CASE WHEN kind = 'Text' THEN 2.5 END AS height"
    " FROM (SELECT *, CASE s_suppkey % 5 WHEN 0 THEN 'Line' WHEN 1 THEN 'Circle' WHEN 2 THEN 'Arc' WHEN 3 THEN 'Ellipse' ELSE 'Text' END AS kind, CAST(s_suppkey % 7 AS DOUBLE) AS u, CAST(s_suppkey % 5 AS DOUBLE) AS v FROM {supplier}) s"
)
_PARAMETERS = ("sx", "sy", "ex", "ey", "cx", "cy", "radius", "ratio", "rotation", "start_deg", "end_deg", "height")
_ANGLES = ("rotation", "start_deg", "end_deg")  # rounded by the operator


def _primitives(spark: SparkSession, sf_dir: str, inner_last: bool) -> DataFrame:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "region", "supplier")}
    matrix = lambda rows, *keep: rows.select(*keep, *K.insert_matrix(*[F.col(c) for c in ("x", "y", "degrees", "sx", "sy")]))
    inserts, roots = matrix(spark.sql(INSERTS, nation=t["nation"]), "parent", "child", "handle"), matrix(spark.sql(ROOTS, region=t["region"]), "sheet_id", "child", "handle")
    out = K.mapped_primitives(K.expand_inserts(roots, inserts, inner_last=inner_last), spark.sql(PRIMITIVES, supplier=t["supplier"]))
    return out.select("sheet_id", "kind", "handle", "path", "depth", "text", "mirrored", *[c if c in _ANGLES else (F.round(c, 5) + 0.0).alias(c) for c in _PARAMETERS])


def block_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, circles, arcs, ellipses and texts of all instances with their parameters in world space."""
    return _primitives(spark, sf_dir, False)


def block_primitives_inner_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the maps of inserts are multiplied in the other order."""
    return _primitives(spark, sf_dir, True)


def _primitives_sql(world: str) -> str:
    """Axes from the eigenvalues of the mapped circle's matrix, angles from the mapped ends."""
    wrap = lambda v: f"round((round({v}, 6) % 360 + 360) % 360, 6) + 0.0"
    end = lambda deg: (f"p * cos(radians({deg})) + q * sin(radians({deg}))", f"r * cos(radians({deg})) + s * sin(radians({deg}))")
    def angle(deg: str) -> str:
        vx, vy = end(deg)
        plain = f"degrees(atan2({vy}, {vx}))"
        along = f"degrees(atan2((-sin(radians(ax)) * ({vx}) + cos(radians(ax)) * ({vy})) / short, (cos(radians(ax)) * ({vx}) + sin(radians(ax)) * ({vy})) / long))"
        return f"CASE WHEN even THEN {plain} ELSE {along} END"
    return world + f""", lv AS ({_duck(PRIMITIVES)}),
 j AS (SELECT m.sheet_id, m.path, m.depth + 1 AS depth, m.a, m.b, m.c, m.d, m.tx, m.ty, l.*, CASE WHEN kind = 'Ellipse' THEN radians(rotation) ELSE 0.0 END AS t, radius AS ra, CASE WHEN kind = 'Ellipse' THEN radius * ratio ELSE radius END AS rb, a * d - b * c AS det FROM inst m JOIN lv l ON l.node = m.node),
 g AS (SELECT *, (a * cos(t) + b * sin(t)) * ra AS p, (b * cos(t) - a * sin(t)) * rb AS q, (c * cos(t) + d * sin(t)) * ra AS r, (d * cos(t) - c * sin(t)) * rb AS s FROM j),
 h AS (SELECT *, p * p + q * q AS u11, p * r + q * s AS u12, r * r + s * s AS u22 FROM g),
 k AS (SELECT *, sqrt((u11 + u22 + sqrt((u11 - u22) * (u11 - u22) + 4 * u12 * u12)) / 2) AS long, abs(p * s - q * r) / sqrt((u11 + u22 + sqrt((u11 - u22) * (u11 - u22) + 4 * u12 * u12)) / 2) AS short, (round(degrees(atan2(2 * u12, u11 - u22)) / 2, 7) + 180) % 180 AS ax FROM h),
 o AS (SELECT *, long - short <= 1e-6 * long AS even FROM k)
 SELECT sheet_id, CASE WHEN kind IN ('Circle', 'Arc') AND NOT even THEN 'Ellipse' ELSE kind END AS kind, handle, array_to_string(path, '>') AS path, depth, text, det < 0 AS mirrored,
  round(a * sx + b * sy + tx, 5) + 0.0 AS sx, round(c * sx + d * sy + ty, 5) + 0.0 AS sy, round(a * ex + b * ey + tx, 5) + 0.0 AS ex, round(c * ex + d * ey + ty, 5) + 0.0 AS ey, round(a * cx + b * cy + tx, 5) + 0.0 AS cx, round(c * cx + d * cy + ty, 5) + 0.0 AS cy,
  CASE WHEN kind IN ('Circle', 'Arc', 'Ellipse') THEN round(long, 5) + 0.0 END AS radius, CASE WHEN kind IN ('Circle', 'Arc', 'Ellipse') AND NOT even THEN round(short / long, 5) + 0.0 END AS ratio,
  CASE WHEN kind IN ('Circle', 'Arc', 'Ellipse') AND NOT even THEN {wrap('ax')} WHEN kind = 'Text' THEN {wrap('degrees(atan2(c * cos(radians(rotation)) + d * sin(radians(rotation)), a * cos(radians(rotation)) + b * sin(radians(rotation))))')} END AS rotation,
  CASE WHEN kind = 'Arc' THEN {wrap(f"CASE WHEN det < 0 THEN {angle('end_deg')} ELSE {angle('start_deg')} END")} END AS start_deg, CASE WHEN kind = 'Arc' THEN {wrap(f"CASE WHEN det < 0 THEN {angle('start_deg')} ELSE {angle('end_deg')} END")} END AS end_deg,
  CASE WHEN kind = 'Text' THEN round(height * abs(det) / sqrt(pow(a * cos(radians(rotation)) + b * sin(radians(rotation)), 2) + pow(c * cos(radians(rotation)) + d * sin(radians(rotation)), 2)), 5) + 0.0 END AS height FROM o"""


_OUTER_LAST = "i.a * s.a + i.b * s.c, i.a * s.b + i.b * s.d, i.c * s.a + i.d * s.c, i.c * s.b + i.d * s.d, i.a * s.tx + i.b * s.ty + i.tx, i.c * s.tx + i.d * s.ty + i.ty"
_INNER_LAST = "s.a * i.a + s.b * i.c, s.a * i.b + s.b * i.d, s.c * i.a + s.d * i.c, s.c * i.b + s.d * i.d, s.a * i.tx + s.b * i.ty + s.tx, s.c * i.tx + s.d * i.ty + s.ty"
ENTRIES["block_primitives"] = block_primitives, _primitives_sql(WORLD_SQL)
ENTRIES["block_primitives_inner_last"] = block_primitives_inner_last, _primitives_sql(WORLD_SQL.replace(_OUTER_LAST, _INNER_LAST))
