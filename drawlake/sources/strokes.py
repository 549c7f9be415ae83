"""Strokes of parts whose outlines are drawn edge by edge, with their gaps.

The table is made of `orders`: 96 rows a sheet, in rings of eight. Ring 0 runs round the sheet,
rings 1 to 8 are parts, ring 9 lies in ring 1 and ring 10 in ring 9, ring 11 is single shapes.
Ends miss each other by little, by 0.75 or by 3; some edges are missing, some are arcs or
polylines, and rings differ in layer, line type, colour and weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _case(value: str, choices: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)) + " END"


_FX, _FY = ["0.0", "0.5", "1.0", "1.0", "1.0", "0.5", "0.0", "0.0"], ["0.0", "0.0", "0.0", "0.5", "1.0", "1.0", "1.0", "0.5"]
_SHAPES = ["'Text'", "'Dimension'", "'Polyline'", "'Circle'", "'Ellipse'", "'Spline'", "'Hatch'", "'BlockReference'"]
_RINGS = (
    "SELECT o_orderkey div 96 AS sheet_id, o_orderkey AS handle, (o_orderkey div 8) % 12 AS ring, o_orderkey % 8 AS place, o_orderkey % 53 = 0 AS gone,"
    " CASE WHEN o_orderkey % 29 = 0 THEN 3.0 WHEN o_orderkey % 11 = 0 THEN 0.75 ELSE (o_orderkey * 7 % 3) * 0.125 END AS miss, (o_orderkey div 96) % 3 AS wide, (o_orderkey div 96) % 2 AS tall FROM orders"
)
_BOXES = (
    "SELECT *, CAST(CASE ring WHEN 0 THEN 20 WHEN 9 THEN 80 WHEN 10 THEN 100 WHEN 11 THEN 40 + place * 90 ELSE 60 + (ring - 1) % 4 * 190 END AS DOUBLE) AS x0,"
    " CAST(CASE ring WHEN 0 THEN 20 WHEN 9 THEN 80 WHEN 10 THEN 100 WHEN 11 THEN 530 ELSE 60 + (ring - 1) div 4 * 250 END AS DOUBLE) AS y0,"
    " CAST(CASE ring WHEN 0 THEN 800 WHEN 9 THEN 70 WHEN 10 THEN 30 WHEN 11 THEN 40 ELSE 120 + wide * 10 END AS DOUBLE) AS w,"
    " CAST(CASE ring WHEN 0 THEN 554 WHEN 9 THEN 120 WHEN 10 THEN 60 WHEN 11 THEN 20 ELSE 160 + tall * 20 END AS DOUBLE) AS h,"
    f" CASE WHEN ring = 11 THEN {_case('place', _SHAPES)} WHEN gone THEN 'Text' WHEN ring IN (3, 7) AND place % 2 = 1 THEN 'Arc' WHEN ring IN (2, 6) AND place % 4 = 0 THEN 'Polyline' ELSE 'Line' END AS kind FROM ({_RINGS}) a"
)
_ENDS = (
    f"SELECT *, x0 + w * {_case('place', _FX)} AS sx, y0 + h * {_case('place', _FY)} AS sy, x0 + w * {_case('(place + 1) % 8', _FX)} + CASE WHEN kind = 'Arc' THEN 0.0 ELSE miss END AS ex,"
    f" y0 + h * {_case('(place + 1) % 8', _FY)} AS ey FROM ({_BOXES}) b"
)
_EDGE = "ring < 11 AND kind IN ('Line', 'Polyline', 'Arc')"
_R = "greatest(abs(ex - sx), abs(ey - sy)) * 0.5"
_DRAWN = (
    "sheet_id, ring, handle, kind,"
    " CASE WHEN ring = 4 THEN 'TITLE' WHEN ring % 4 = 0 THEN 'OUTLINE' WHEN ring % 4 = 1 THEN '0' WHEN ring % 4 = 2 THEN ' outer part' ELSE 'PART' END AS layer,"
    " CASE WHEN ring = 5 THEN 'HIDDEN2' WHEN ring % 3 = 0 THEN 'Continuous' WHEN ring % 3 = 1 THEN NULL WHEN ring = 2 THEN 'DASHED' ELSE 'ByLayer' END AS linetype,"
    " CAST(CASE WHEN handle % 17 = 0 THEN 9 WHEN (handle div 8) % 7 = 0 THEN NULL ELSE ring % 3 END AS INT) AS color, CASE WHEN ring = 0 THEN 50 ELSE 25 END AS weight,"
    f" CASE WHEN {_EDGE} AND kind <> 'Polyline' THEN sx END AS sx, CASE WHEN {_EDGE} AND kind <> 'Polyline' THEN sy END AS sy,"
    f" CASE WHEN {_EDGE} AND kind <> 'Polyline' THEN ex END AS ex, CASE WHEN {_EDGE} AND kind <> 'Polyline' THEN ey END AS ey,"
    " CASE WHEN kind = 'Polyline' AND ring < 11 THEN array(sx, (sx + ex) * 0.5, ex) WHEN kind = 'Polyline' THEN array(x0, x0 + w, x0 + w, x0) WHEN kind = 'Spline' THEN array(x0, x0 + 10, x0 + 25, x0 + 40) END AS vx,"
    " CASE WHEN kind = 'Polyline' AND ring < 11 THEN array(sy, (sy + ey) * 0.5, ey) WHEN kind = 'Polyline' THEN array(y0, y0, y0 + h, y0 + h) WHEN kind = 'Spline' THEN array(y0, y0 + 20, y0, y0 + 20) END AS vy,"
    " kind = 'Polyline' AND ring = 11 AS closed,"
    " CASE WHEN kind = 'Arc' THEN (sx + ex) * 0.5 WHEN kind IN ('Circle', 'Ellipse') THEN x0 + w * 0.5 END AS cx, CASE WHEN kind = 'Arc' THEN (sy + ey) * 0.5 WHEN kind IN ('Circle', 'Ellipse') THEN y0 + h * 0.5 END AS cy,"
    f" CASE WHEN kind = 'Arc' THEN {_R} WHEN kind = 'Circle' THEN 10.0 WHEN kind = 'Ellipse' THEN 20.0 END AS radius, CASE WHEN kind = 'Ellipse' THEN 0.5 END AS ratio, CASE WHEN kind = 'Ellipse' THEN 30.0 END AS rotation,"
    " CASE WHEN kind = 'Arc' THEN (place div 2 * 90 + 180) % 360 * 1.0 END AS start_deg, CASE WHEN kind = 'Arc' THEN (place div 2 * 90) % 360 * 1.0 END AS end_deg"
)
_BOX = (
    f"CASE WHEN handle % 97 = 0 THEN NULL WHEN kind = 'Arc' THEN (sx + ex) * 0.5 - {_R} WHEN {_EDGE} THEN least(sx, ex) ELSE x0 END AS min_x,"
    f" CASE WHEN handle % 97 = 0 THEN NULL WHEN kind = 'Arc' THEN (sy + ey) * 0.5 - {_R} WHEN {_EDGE} THEN least(sy, ey) ELSE y0 END AS min_y,"
    f" CASE WHEN handle % 97 = 0 THEN NULL WHEN kind = 'Arc' THEN (sx + ex) * 0.5 + {_R} WHEN {_EDGE} THEN greatest(sx, ex) ELSE x0 + w END AS max_x,"
    f" CASE WHEN handle % 97 = 0 THEN NULL WHEN kind = 'Arc' THEN (sy + ey) * 0.5 + {_R} WHEN {_EDGE} THEN greatest(sy, ey) ELSE y0 + h END AS max_y"
)
STROKES = f"SELECT {_DRAWN}, {_BOX} FROM ({_ENDS}) c"
#: The table d of the queries' SQL.
STROKES_SQL = f"d AS ({STROKES.replace(' div ', ' // ').replace('array(', 'list_value(')})"


def _apart(d: DataFrame) -> DataFrame:
    """The same rows in the same partitions, but what follows is compiled by itself: the JVM leaves
    generated methods of more than 8000 bytes to its interpreter, and the whole of STROKES is one of 13,000."""
    return d.coalesce(1 << 30)


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet_id, ring, handle, kind, layer, linetype, color, weight, end points of lines and arcs,
    vertices (vx, vy) of polylines and splines, closed, centre, radius, ratio, rotation, angles,
    and the box, which is null for one in 97. STROKES in three steps."""
    ends = spark.sql(_ENDS.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    boxed = spark.sql(f"SELECT *, {_BOX} FROM {{ends}}", ends=_apart(ends))
    return spark.sql(f"SELECT {_DRAWN}, min_x, min_y, max_x, max_y FROM {{boxed}}", boxed=_apart(boxed))
