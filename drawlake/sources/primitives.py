"""Primitives with their own parameters: end points, centres, radii, angles, vertices, styles.

The table is made of `orders`, so that every kind, layer, line type and text form occurs on
many sheets. A box is null where a scan would give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Kinds by o_orderkey % 16.
KINDS = ("Text", "MText", "Dimension", "Leader", "Circle", "Arc", "Polyline", "BlockReference", "Hatch", "Line", "Line", "Ellipse", "Spline", "Solid", "InsertAttribute", "Point")
#: Text forms, by (o_orderkey div 16) % 14; chr(92) is a backslash, chr(39) a quote, 123 and 125 braces.
TEXTS = (
    "concat(chr(123), chr(92), 'Fromans;MATERIAL SS400', chr(125))", "concat('TITLE', chr(92), 'P BLOCK  A')", "'%%C25'", "'%%UNOTE%%U  2'", "'4 EA'", "'x12'",
    "concat('Q', chr(39), 'TY')", "'A7'", "'SCALE 1:2'", "'-12.5'", "'REV.  B'", "'NAJV-101'", "'SUS PL6 X 3'", "concat('MAT', chr(39), 'L')",
)
LAYERS = ("OUTLINE", "hl", "TITLE", "TABLE", "AUX_1", "REF_LINE", "DIM", "CL", "0")
LINETYPES = ("'ByLayer'", "'CENTER2'", "'HIDDEN'", "'Continuous'", "NULL", "'ByBlock'", "'DASHDOT'")


def _case(value: str, choices: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)) + " END"


_KIND = _case("o_orderkey % 16", [f"'{k}'" for k in KINDS])
_X, _Y = "CAST((o_orderkey * 7919) % 841 AS DOUBLE)", "CAST((o_orderkey * 104729) % 594 AS DOUBLE)"
_W, _H = "CAST(o_orderkey % 37 AS DOUBLE)", "CAST(o_orderkey % 23 AS DOUBLE)"
_FAR = "o_orderkey div 16"  # independent of the kind
_BASE = (
    f"SELECT CAST(o_custkey div 10 AS BIGINT) AS sheet_id, o_orderkey AS handle, {_KIND} AS kind, {_case('o_orderkey % 9', [f"'{x}'" for x in LAYERS])} AS layer,"
    f" {_case('o_orderkey % 7', list(LINETYPES))} AS linetype, CASE WHEN o_orderkey % 13 = 0 THEN 30 WHEN o_orderkey % 13 = 1 THEN 0 END AS transparency,"
    f" CASE WHEN o_orderkey % 16 IN (0, 1, 14) THEN {_case(f'({_FAR}) % 14', list(TEXTS))} END AS text,"
    f" CASE WHEN o_orderkey % 5 < 2 THEN NULL WHEN o_orderkey % 2 = 0 THEN concat('ASM', CAST(o_orderkey % 3 AS STRING), '>PART', CAST(({_FAR}) % 4 AS STRING))"
    f" ELSE concat('ASM', CAST(o_orderkey % 3 AS STRING)) END AS block_path,"
    f" {_X} AS x, {_Y} AS y, {_W} AS w, {_H} AS h, o_orderkey % 16 IN (9, 10) AS is_line, o_orderkey % 5 AS turn, ({_FAR}) % 2 AS falls, CAST(({_FAR}) % 4 AS DOUBLE) AS cut,"
    f" CAST(o_orderkey % 360 AS DOUBLE) AS start_deg, CAST((o_orderkey * 7) % 360 AS DOUBLE) AS end_deg, 0.25 * (1 + o_orderkey % 3) AS ratio, o_orderkey % 11 <> 0 AS boxed, o_orderkey % 3 <> 0 AS closed FROM orders"
)
_ENDS = (
    "SELECT *, CASE WHEN NOT is_line THEN NULL WHEN turn = 0 THEN 0 WHEN turn = 1 THEN cut * 280 ELSE x END AS sx, CASE WHEN NOT is_line THEN NULL WHEN turn = 0 THEN cut * 198 WHEN turn = 1 THEN 0 WHEN falls = 1 THEN y + h ELSE y END AS sy,"
    " CASE WHEN NOT is_line THEN NULL WHEN turn = 0 THEN 840 WHEN turn = 1 THEN cut * 280 ELSE x + w END AS ex, CASE WHEN NOT is_line THEN NULL WHEN turn = 0 THEN cut * 198 WHEN turn = 1 THEN 594 WHEN falls = 1 THEN y ELSE y + h END AS ey"
    f" FROM ({_BASE}) b"
)
_ROUND = "kind IN ('Circle', 'Arc', 'Ellipse')"
PRIMITIVES = (
    "SELECT sheet_id, handle, kind, layer, linetype, transparency, text, block_path, x, y, w, h, sx, sy, ex, ey, closed,"
    f" CASE WHEN {_ROUND} THEN x + w * 0.5 END AS cx, CASE WHEN {_ROUND} THEN y + h * 0.5 END AS cy, CASE WHEN {_ROUND} THEN w * 0.5 END AS radius,"
    " CASE WHEN kind = 'Arc' THEN start_deg END AS start_deg, CASE WHEN kind = 'Arc' THEN end_deg END AS end_deg, CASE WHEN kind = 'Ellipse' THEN ratio END AS ratio,"
    " CASE WHEN kind IN ('Text', 'MText', 'InsertAttribute') THEN start_deg END AS rotation,"
    " CASE WHEN boxed THEN CASE WHEN is_line THEN least(sx, ex) ELSE x END END AS min_x, CASE WHEN boxed THEN CASE WHEN is_line THEN least(sy, ey) ELSE y END END AS min_y,"
    " CASE WHEN boxed THEN CASE WHEN is_line THEN greatest(sx, ex) ELSE x + w END END AS max_x, CASE WHEN boxed THEN CASE WHEN is_line THEN greatest(sy, ey) ELSE y + h END END AS max_y"
    f" FROM ({_ENDS}) p"
)
#: The table d of the queries' SQL.
PRIMITIVES_SQL = f"d AS ({PRIMITIVES.replace(' div ', ' // ').replace('AS STRING', 'AS VARCHAR')})"
#: Line types of the layers that have one.
LAYER_LINETYPES = {"OUTLINE": "Continuous", "hl": "HIDDEN2", "CL": "CENTER", "AUX_1": "PHANTOM", "DIM": " "}


def primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet_id, handle, kind, layer, linetype, transparency, text, block_path, the corner and
    size (x, y, w, h) that its parameters come from, end points, closed, centre, radius,
    angles, ratio, rotation, and the box, which is null for one in eleven."""
    return spark.sql(PRIMITIVES.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
