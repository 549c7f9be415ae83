"""Entity tables: from the driver's tables, from JSON trees, from SVG paths and from blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The entity columns in terms of `orders`, for Spark; `div` is integer division.
ENTITY_COLUMNS = [
    "CAST(o_custkey div 10 AS BIGINT) AS sheet_id",
    "o_orderkey AS handle",
    "CASE o_orderkey % 12 WHEN 0 THEN 'Text' WHEN 1 THEN 'MText' WHEN 2 THEN 'Dimension' WHEN 3 THEN 'Leader' WHEN 4 THEN 'Circle'"
    " WHEN 5 THEN 'Arc' WHEN 6 THEN 'Polyline' WHEN 7 THEN 'BlockReference' WHEN 8 THEN 'Hatch' ELSE 'Line' END AS kind",
    "CASE o_orderkey % 7 WHEN 0 THEN 'CENTER' WHEN 1 THEN 'hl' WHEN 2 THEN 'TITLE' ELSE 'OUTLINE' END AS layer",
    "CAST((o_orderkey * 7919) % 841 AS DOUBLE) AS min_x",
    "CAST((o_orderkey * 104729) % 594 AS DOUBLE) AS min_y",
    "CAST((o_orderkey * 7919) % 841 + o_orderkey % 37 AS DOUBLE) AS max_x",
    "CAST((o_orderkey * 104729) % 594 + o_orderkey % 23 AS DOUBLE) AS max_y",
    "CASE WHEN o_orderkey % 12 IN (0, 1) THEN CASE o_orderkey % 5 WHEN 0 THEN concat('QTY: ', CAST(o_orderkey % 20 + 1 AS STRING))"
    " WHEN 1 THEN concat(CAST(o_orderkey % 9 + 1 AS STRING), ' EA') WHEN 2 THEN 'MATERIAL SS400' WHEN 3 THEN 'SCALE 1:2' ELSE o_orderpriority END END AS text",
    "CASE WHEN o_orderkey % 5 < 2 THEN NULL WHEN o_orderkey % 2 = 0 THEN concat('ASM', CAST(o_orderkey % 3 AS STRING), '>PART', CAST(o_orderkey % 4 AS STRING))"
    " ELSE concat('ASM', CAST(o_orderkey % 3 AS STRING)) END AS block_path",
]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet_id, handle, kind, layer, box, text, block_path, anchor (ax, ay), block_name, depth."""
    return with_derived(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*ENTITY_COLUMNS))


def with_derived(e: DataFrame) -> DataFrame:
    return e.select(
        "*",
        ((F.col("min_x") + F.col("max_x")) * 0.5).alias("ax"), ((F.col("min_y") + F.col("max_y")) * 0.5).alias("ay"),
        F.element_at(F.split("block_path", ">"), -1).alias("block_name"),
        F.coalesce(F.size(F.split("block_path", ">")), F.lit(0)).alias("depth"),
    )


#: The same table for DuckDB, as a common table expression named e.
ENTITIES_SQL = (
    "e AS (SELECT *, (min_x + max_x) * 0.5 AS ax, (min_y + max_y) * 0.5 AS ay, string_split(block_path, '>')[-1] AS block_name,"
    " CASE WHEN block_path IS NULL THEN 0 ELSE CAST(len(string_split(block_path, '>')) AS INTEGER) END AS depth FROM (SELECT "
    + ", ".join(ENTITY_COLUMNS).replace(" div ", " // ").replace("AS STRING", "AS VARCHAR")
    + " FROM orders))"
)


def leaf_boxes(trees: DataFrame, levels: int = 8) -> DataFrame:
    """Leaves of nested JSON nodes with children, as boxes. `trees` has tree_id and a struct
    column `node` of box and children; one explode for each level that the schema has, which
    may be `levels` at most."""
    out, level = None, trees.select("tree_id", "node.*")
    for _ in range(levels):
        columns = level.columns
        leaf = level.filter(F.size("children") == 0) if "children" in columns else level
        leaf = leaf.select("tree_id", "id", "min_x", "min_y", "max_x", "max_y").filter("abs(min_x) < 1e12")
        out = leaf if out is None else out.unionByName(leaf)
        if "children" not in columns:
            break
        level = level.select("tree_id", F.explode("children").alias("node")).select("tree_id", "node.*")
    else:
        raise ValueError(f"trees are nested deeper than {levels}")
    return out


def svg_points(lines: DataFrame) -> DataFrame:
    """Distinct coordinate pairs in the lines of SVG text (column value)."""
    pairs = F.regexp_extract_all("value", F.lit(r"(-?\d+(?:\.\d+)?)[ ,]+(-?\d+(?:\.\d+)?)"), F.lit(0))
    parts = F.split("pair", "[ ,]+")
    return lines.select(F.explode(pairs).alias("pair")).select(parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y")).distinct()


def expand_blocks(inserts: DataFrame, roots: DataFrame, most_depth: int = 32) -> DataFrame:
    """Walk block definitions: `inserts` (parent, child, dx, dy), `roots` (node). Returns
    root, node, depth, path, dx, dy with offsets added up along the path. A block that occurs
    on its own path is not entered again."""
    now = roots.select(
        F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")
    )
    out = now
    for depth in range(1, most_depth + 1):
        step = now.join(inserts.select("parent", "child", F.col("dx").alias("_x"), F.col("dy").alias("_y")), F.col("node") == F.col("parent"))
        step = step.filter(~F.array_contains("path", F.col("child")))
        now = step.select(
            "root", F.col("child").alias("node"), F.lit(depth).alias("depth"), F.array_append("path", F.col("child")).alias("path"),
            (F.col("dx") + F.col("_x")).alias("dx"), (F.col("dy") + F.col("_y")).alias("dy"),
        )
        if now.isEmpty():
            return out
        out = out.unionByName(now)
    raise ValueError(f"blocks are nested deeper than {most_depth}")


def svg_centres(lines: DataFrame) -> DataFrame:
    """Box centres of the rect, circle, ellipse and line elements in the lines of SVG text (column
    value): element, x, y. Elements without their numbers are left out."""
    tags = F.regexp_extract_all("value", F.lit(r"<(rect|circle|ellipse|line)\b[^>]*>"), F.lit(0))
    t = lines.select(F.explode(tags).alias("tag")).withColumn("element", F.regexp_extract("tag", r"^<(\w+)", 1))
    number = lambda name: F.expr(f"try_cast(regexp_extract(tag, '[ ]{name}=[\"]?(-?[0-9.]+)', 1) AS DOUBLE)")
    middle = lambda p, size, c, a, b: (
        F.when(F.col("element") == "rect", F.coalesce(number(p), F.lit(0.0)) + number(size) * 0.5)
        .when(F.col("element") == "line", (number(a) + number(b)) * 0.5).otherwise(F.coalesce(number(c), F.lit(0.0)))
    )
    x, y = middle("x", "width", "cx", "x1", "x2"), middle("y", "height", "cy", "y1", "y2")
    return t.select("element", x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
