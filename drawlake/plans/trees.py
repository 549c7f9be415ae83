"""Queries of trees: pre-order, normalised blocks, documents there and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.functions import kinds as K
from drawlake.operators import trees as T
from drawlake.storage import joinable

ENTRIES: dict = {}

#: 96 orders are a tree: every seventh node hangs on the one before it, the others on a third of their number.
NODES = (
    "SELECT o_orderkey div 96 AS tree_id, o_orderkey AS node_id, CASE WHEN o_orderkey % 96 = 0 THEN NULL WHEN o_orderkey % 96 % 7 = 1 THEN o_orderkey - 1 ELSE o_orderkey - o_orderkey % 96 + o_orderkey % 96 div 3 END AS parent_id,"
    " CAST((o_orderkey * 7) % 5 AS INT) AS place, CASE WHEN o_orderkey % 96 < 34 OR o_orderkey % 11 = 0 THEN 'BlockReference' WHEN o_orderkey % 6 = 0 THEN 'Text' WHEN o_orderkey % 6 = 1 THEN 'Dimension' WHEN o_orderkey % 6 = 2 THEN 'Viewport' ELSE 'Line' END AS kind FROM {orders}"
)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joinable(spark.sql(NODES, orders=spark.read.parquet(f"{sf_dir}/orders.parquet")), "trees")


NODES_SQL = f"nd AS ({NODES.replace('{orders}', 'orders').replace(' div ', ' // ')})"
ORDER_SQL = f"""{NODES_SQL}, nth AS (SELECT *, CAST(row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY place, node_id) AS INTEGER) AS nth FROM nd),
 wk AS (SELECT *, 0 AS depth, [nth] AS path FROM nth WHERE parent_id IS NULL UNION ALL SELECT n.*, w.depth + 1, list_append(w.path, n.nth) FROM wk w JOIN nth n ON n.tree_id = w.tree_id AND n.parent_id = w.node_id)"""


def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with depth, path and pre-order number."""
    x = T.numbered(nodes(spark, sf_dir))
    return x.select("tree_id", "node_id", "depth", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "preorder")


def normalised_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised hierarchy of every tree."""
    x = T.normalised(T.numbered(nodes(spark, sf_dir)))
    return x.select("tree_id", "node_id", "node_kind", "reason", "owner", "level")


def tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tree as a JSON document, read back into rows."""
    x = T.numbered(nodes(spark, sf_dir))
    box = [F.lit(float(i)).alias(c) if i else F.col("place").cast("double").alias(c) for i, c in enumerate(("min_x", "min_y", "max_x", "max_y"))]
    rows = x.select("tree_id", "path", "depth", F.col("node_id").cast("string").alias("id"), F.col("kind").alias("type"), F.when(F.col("kind") == "Text", F.lit('a "quoted" text')).alias("content"), F.lit(None).cast("string").alias("layer"), *box)
    back = T.flattened(T.nested(rows))
    return back.select("tree_id", "id", "type", "content", "depth", "min_x", "max_y")


_KINDS = f"CASE WHEN kind = 'BlockReference' THEN NULL WHEN kind IN {K.TEXT_KINDS} THEN 'TextLeaf' WHEN kind IN {K.DIMENSION_KINDS} THEN 'DimensionLeaf' WHEN kind IN {K.GEOMETRY_KINDS} THEN 'GeometryLeaf' ELSE 'UnknownLeaf' END"
NORMAL_SQL = f"""{ORDER_SQL}, lf AS (SELECT *, {_KINDS} AS leaf FROM wk),
 ct AS (SELECT tree_id, parent_id AS node_id, count(*) AS n, count(*) FILTER (leaf IS NULL) AS b, count(*) FILTER (leaf = 'GeometryLeaf') AS g, count(*) FILTER (leaf IN ('TextLeaf', 'DimensionLeaf')) AS t, count(leaf) AS l FROM lf WHERE parent_id IS NOT NULL GROUP BY ALL),
 jd AS (SELECT lf.*, CASE WHEN leaf IS NOT NULL THEN NULL WHEN coalesce(n, 0) = 0 THEN 'empty block' WHEN n = 1 AND b = 1 THEN 'single child wrapper' WHEN n <= 2 AND g = 0 AND t <= 1 THEN 'near empty wrapper' WHEN g >= 3 THEN 'enough geometry leaves' WHEN l >= 5 THEN 'enough total leaves' WHEN g > 0 AND t > 0 THEN 'mixed geometry and annotation' ELSE 'neutral' END AS reason FROM lf LEFT JOIN ct USING (tree_id, node_id)),
 kd AS (SELECT *, CASE WHEN leaf IS NOT NULL THEN leaf WHEN reason IN ('single child wrapper', 'near empty wrapper') THEN 'CollapsedWrapper' ELSE 'PreservedBlock' END AS node_kind FROM jd),
 ow AS (SELECT tree_id, node_id, node_kind, reason, CAST(NULL AS BIGINT) AS owner, 0 AS level FROM kd WHERE parent_id IS NULL UNION ALL
  SELECT k.tree_id, k.node_id, k.node_kind, k.reason, CASE WHEN o.node_kind = 'PreservedBlock' THEN o.node_id ELSE o.owner END, o.level + CASE WHEN o.node_kind = 'PreservedBlock' THEN 1 ELSE 0 END FROM ow o JOIN kd k ON k.tree_id = o.tree_id AND k.parent_id = o.node_id)"""

ENTRIES["tree_order"] = tree_order, f"WITH RECURSIVE {ORDER_SQL} SELECT tree_id, node_id, depth, array_to_string(path, '.') AS path, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS INTEGER) AS preorder FROM wk"
ENTRIES["normalised_blocks"] = normalised_blocks, f"WITH RECURSIVE {NORMAL_SQL} SELECT tree_id, node_id, node_kind, reason, owner, level FROM ow"
ENTRIES["tree_documents"] = tree_documents, f"WITH RECURSIVE {ORDER_SQL} SELECT tree_id, CAST(node_id AS VARCHAR) AS id, kind AS type, CASE WHEN kind = 'Text' THEN 'a \"quoted\" text' END AS content, depth, CAST(place AS DOUBLE) AS min_x, 3.0::DOUBLE AS max_y FROM wk"
