"""Box joins, nearest neighbours and connected components within sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.functions.boxes import box, inflated, intersects
from drawlake.storage import components

BOX = ("min_x", "min_y", "max_x", "max_y")


def box_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Bounding box and row count of each group. Rows with null boxes do not count for the box."""
    return rows.groupBy(*keys).agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.count(F.lit(1)).alias("n")
    )


def prefixed(rows: DataFrame, prefix: str, keep: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    return rows.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in rows.columns])


def box_join(a: DataFrame, b: DataFrame, within: float = 0.0, cell: float = 64.0) -> DataFrame:
    """Pairs of rows of one sheet whose boxes lie within `within` of each other on both axes.

    Columns of a get the prefix a_, those of b the prefix b_. Boxes are dealt to grid cells
    that they cover, so the join is an equality on sheet and cell and a huge sheet spreads
    over many tasks. A pair that shares several cells is reported by the first of them, so
    no duplicate removal is needed.
    """

    def cells(rows: DataFrame, grow: float) -> DataFrame:
        g = inflated(box(), grow)
        at = lambda c: F.floor(c / cell)
        return rows.withColumn("_cx", F.explode(F.sequence(at(g.min_x), at(g.max_x)))).withColumn("_cy", F.explode(F.sequence(at(g.min_y), at(g.max_y))))

    left = prefixed(cells(a, within), "a_", ("sheet_id", "_cx", "_cy"))
    right = prefixed(cells(b, 0.0), "b_", ("sheet_id", "_cx", "_cy"))
    p, q = box("a_"), box("b_")
    near = intersects(inflated(p, within), q)
    first_x = F.floor(F.greatest(p.min_x - within, q.min_x) / cell)
    first_y = F.floor(F.greatest(p.min_y - within, q.min_y) / cell)
    return left.join(right, ["sheet_id", "_cx", "_cy"]).filter(near & (F.col("_cx") == first_x) & (F.col("_cy") == first_y)).drop("_cx", "_cy")


def best_per(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in a total order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def connected(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Components of each graph: nodes (keys, handle), edges (keys, a, b, any direction); keys
    name a graph, a sheet or a part of one. Adds component, the smallest handle reachable."""
    found = components(edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")), *keys)
    out = nodes.join(found.withColumnRenamed("node", "handle"), [*keys, "handle"], "left")
    return out.withColumn("component", F.coalesce("component", "handle"))
