"""Trees of any depth: pre-order, collapse of blocks that mean nothing, JSON documents to rows and back.

Nodes have tree_id, node_id, parent_id (null at a root), place (order among siblings, ties by
node_id) and further columns. A level of all trees is one join, written to the shared folder. Nodes
whose parent is not there, or that lie on a cycle, are not reached and left out. Trees deeper
than `most` levels are an error. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.functions import kinds as K
from drawlake.storage import joinable, written

NODE = ["tree_id", "node_id"]


def numbered(nodes: DataFrame, most: int = 1000) -> DataFrame:
    """Adds depth (0 at a root), path (places from the root down, which sort as pre-order does)
    and preorder (from 0 in each tree)."""
    sibling = W.partitionBy("tree_id", "parent_id").orderBy("place", "node_id")
    n = joinable(nodes.select(*NODE, "parent_id", F.row_number().over(sibling).alias("_nth")), "tree-nodes")
    level = n.filter("parent_id IS NULL").select(*NODE, F.lit(0).alias("depth"), F.array("_nth").alias("path"))
    below = n.filter("parent_id IS NOT NULL").select("tree_id", F.col("node_id").alias("_child"), F.col("parent_id").alias("node_id"), "_nth")
    out = None
    for _ in range(most):
        level = joinable(level, "tree-level")
        if level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
        level = level.join(below, NODE).select("tree_id", F.col("_child").alias("node_id"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("_nth")).alias("path"))
    else:
        raise ValueError(f"trees are deeper than {most} levels")
    if out is None:
        out = level
    order = F.row_number().over(W.partitionBy("tree_id").orderBy("path")) - 1
    return nodes.join(out.withColumn("preorder", order).hint("merge"), NODE)  # as large as nodes; a union drops hints


@dataclass(frozen=True)
class CollapseOptions:
    """Which blocks are kept. Fixed values."""

    most_depth: int = 32
    geometry: int = 3
    leaves: int = 5
    single_child: bool = True
    near_empty: bool = True
    keep_neutral: bool = True


def normalised(nodes: DataFrame, opt: CollapseOptions = CollapseOptions()) -> DataFrame:
    """Nodes of `numbered` (with kind) as a normalised hierarchy: node_kind (PreservedBlock,
    CollapsedWrapper, GeometryLeaf, TextLeaf, DimensionLeaf, UnknownLeaf), reason of the decision
    on a block, owner (the nearest preserved block above, else null) and level (preserved
    blocks above). Children of a collapsed block move to the block above it. What lies below
    the greatest depth is left out, as its block is kept without children."""
    c = F.col
    kind = c("kind")
    x = nodes.filter(c("depth") <= opt.most_depth)
    block = kind == "BlockReference"
    leaf = F.when(K.is_text(kind), "TextLeaf").when(K.is_dimension(kind), "DimensionLeaf").when(K.is_geometry(kind), "GeometryLeaf").otherwise("UnknownLeaf")
    child = x.withColumn("_leaf", F.when(~block, leaf)).groupBy("tree_id", c("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("children"), F.count_if(block).alias("blocks"), F.count_if(c("_leaf") == "GeometryLeaf").alias("shapes"), F.count_if(c("_leaf") == "TextLeaf").alias("texts"),
        F.count_if(c("_leaf") == "DimensionLeaf").alias("dims"), F.count_if(~block).alias("leaves"),
    )
    x = x.join(child, NODE, "left").na.fill(0, ["children", "blocks", "shapes", "texts", "dims", "leaves"])
    notes = c("texts") + c("dims")
    reason = F.when(c("depth") >= opt.most_depth, "max depth reached").when(c("children") == 0, "empty block")
    if opt.single_child:
        reason = reason.when((c("children") == 1) & (c("blocks") == 1), "single child wrapper")
    if opt.near_empty:
        reason = reason.when((c("children") <= 2) & (c("shapes") == 0) & (notes <= 1), "near empty wrapper")
    reason = reason.when(c("shapes") >= opt.geometry, "enough geometry leaves").when(c("leaves") >= opt.leaves, "enough total leaves").when((c("shapes") > 0) & (notes > 0), "mixed geometry and annotation").otherwise("neutral")
    dropped = ["single child wrapper", "near empty wrapper", *([] if opt.keep_neutral else ["neutral"])]
    x = x.withColumn("reason", F.when(block, reason))
    x = x.withColumn("node_kind", F.when(~block, leaf).when(c("reason").isin(*dropped), "CollapsedWrapper").otherwise("PreservedBlock"))
    x = joinable(x.select(*nodes.columns, "reason", "node_kind"), "judged-nodes")
    # Owners come down level by level: a kept parent, or what owns a collapsed one.
    level = x.filter("parent_id IS NULL").select(*NODE, "node_kind", F.lit(None).cast(dict(nodes.dtypes)["node_id"]).alias("owner"), F.lit(0).alias("level"))
    below = x.filter("parent_id IS NOT NULL").select("tree_id", c("node_id").alias("_child"), c("parent_id").alias("node_id"), c("node_kind").alias("_kind"))
    out = level
    for _ in range(opt.most_depth + 1):
        kept = c("node_kind") == "PreservedBlock"
        level = level.join(below, NODE).select(
            "tree_id", c("_child").alias("node_id"), c("_kind").alias("node_kind"), F.when(kept, c("node_id")).otherwise(c("owner")).alias("owner"), (c("level") + kept.cast("int")).alias("level")
        )
        level = joinable(level, "owner-level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return x.join(out.drop("node_kind"), NODE)


# --- JSON -----------------------------------------------------------------------------------------

_POINT = "STRUCT<X: DOUBLE, Y: DOUBLE>"
#: A node of a spatial document; its children stay text until their own level is read.
JSON_NODE = f"Id STRING, Type STRING, Content STRING, Layer STRING, Bounds STRUCT<MinPoint: {_POINT}, MaxPoint: {_POINT}>, Children ARRAY<STRING>"
_FIELDS = {"id": "Id", "type": "Type", "content": "Content", "layer": "Layer"}


def flattened(documents: DataFrame, most: int = 1000) -> DataFrame:
    """Every node of nested JSON documents (tree_id, document): tree_id, path (places from the root
    down), depth, id, type, content, layer and box, in any depth. Texts that are no JSON object
    give no rows; fields that are missing are null."""
    node = F.from_json("_text", JSON_NODE)
    level = documents.select("tree_id", F.col("document").alias("_text"), F.array(F.lit(0)).alias("path"), F.lit(0).alias("depth"))
    out = None
    for _ in range(most):
        read = level.withColumn("_n", node).filter("_n IS NOT NULL AND ltrim(_text) LIKE '{%'")
        read = written(read.select("tree_id", "path", "depth", "_n.*"), "json-level")
        if read.isEmpty():
            break
        box = [F.col(f"Bounds.{p}.{a}").alias(n) for n, p, a in (("min_x", "MinPoint", "X"), ("min_y", "MinPoint", "Y"), ("max_x", "MaxPoint", "X"), ("max_y", "MaxPoint", "Y"))]
        rows = read.select("tree_id", "path", "depth", *[F.col(j).alias(n) for n, j in _FIELDS.items()], *box)
        out = rows if out is None else out.unionByName(rows)
        level = read.select("tree_id", "path", "depth", F.posexplode("Children").alias("_i", "_text")).select("tree_id", "_text", F.array_append("path", F.col("_i")).alias("path"), (F.col("depth") + 1).alias("depth"))
    else:
        raise ValueError(f"documents are nested deeper than {most}")
    if out is None:
        empty = level.select("tree_id", "path", "depth", *[F.lit(None).cast("string").alias(n) for n in _FIELDS], *[F.lit(None).cast("double").alias(n) for n in ("min_x", "min_y", "max_x", "max_y")])
        return empty.filter("false")
    return out


def _text(name: str, value: Column) -> Column:
    """A field of a JSON object, or null where the value is."""
    return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', "")))


def nested(rows: DataFrame) -> DataFrame:
    """The documents of rows as `flattened` gives them: tree_id, document. Levels are folded into
    their parents from the deepest up; a document is one row, so it has to fit in a task."""
    corner = lambda a, b: F.struct(F.col(a).alias("X"), F.col(b).alias("Y"))
    box = F.when(F.col("min_x").isNotNull(), F.struct(corner("min_x", "min_y").alias("MinPoint"), corner("max_x", "max_y").alias("MaxPoint")))
    own = F.concat_ws(",", *[_text(j, F.col(n)) for n, j in _FIELDS.items()], _text("Bounds", box))
    x = joinable(rows.select("tree_id", "path", "depth", own.alias("own")), "json-nodes")
    deepest = x.agg(F.max("depth")).first()[0]
    if deepest is None:
        return rows.select("tree_id", F.lit("").alias("document")).filter("false")
    below = None
    for depth in range(deepest, -1, -1):
        level = x.filter(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("children", F.lit(""))
        else:
            held = below.groupBy("tree_id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "document"))), lambda c: c["document"]), ",").alias("children"))
            level = level.join(held, ["tree_id", "path"], "left").na.fill("", ["children"])
        parts = F.concat_ws(",", F.when(F.col("own") != "", F.col("own")), F.concat(F.lit('"Children":['), F.col("children"), F.lit("]")))
        below = joinable(level.select("tree_id", "path", F.concat(F.lit("{"), parts, F.lit("}")).alias("document")), "json-level")
    return below.select("tree_id", "document")
