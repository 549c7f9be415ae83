"""Trees: odd nodes, depth without a bound in the schema, documents as another reader sees them."""

import json

import pytest
from pyspark.sql import functions as F

from drawlake.operators import trees as T

NODE = "tree_id BIGINT, node_id BIGINT, parent_id BIGINT, place INT, kind STRING"


def test_preorder_of_odd_nodes(spark):
    rows = [(1, 1, None, 0, "BlockReference"), (1, 2, 1, 5, "Line"), (1, 3, 1, 1, None), (1, 4, 1, 1, "Text"), (1, 5, 3, None, "Line"), (1, 6, 99, 0, "Line"), (1, 7, 8, 0, "Line"), (1, 8, 7, 0, "Line"), (2, 1, None, 0, "Line"), (2, 2, None, 0, "Line")]
    nodes = spark.createDataFrame(rows, NODE)
    got = [(r.tree_id, r.node_id, r.depth) for r in T.numbered(nodes).orderBy("tree_id", "preorder").collect()]
    assert got == [(1, 1, 0), (1, 3, 1), (1, 5, 2), (1, 4, 1), (1, 2, 1), (2, 1, 0), (2, 2, 0)]
    assert T.numbered(nodes.limit(0)).count() == 0
    with pytest.raises(ValueError, match="deeper than 2"):
        T.numbered(nodes, 2)


def test_children_of_collapsed_blocks_move_up(spark):
    b = "BlockReference"
    rows = [(1, 1, None, 0, b), (1, 2, 1, 0, b), (1, 3, 2, 0, b), (1, 4, 3, 0, "Line"), (1, 5, 3, 1, "Line"), (1, 6, 3, 2, "Circle"), (1, 7, 1, 1, "Line"), (1, 8, 1, 2, "Text"), (1, 9, 1, 3, b)]
    got = {r.node_id: (r.node_kind, r.reason, r.owner, r.level) for r in T.normalised(T.numbered(spark.createDataFrame(rows, NODE))).collect()}
    assert got[1] == ("PreservedBlock", "mixed geometry and annotation", None, 0)
    assert got[2] == ("CollapsedWrapper", "single child wrapper", 1, 1)
    assert got[3] == ("PreservedBlock", "enough geometry leaves", 1, 1)
    assert got[4] == ("GeometryLeaf", None, 3, 2) and got[9] == ("PreservedBlock", "empty block", 1, 1)
    cut = {r.node_id: r.reason for r in T.normalised(T.numbered(spark.createDataFrame(rows, NODE)), T.CollapseOptions(most_depth=1)).collect()}
    assert set(cut) == {1, 2, 7, 8, 9} and cut[2] == "max depth reached"
    neutral = T.normalised(T.numbered(spark.createDataFrame([(1, 1, None, 0, b), (1, 2, 1, 0, "Line")], NODE)), T.CollapseOptions(keep_neutral=False)).collect()
    assert {r.node_id: r.node_kind for r in neutral}[1] == "CollapsedWrapper"


def deep(levels):
    node = {"Id": "leaf", "Type": "LINE", "Bounds": {"MinPoint": {"X": 1.5, "Y": -2.0}, "MaxPoint": {"X": 3.0, "Y": 4.25}}, "Children": []}
    for i in range(levels):
        node = {"Id": f"n{i}", "Content": 'é "x" \\ \n', "Children": [node, {"Id": f"s{i}"}]}
    return node


def plain(node):
    """What a document says, without what is empty."""
    out = {k: node[k] for k in ("Id", "Type", "Content", "Layer", "Bounds") if node.get(k) is not None}
    return out | {"Children": [plain(c) for c in node.get("Children") or []]}


def test_documents_there_and_back(spark):
    docs = [(1, deep(25)), (2, {"Id": "alone"}), (3, {}), (4, deep(3))]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs] + [(5, None), (6, ""), (7, "no json"), (8, "[1]")], "tree_id BIGINT, document STRING")
    rows = T.flattened(df)
    assert rows.filter("tree_id = 1").count() == 51 and rows.agg(F.max("depth")).first()[0] == 25
    order = [r.id for r in rows.filter("tree_id = 4").orderBy("path").collect()]
    assert order == ["n2", "n1", "n0", "leaf", "s0", "s1", "s2"]
    back = {r.tree_id: json.loads(r.document) for r in T.nested(rows).collect()}
    assert {k: plain(v) for k, v in back.items()} == {i: plain(d) for i, d in docs}
    assert T.flattened(df.limit(0)).count() == 0 and T.nested(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="deeper than 4"):
        T.flattened(df, 4)
