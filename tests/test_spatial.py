"""Properties of the spatial operators, and brute-force versions of those without SQL."""

import random

import pytest
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.operators import drawing as D
from drawlake.operators.spatial import box_join, connected
from drawlake.plans.shapes import ENTRIES
from drawlake.sources.drawings import entities, expand_blocks, leaf_boxes, svg_points

BOXES = "sheet_id BIGINT, handle BIGINT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE"


def some_boxes(n, seed, sheets=2, zero=False):
    r = random.Random(seed)
    out = []
    for h in range(n):
        x, y = r.uniform(-300, 300), r.uniform(-300, 300)
        w, t = (0.0, 0.0) if zero and h % 5 == 0 else (r.uniform(0, 150), r.uniform(0, 80))
        out.append((h % sheets, h, x, y, x + w, y + t))
    return out


@pytest.mark.parametrize("within", [0.0, 2.0, 40.0])
def test_box_join_equals_nested_loop(spark, within):
    rows = some_boxes(60, 1, zero=True)
    df = spark.createDataFrame(rows, BOXES)
    got = [(r.a_handle, r.b_handle) for r in box_join(df, df, within).collect()]
    hit = lambda a, b: a[0] == b[0] and a[2] - within <= b[4] and b[2] <= a[4] + within and a[3] - within <= b[5] and b[3] <= a[5] + within
    assert sorted(got) == sorted((a[1], b[1]) for a in rows for b in rows if hit(a, b))


def test_touching_boxes_join_once(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 64.0, 64.0), (1, 2, 64.0, 64.0, 128.0, 128.0)], BOXES)
    assert box_join(df, df).filter("a_handle < b_handle").count() == 1


def components_by_hand(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_any_edge_order(spark):
    edges = [(0, i, i + 1) for i in range(40)] + [(0, 60, 50), (1, 3, 2)]
    nodes = [(0, i) for i in range(41)] + [(0, 50), (0, 60), (0, 99), (1, 2), (1, 3)]
    n = spark.createDataFrame(nodes, "sheet_id BIGINT, handle BIGINT")
    for order in (edges, edges[::-1]):
        e = spark.createDataFrame(order, "sheet_id BIGINT, a BIGINT, b BIGINT")
        got = {(r.sheet_id, r.handle): r.component for r in connected(n, e).collect()}
        want = components_by_hand(nodes, [((s, a), (s, b)) for s, a, b in edges])
        assert got == {k: v[1] for k, v in want.items()}


def test_no_edges_leave_every_node_alone(spark):
    n = spark.createDataFrame([(0, 1), (0, 2)], "sheet_id BIGINT, handle BIGINT")
    e = spark.createDataFrame([], "sheet_id BIGINT, a BIGINT, b BIGINT")
    assert {r.component for r in connected(n, e).collect()} == {1, 2}


def test_merged_views_cover_their_clusters(spark, sf_dir):
    e = entities(spark, sf_dir)
    clusters = D.cluster_boxes(e)
    merged = ENTRIES["view_merge"][0](spark, sf_dir)
    assert merged.agg(F.sum("clusters")).first()[0] == clusters.count()
    assert merged.agg(F.sum("n")).first()[0] == clusters.agg(F.sum("n")).first()[0]


def test_merge_edges_equal_brute_force(spark, sf_dir):
    e = entities(spark, sf_dir)
    c = D.cluster_boxes(e).withColumnRenamed("cluster_id", "view_id")
    sheets = {r.sheet_id: r for r in D.sheet_bounds(e).collect()}
    rows = [r for r in c.collect() if (r.max_x - r.min_x) * (r.max_y - r.min_y) > 1e-6]
    by = {}
    for r in rows:
        by.setdefault(r.sheet_id, []).append(r)
    want = set()
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    clamp = lambda v: min(1, max(0, v))
    for sheet, views in by.items():
        s = sheets[sheet]
        sa = area((s.min_x, s.min_y, s.max_x, s.max_y))
        boxes = {v.view_id: (v.min_x, v.min_y, v.max_x, v.max_y) for v in views}
        for i, a in boxes.items():
            for j, b in boxes.items():
                if i >= j:
                    continue
                ratio = lambda k, a=a, b=b: (lambda m: max(0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) / m if m > 1e-9 else 0)(min(a[k + 2] - a[k], b[k + 2] - b[k]))
                diag = lambda q: ((q[2] - q[0]) ** 2 + (q[3] - q[1]) ** 2) ** 0.5
                gap = max(0, b[0] - a[2], a[0] - b[2], b[1] - a[3], a[1] - b[3]) / max(1e-9, min(diag(a), diag(b)))
                band = max(ratio(0), ratio(1))
                u = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                plausible = clamp((area(a) + area(b)) / area(u))
                if gap > 0.35 or band < 0.45 or area(a) >= 0.25 * sa and area(b) >= 0.25 * sa and plausible < 0.35:
                    continue
                dx, dy = (u[2] - u[0]) * 0.08, (u[3] - u[1]) * 0.08
                k = (u[0] + dx, u[1] + dy, u[2] - dx, u[3] - dy)
                blockers = sum(o not in (i, j) and q[0] - 1 <= k[2] and k[0] <= q[2] + 1 and q[1] - 1 <= k[3] and k[1] <= q[3] + 1 for o, q in boxes.items())
                penalty = clamp(blockers * 0.35)
                if penalty >= 0.70:
                    continue
                isolation = clamp((1 - clamp((area(u) - area(a) - area(b)) / area(u))) * (1 - penalty))
                score = 0.30 * (1 - clamp(gap / 0.35)) + 0.25 * band + 0.15 * min(diag(a), diag(b)) / max(diag(a), diag(b)) + 0.10 * plausible + 0.20 * isolation
                if round(score, 9) >= 0.62:
                    want.add((sheet, i, j))
    got = {(r.sheet_id, r.a, r.b) for r in D.merge_edges(c, D.sheet_bounds(e)).collect()}
    assert got == want


def test_grid_islands_equal_flood_fill(spark, sf_dir):
    cells = D.occupied_cells(entities(spark, sf_dir).filter("kind = 'Circle'"))
    on = {(r.sheet_id, r.row, r.col) for r in cells.collect()}
    sizes = {}
    while on:
        start = on.pop()
        todo, seen = [start], [start]
        while todo:
            s, r, c = todo.pop()
            for n in ((s, r + 1, c), (s, r - 1, c), (s, r, c + 1), (s, r, c - 1)):
                if n in on:
                    on.remove(n)
                    todo.append(n)
                    seen.append(n)
        sizes[(start[0], min(r * 30 + c for _, r, c in seen))] = len(seen)
    assert {(r.sheet_id, r.island): r.cells for r in D.grid_islands(cells).collect()} == sizes


def test_block_walk_stops_at_cycles(spark):
    inserts = spark.createDataFrame([("a", "b", 1.0, 0.0), ("b", "c", 1.0, 2.0), ("c", "a", 1.0, 0.0)], "parent STRING, child STRING, dx DOUBLE, dy DOUBLE")
    got = expand_blocks(inserts, spark.createDataFrame([("a",)], "node STRING")).collect()
    assert sorted((r.node, r.depth, r.dx, r.dy) for r in got) == [("a", 0, 0.0, 0.0), ("b", 1, 1.0, 0.0), ("c", 2, 2.0, 2.0)]


def test_json_leaves(spark):
    box = "id STRING, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE"
    schema = f"tree_id BIGINT, node STRUCT<{box.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}, children: ARRAY<STRUCT<{box.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>>"
    rows = [(1, ("r", 0.0, 0.0, 9.0, 9.0, [("x", 1.0, 1.0, 2.0, 2.0), ("far", 1e13, 0.0, 1.0, 1.0)])), (2, ("leaf", 0.0, 0.0, 1.0, 1.0, []))]
    assert {r.id for r in leaf_boxes(spark.createDataFrame(rows, schema)).collect()} == {"x", "leaf"}


def test_svg_points(spark):
    lines = spark.createDataFrame([('<path d="M 1,2 L 3.5 -4 1,2"/>',)], "value STRING")
    assert {(r.x, r.y) for r in svg_points(lines).collect()} == {(1.0, 2.0), (3.5, -4.0)}


def test_null_boxes_do_not_count(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, None, None, None, None)], BOXES)
    r = D.sheet_bounds(df).first()
    assert (r.min_x, r.max_y, r.n) == (0.0, 1.0, 2)


def test_deflate_turns_to_the_centre(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 4.0, 40.0)], BOXES)
    d = B.deflated(B.box(), 10.0)
    assert tuple(df.select(*d).first()) == (2.0, 10.0, 2.0, 30.0)


def test_point_in_polygon_and_area(spark):
    p = "array(struct(0.0D AS x, 0.0D AS y), struct(4.0D AS x, 0.0D AS y), struct(4.0D AS x, 4.0D AS y), struct(0.0D AS x, 4.0D AS y))"
    df = spark.range(1).select(F.expr(p).alias("p"))
    inside = lambda x, y: B.point_in_polygon(F.col("p"), F.lit(x), F.lit(y))
    assert tuple(df.select(B.polygon_area(F.col("p")), inside(1.0, 1.0), inside(5.0, 1.0)).first()) == (16.0, True, False)
