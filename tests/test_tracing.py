"""Closed chains, holes and contours against plain loops."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from drawlake.operators import tracing as T
from drawlake.plans.tracing import ring_views
from drawlake.sources.strokes import strokes
from drawlake.storage import written


@pytest.fixture(scope="module")
def drawn(spark, sf_dir):
    return written(strokes(spark, sf_dir).filter("sheet_id < 6"), "strokes")


def chains_by_hand(lines, opt):
    """Every end is compared with all points before it."""
    nodes = []

    def node(p):
        for i, q in enumerate(nodes):
            if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= opt.snap**2:
                return i
        nodes.append(p)
        return len(nodes) - 1

    ends = [(node((a, b)), node((c, d))) for a, b, c, d in lines]
    left, out = set(range(len(lines))), []
    for i in range(len(lines)):
        if i not in left:
            continue
        left.discard(i)
        path, way = [i], [ends[i][0], ends[i][1]]
        while way[-1] != way[0]:
            more = [j for j in sorted(left) if way[-1] in ends[j]]
            if not more:
                break
            left.discard(more[0])
            a, b = ends[more[0]]
            path.append(more[0])
            way.append(b if a == way[-1] else a)
        points = [nodes[k] for k in way]
        closed, gap = way[-1] == way[0], math.dist(points[0], points[-1])
        if not closed and opt.heal and len(points) >= 3 and gap <= max(opt.gap, opt.closure):
            closed = True
            points.append(points[0])
        out.append((path, points, closed, gap))
    return out


def area(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


@pytest.mark.parametrize("opt", [T.ChainOptions(), T.ChainOptions(snap=1.0, gap=4.0), T.ChainOptions(heal=False)])
def test_chains_equal_loops(spark, drawn, opt):
    segments = T.chain_segments(T.outline_strokes(drawn), opt)
    by = defaultdict(list)
    for r in sorted(segments.collect(), key=lambda r: (r.handle, r.seq)):
        by[r.sheet_id].append(r)
    want = []
    for sheet, rows in by.items():
        for i, (path, points, closed, gap) in enumerate(chains_by_hand([(r.x0, r.y0, r.x1, r.y1) for r in rows], opt)):
            want.append((sheet, i, len(path), sorted({rows[j].handle for j in path}), closed, round(gap, 6), round(area(points) if closed and len(points) >= 3 else 0.0, 4)))
    got = [(r.sheet_id, r.chain, r.segments, r.handles, r.closed, round(r.gap, 6), round(r.area, 4)) for r in T.closed_chains(segments, opt).collect()]
    assert sorted(got) == sorted(want)
    assert any(r[4] for r in got) and any(r[4] and r[5] > 0 for r in got) == opt.heal and any(not r[4] for r in got)


def within(p, polygon):
    hit = False
    for a, b in zip(polygon, polygon[-1:] + polygon[:-1], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1] + 1e-12) + a[0]:
            hit = not hit
    return hit


def test_holes_equal_loops(spark, drawn):
    chains = T.closed_chains(T.chain_segments(T.outline_strokes(drawn)), T.ChainOptions(snap=1.0))
    loops = [r for r in chains.collect() if r.closed and r.area > 0]
    parent = {}
    for r in loops:
        polygon = list(zip(r.vx, r.vy, strict=True))
        p = ((r.min_x + r.max_x) / 2, (r.min_y + r.max_y) / 2)
        if not within(p, polygon):
            p = ((p[0] + r.vx[0]) / 2, (p[1] + r.vy[0]) / 2)
        around = [(q.area, q.chain) for q in loops if q.sheet_id == r.sheet_id and q.area > r.area and within(p, list(zip(q.vx, q.vy, strict=True)))]
        parent[r.sheet_id, r.chain] = min(around)[1] if around else None

    def depth(key):
        up = parent[key]
        return 0 if up is None else 1 + depth((key[0], up))

    got = {(r.sheet_id, r.chain): (r.parent, r.depth, r.is_hole) for r in T.chain_holes(chains).collect()}
    assert got == {k: (parent[k], depth(k), depth(k) % 2 == 1) for k in parent}
    assert {d for _, d, _ in got.values()} >= {0, 1, 2}


def test_contours_find_the_drawn_rings(spark, drawn):
    """A ring whose edges are all there and near each other is its view's contour."""
    best = {(r.sheet_id, r.view_id): r for r in T.outer_contours(drawn, ring_views(drawn)).collect()}
    assert any(r.again for r in best.values()) and any(not r.again for r in best.values())
    assert all(r.closed and r.touching >= 2 and r.valid for r in best.values())
    whole = [r for r in best.values() if r.touching == 4 and r.n >= 8]
    assert whole and all(r.coverage > 0.9 for r in whole)


def test_contours_of_odd_rows(spark, drawn):
    views = ring_views(drawn)
    assert T.outer_contours(drawn.limit(0), views).count() == 0
    assert T.outer_contours(drawn, views.limit(0)).count() == 0
    bare = drawn.select(*[F.col(c) if c in ("sheet_id", "handle", "kind") else F.lit(None).cast(t).alias(c) for c, t in drawn.dtypes])
    assert T.outer_contours(bare, views).count() == 0 and T.chain_segments(bare).count() == 0
    assert T.closed_chains(T.chain_segments(drawn.limit(0))).count() == 0
    boxed = drawn.select(*[F.lit(None).cast(t).alias(c) if c in ("sx", "sy", "ex", "ey", "vx", "vy", "cx", "cy") else F.col(c) for c, t in drawn.dtypes])
    kinds = {r.edge_kind for r in T.contour_edges(T.view_strokes(boxed, views)).collect()}
    assert kinds <= {"Circle", "Ellipse"}


def test_same_handles_on_two_sheets(spark, drawn):
    """A sheet copied under another id gives the same contours and chains there."""
    one = drawn.filter("sheet_id = 1")
    both = one.unionByName(one.withColumn("sheet_id", F.lit(100).cast("bigint")))
    for f in (lambda d: T.outer_contours(d, ring_views(d)), lambda d: T.closed_chains(T.chain_segments(T.outline_strokes(d)))):
        rows = sorted((tuple(r)[1:] for r in f(one).collect()), key=str)
        twice = sorted((tuple(r)[1:] for r in f(both).collect()), key=str)
        assert rows and twice == sorted(rows + rows, key=str)
