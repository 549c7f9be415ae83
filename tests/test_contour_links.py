"""Links of contour edges against plain loops, and what they send through shuffles."""

import math
import random
from collections import defaultdict

import pytest

from drawlake.operators import tracing as T
from drawlake.plans import catalog

SCHEMA = "sheet_id BIGINT, view_id BIGINT, edge INT, color INT, weight INT, lt STRING, lay STRING, loose STRING, v_min_x DOUBLE, v_min_y DOUBLE, v_max_x DOUBLE, v_max_y DOUBLE, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"


def edge(n, x0, y0, x1, y1, view=1, side=100.0, color=1, lt="", lay="A"):
    return (7, view, n, color, 25, lt, lay, lt if lt == "DASHED" else "", 0.0, 0.0, side, side, float(x0), float(y0), float(x1), float(y1))


def links_by_hand(rows, most=8):
    """Every end of an edge is compared with those of all others of its view."""
    best = defaultdict(dict)
    for a in rows:
        tol = max(2.0, max(1.0, min(a[10] - a[8], a[11] - a[9])) * 0.015)
        for b in rows:
            if a[:2] != b[:2] or a[2] == b[2]:
                continue
            for i, (ax, ay, px, py) in ((1, (a[12], a[13], a[14], a[15])), (0, (a[14], a[15], a[12], a[13]))):
                for j, (bx, by, qx, qy) in ((1, (b[12], b[13], b[14], b[15])), (0, (b[14], b[15], b[12], b[13]))):
                    distance = math.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
                    if not distance <= tol:
                        continue
                    dx, dy, ex, ey = px - ax, py - ay, qx - bx, qy - by
                    m, n = math.sqrt(dx * dx + dy * dy), math.sqrt(ex * ex + ey * ey)
                    direction = 0.0 if m <= 1e-9 or n <= 1e-9 else (max(-1.0, min(1.0, -(dx * ex + dy * ey) / (m * n))) + 1) * 0.5
                    exact, loose = a[3:7] == b[3:7], a[3:5] == b[3:5] and a[7] == b[7]
                    score = round(max(0.0, 100 - distance * 10) + direction * 50 + (80 if exact else 40 if loose else 0), 6)
                    now = (-score, i, -j, distance, direction, exact, loose)
                    at = best[a[0], a[1], a[2]]
                    at[b[2]] = min(at.get(b[2], now), now)
    out = []
    for key, found in best.items():
        order = sorted((v[0], round(v[3], 6), b, v) for b, v in found.items())
        out += [(*key, b, round(v[3], 6), round(v[4], 6), v[5], v[6], -s, i + 1) for i, (s, _, b, v) in enumerate(order[:most])]
    return sorted(out)


def linked(spark, rows):
    return sorted((r.sheet_id, r.view_id, r.edge, r.next, round(r.distance, 6), round(r.direction, 6), r.exact, r.loose, r.score, r.place) for r in T.contour_links(spark.createDataFrame(rows, SCHEMA)).collect())


def test_links_equal_loops(spark):
    """Crowded and sparse views, ends at one point, on one vertical and on both sides of zero."""
    rng, rows = random.Random(3), []
    for view, side, wide in ((1, 100.0, 8), (2, 313.0, 40), (3, 700.0, 25)):
        for n in range(1, 81):
            x, y, u, v = (rng.choice([rng.uniform(-wide, wide), float(rng.randrange(-wide, wide))]) for _ in range(4))
            rows.append(edge(n, x, y, *((x, v) if n % 5 == 0 else (x, y) if n % 11 == 0 else (u, v)), view, side, rng.choice([1, 2, None]), rng.choice(["", "DASHED", "BYLAYER"]), rng.choice("AB")))
    assert linked(spark, rows) == links_by_hand(rows)


@pytest.mark.parametrize("turn", [False, True])
def test_a_distance_rounded_to_the_tolerance_links(spark, turn):
    """The ends lie more than the tolerance of 2 apart, but by less than a distance can tell."""
    p, q = (-1e-20, 2.0) if turn else (2.0, -1e-20)
    for rows in ([edge(1, p, 0, p, 50), edge(2, q, 0, q, -50)], [edge(1, 0, p, 50, p), edge(2, 0, q, -50, q)]):
        assert [x[2:4] for x in links_by_hand(rows)] == [(1, 2), (2, 1)]
        assert linked(spark, rows) == links_by_hand(rows)


def test_ends_without_a_place_link_with_nothing(spark):
    rows = [edge(1, 0, 0, 9, 0), edge(2, 9, 0, math.inf, 0), edge(3, math.inf, 0, math.nan, 0), edge(4, math.nan, 0, -math.inf, 5)]
    assert [x[2:4] for x in linked(spark, rows)] == [(1, 2), (2, 1)]


def shuffled(df):
    """Rows that a query writes to its shuffles."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if kind == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleRecordsWritten").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_ends_are_not_dealt_to_nine_cells(spark, sf_dir):
    """An end meets its neighbours from 2.2 cells on average, so less than 15 rows an edge are shuffled in all."""
    edges = catalog.QUERIES["contour_edges"](spark, sf_dir).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = shuffled(catalog.QUERIES["contour_links"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert edges * 8 < rows < edges * 15
