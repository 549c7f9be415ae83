"""The chain of view sets against plain loops over each sheet's views."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from drawlake.operators import viewsets as VS
from drawlake.plans.tracing import drawn_views
from drawlake.sources.strokes import strokes
from drawlake.storage import written


class View:
    def __init__(self, r):
        self.id, self.sheet = r.view_id, r.sheet_id
        self.x0, self.y0, self.x1, self.y1 = r.min_x, r.min_y, r.max_x, r.max_y
        self.w, self.h = self.x1 - self.x0, self.y1 - self.y0
        self.area, self.mx, self.my = self.w * self.h, (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2
        self.role0 = r.initial_role or "Unknown"
        self.dims, self.geometry, self.center, self.hidden = r.dimensions or 0, r.geometry or 0, bool(r.has_center), bool(r.has_hidden)
        self.bridge = bool(r.is_bridge) or self.role0 == "SparseBridge"
        self.parent, self.embedded, self.children = None, False, 0
        self.source, self.position, self.projection, self.score, self.primary, self.role = None, None, None, None, False, None


def like(a, b):
    return min(a, b) / max(a, b) if max(a, b) > 1e-9 else 0.0


class Pair:
    """How b lies from a."""

    def __init__(self, a, b):
        dx, dy = b.mx - a.mx, b.my - a.my
        mw, mh = (a.w + b.w) / 2, (a.h + b.h) / 2
        self.fx, self.fy = abs(dx) / mw if mw > 1e-9 else 0.0, abs(dy) / mh if mh > 1e-9 else 0.0
        self.row, self.column = abs(dy) <= mh * 0.35, abs(dx) <= mw * 0.35
        self.wl, self.hl, self.al = like(a.w, b.w), like(a.h, b.h), like(a.area, b.area)
        self.common = max(0.0, min(a.x1, b.x1) - max(a.x0, b.x0)) * max(0.0, min(a.y1, b.y1) - max(a.y0, b.y0))
        self.holds = b.area > 0 and self.common / b.area >= 0.92 and a.x0 <= b.mx <= a.x1 and a.y0 <= b.my <= a.y1
        if abs(dx) <= 1e-6 and abs(dy) <= 1e-6:
            self.position = "Overlapping"
        elif self.row or not self.column and abs(dx) >= abs(dy):
            self.position = "Right" if dx >= 0 else "Left"
        else:
            self.position = "Above" if dy >= 0 else "Below"

    def cad(self, bonus):
        if self.position in ("Above", "Below"):
            s = (0.9 if self.column else 0) + self.wl * 1.2 + self.hl * 0.15 + self.al * 0.1 - (min(0.5, (self.fy - 2.5) * 0.2) if self.fy > 2.5 else 0)
        elif self.position in ("Left", "Right"):
            s = (0.9 if self.row else 0) + self.hl * 1.2 + self.wl * 0.15 + self.al * 0.1 - (min(0.5, (self.fx - 2.5) * 0.2) if self.fx > 2.5 else 0)
        else:
            return 0.0
        return round(max(0.0, s + bonus), 9)


def small(child, parent):
    return child.area <= 0.08 * parent.area and child.w <= 0.35 * parent.w and child.h <= 0.35 * parent.h


def resolve(views):
    pair = {(a.id, b.id): Pair(a, b) for a in views for b in views if a is not b}
    nested = lambda a, b: pair[a.id, b.id].holds or pair[b.id, a.id].holds
    for child in views:
        found = []
        for p in views:
            if p is child or p.bridge or not pair[p.id, child.id].holds or pair[child.id, p.id].holds and child.id < p.id:
                continue
            held, share = pair[p.id, child.id].common / child.area, child.area / p.area
            s = (4 if held >= 0.98 else 3 if held >= 0.95 else 2 if held >= 0.9 else 0) + (3 if share <= 0.1 else 2 if share <= 0.2 else 1 if share <= 0.35 else 0) + 2
            found.append((-s, min(p.id, child.id), max(p.id, child.id), p))
        if found:
            child.parent = min(found, key=lambda f: f[:3])[3]
            child.embedded = small(child, child.parent)
            child.parent.children += 1
    for v in views:
        v.top = v.parent is None and not v.bridge
        s = 0.35 * (v.dims > 0) + 0.55 * v.center + 0.4 * v.hidden + 0.15 * (v.geometry >= 3) + 0.1 * (not v.bridge)
        v.seed = v.top and round(s, 9) >= 0.75
        v.final = "GeometryView" if v.seed else v.role0
    tops = [v for v in views if v.top]
    for v in tops:
        if v.seed:
            continue
        best = 0.0
        for s in tops:
            if not s.seed or nested(s, v):
                continue
            p = pair[s.id, v.id]
            aspect = max(v.w, v.h) / min(v.w, v.h)
            score = 0.2 * p.row + 0.2 * p.column + 0.2 * (p.wl >= 0.45 and p.hl >= 0.45 and p.al >= 0.2) + 0.15 * (v.area / s.area >= 0.2) + 0.1 * (aspect <= 8) + 0.2 * v.center + 0.15 * v.hidden
            score += 0.1 * (v.center and s.center) + 0.08 * (v.hidden and s.hidden) + 0.15 * (v.dims > 0) + {"Below": 0.15, "Above": 0.05}.get(p.position, 0)
            best = max(best, round(score, 9))
        if best >= 0.55:
            v.final = "GeometryView"
    for v in tops:
        for s in sorted(tops, key=lambda s: s.id):
            if s is v:
                continue
            p = pair[s.id, v.id]
            score = p.cad(0.25 if v.final == s.final == "GeometryView" else 0.0)
            if score > (v.projection or 0.0):
                v.source, v.position, v.projection = s, p.position, score
    if tops:
        big, dims, span = max(max(v.area, 1.0) for v in tops), max(v.dims for v in tops), max(max(v.w, v.h) for v in tops)
        cx, cy = sum(v.mx for v in tops) / len(tops), sum(v.my for v in tops) / len(tops)
        wide = max(max(v.mx for v in tops) - min(v.mx for v in tops), max(v.my for v in tops) - min(v.my for v in tops))
    for v in tops:
        v.able = v.final == "GeometryView" and not (v.dims == 0 and v.area / big < 0.05)
        if not v.able:
            v.score = -1.0
            continue
        s = 6 + 4 * v.center + 2.5 * v.hidden + (v.geometry >= 6) + (v.dims / dims * 8 if dims else 0) + v.area / big * 6 + max(v.w, v.h) / max(1.0, span) * 2 + min(3, v.children * 0.75)
        if v.projection:
            s += {"Below": min(3.5, 1.5 + v.projection * 1.5), "Above": min(1.5, 0.4 + v.projection * 0.8)}.get(v.position, min(2.0, 0.8 + v.projection * 0.9) if v.position in ("Left", "Right") else 0)
        s += (1 - min(1, math.hypot(v.mx - cx, v.my - cy) / wide)) * 1.5 if wide > 1e-6 else 0
        aspect = max(v.w, v.h) / min(v.w, v.h)
        if aspect >= 20:
            s -= 0.75 if v.dims else 1.5
        elif aspect >= 12 and min(v.w, v.h) < 80:
            s -= 0.5 if v.dims else 2
        s -= 3 if not v.dims and not v.center and not v.hidden else 0
        v.score = round(s, 6)
    able = sorted((v for v in tops if v.able), key=lambda v: (-v.score, v.id))
    chosen = [v for v in able if v.score >= max(4.0, able[0].score * 0.4)][:3]
    chosen += [v for v in able if v not in chosen and v.seed][: 3 - len(chosen)]
    for v in chosen:
        v.primary = True
    anchor = None
    if chosen:
        dims, big, span = max(1, *(v.dims for v in chosen)), max(1.0, *(v.area for v in chosen)), max(1.0, *(max(v.w, v.h) for v in chosen))
        x0, x1, y0, y1 = min(v.x0 for v in chosen), max(v.x1 for v in chosen), min(v.y0 for v in chosen), max(v.y1 for v in chosen)

        def stands_for(v):
            mid = (1 - min(1, abs(v.mx - (x0 + x1) / 2) / max(x1 - x0, 1e-9)) + 1 - min(1, abs(v.my - (y0 + y1) / 2) / max(y1 - y0, 1e-9))) / 2
            used = sum(u.source is v for u in chosen)
            return round(6 + 2.5 * v.center + 1.5 * v.hidden + v.dims / dims * 8 + v.area / big * 4 + max(v.w, v.h) / span * 2 + 2.5 * used + mid * 1.5, 6)

        anchor = min(chosen, key=lambda v: (-stands_for(v), -v.dims, -v.area, v.id))
        beside = {}
        for place in ("Above", "Below", "Left", "Right"):
            found = [v for v in chosen if v is not anchor and not nested(anchor, v) and pair[anchor.id, v.id].position == place and pair[anchor.id, v.id].cad(0.25) > 0]
            if found:
                beside[place] = min(found, key=lambda v: (-pair[anchor.id, v.id].cad(0.25), -v.score, -v.area, v.id))
        for v in tops:
            own = VS.ROLES.get(v.position)
            if v is anchor:
                v.role = "Front"
            elif v in beside.values():
                v.role = next(VS.ROLES[p] for p, u in beside.items() if u is v)
            elif v.primary:
                for place, u in beside.items():
                    p = pair[u.id, v.id]
                    if not nested(u, v) and (place, p.position) in VS.SECOND_ROLES and p.cad(0.25) > 0:
                        v.role = VS.SECOND_ROLES[place, p.position]
                        break
                else:
                    v.role = f"{own}_Weak" if own else "Unresolved"
            elif v.final == "GeometryView":
                v.role = f"{own}_Reference" if own else "ReferenceGeometry"
    name = lambda v: v and v.id
    return [(v.sheet, v.id, name(v.parent), v.embedded, v.children, v.top, v.seed, v.final, name(v.source), v.position, v.projection, v.score, v.primary, name(anchor), v.role) for v in views]


def by_hand(rows):
    sheets = defaultdict(list)
    for r in rows:
        if r.min_x is not None:
            sheets[r.sheet_id].append(View(r))
    return sorted((x for views in sheets.values() for x in resolve(views)), key=lambda x: x[:2])


@pytest.fixture(scope="module")
def views(spark, sf_dir):
    return written(drawn_views(strokes(spark, sf_dir)), "drawn-views")


def near(a, b):
    return len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-5 for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_chain_equals_loops(views):
    want = by_hand(views.collect())
    got = sorted((tuple(r) for r in VS.resolved_views(views).collect()), key=lambda x: x[:2])
    assert near(got, want)
    roles = {r[-1] for r in got}
    assert {"Front", None} < roles and any(r and r.endswith("_Reference") for r in roles) and roles & set(VS.ROLES.values())
    assert any(r[2] for r in got) and any(r[3] for r in got) != all(r[3] for r in got)


def test_odd_views(spark, views):
    assert VS.resolved_views(views.limit(0)).count() == 0
    alone = views.filter("sheet_id = 2 AND view_id = 3")
    bare = alone.select(*[F.lit(None).cast(t).alias(c) if c in ("initial_role", "dimensions", "geometry", "has_center", "has_hidden", "is_bridge") else F.col(c) for c, t in views.dtypes])
    got = VS.resolved_views(bare).collect()
    assert [(r.final_role, r.is_primary, r.role, r.anchor) for r in got] == [("Unknown", False, None, None)]
    assert VS.resolved_views(bare.withColumn("min_x", F.lit(None).cast("double"))).count() == 0


def test_views_of_two_sheets(views):
    one = views.filter("sheet_id = 5")
    both = one.unionByName(one.withColumn("sheet_id", F.lit(77).cast("bigint")))
    rows = sorted((tuple(r)[1:] for r in VS.resolved_views(one).collect()), key=str)
    assert sorted((tuple(r)[1:] for r in VS.resolved_views(both).collect()), key=str) == sorted(rows + rows, key=str)
