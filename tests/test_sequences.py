"""Operators without SQL against plain versions: greedy, sequential and iterative ones, and sinks."""

from __future__ import annotations

import itertools
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from drawlake.operators import cells as C
from drawlake.operators import curves as U
from drawlake.operators import grids as G
from drawlake.operators import prefilter as R
from drawlake.plans import catalog
from drawlake.sources import sinks
from drawlake.sources.drawings import entities
from drawlake.storage import components, shared_dir


@pytest.fixture(scope="module")
def e(spark, sf_dir):
    return entities(spark, sf_dir).cache()


def box_gap(a, b):
    dx = max(0.0, b[0] - a[2], a[0] - b[2])
    dy = max(0.0, b[1] - a[3], a[1] - b[3])
    return (dx * dx + dy * dy) ** 0.5


def some_clusters(seed, n=25):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randrange(120), r.randrange(120)
        out.append({"cluster_id": i, "min_x": float(x), "min_y": float(y), "max_x": float(x + r.randrange(1, 25)), "max_y": float(y + r.randrange(1, 25)), "geometry": r.randrange(1, 12), "rounds": int(r.random() < 0.2), "parts": 1})
    return out


@pytest.mark.parametrize("seed", range(6))
def test_absorbing_and_aligning_keep_everything_and_stop(seed):
    rows, opt = some_clusters(seed), R.PreFilterOptions()
    done = R.absorb_and_align(rows, opt)
    assert sum(c["parts"] for c in done) == len(rows) and sum(c["geometry"] for c in done) == sum(c["geometry"] for c in rows)
    box = lambda c: (c["min_x"], c["min_y"], c["max_x"], c["max_y"])
    # Nothing that the rules allow is left to be done.
    for a, b in itertools.permutations(done, 2):
        w, h = a["max_x"] - a["min_x"], a["max_y"] - a["min_y"]
        both = min(a["max_x"], b["max_x"]) - max(a["min_x"], b["min_x"])
        level = min(a["max_y"], b["max_y"]) - max(a["min_y"], b["min_y"])
        least = min(w, b["max_x"] - b["min_x"])
        area = min(w * h, (b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"]))
        column = least > 0 and both / least >= 0.9 and abs(a["min_x"] + a["max_x"] - b["min_x"] - b["max_x"]) / 2 <= 12
        apart = max(0.0, b["min_y"] - a["max_y"], a["min_y"] - b["max_y"])
        few = a["geometry"] + b["geometry"] <= 20
        assert not (area >= 150 and column and both >= 2 and apart <= (40 if few else 8) and level <= 0)
    assert R.absorb_and_align(rows[::-1], opt) == done and box(done[0])


def test_one_fragment_joins_the_nearest_host():
    make = lambda i, x, y, w, h, n, k=0: {"cluster_id": i, "min_x": x, "min_y": y, "max_x": x + w, "max_y": y + h, "geometry": n, "rounds": k, "parts": 1}
    rows = [make(1, 0.0, 0.0, 50.0, 50.0, 9), make(2, 53.0, 10.0, 5.0, 5.0, 2), make(3, 62.0, 0.0, 40.0, 40.0, 9), make(4, 200.0, 0.0, 5.0, 5.0, 1), make(5, 53.0, 30.0, 5.0, 5.0, 2, 1)]
    done = {c["cluster_id"]: c["parts"] for c in R.absorb_and_align(rows)}
    assert done == {1: 2, 3: 1, 4: 1, 5: 1}  # the round one stays, the far one has no host


def test_pre_filter_query(spark, sf_dir):
    got = catalog.QUERIES["pre_filter"](spark, sf_dir).collect()
    merged = catalog.QUERIES["cluster_merges"](spark, sf_dir).groupBy("sheet_id").agg(F.sum("geometry").alias("g"), F.count(F.lit(1)).alias("n")).collect()
    total, n = defaultdict(int), defaultdict(int)
    for r in got:
        total[r.sheet_id] += r.geometry
        n[r.sheet_id] += 1
    for r in merged:
        assert total[r.sheet_id] == r.g and n[r.sheet_id] <= r.n


def test_badges_take_turns(spark):
    rows = [(1, 10, 100, 3.0), (1, 11, 100, 1.0), (1, 10, 101, 5.0), (1, 12, 100, 0.5), (2, 7, 1, 2.0), (1, 11, 101, 9.0)]
    got = sorted(tuple(r) for r in C.badge_pairs(spark.createDataFrame(rows, C.PAIRED)).collect())
    # 10 takes 100, so 11 is left with 101 and 12 with nothing.
    assert got == [(1, 10, 100, 3.0), (1, 11, 101, 9.0), (2, 7, 1, 2.0)]
    assert C.badge_pairs(spark.createDataFrame([], C.PAIRED)).count() == 0


def test_every_loose_text_has_one_fate(spark, sf_dir):
    from drawlake.plans import cells as P
    from drawlake.sources.primitives import primitives

    got = catalog.QUERIES["loose_remainder"](spark, sf_dir).collect()
    texts = P.loose(primitives(spark, sf_dir)).filter("text IS NOT NULL").count()
    assert len(got) == len({r.handle for r in got}) == texts
    assert {"quantity-note", "free-note"} <= {r.fate for r in got} <= {"annotation", "badge", "quantity-note", "free-note"}


def groups_by_hand(dims, dividers, within):
    groups = []
    for i, b in enumerate(dims):
        cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        ranked = []
        for k, members in enumerate(groups):
            box = [min(dims[m][0] for m in members), min(dims[m][1] for m in members), max(dims[m][2] for m in members), max(dims[m][3] for m in members)]
            gx, gy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
            ranked.append((((cx - gx) ** 2 + (cy - gy) ** 2) ** 0.5, k, gx, gy))
        near = sorted(x for x in ranked if x[0] < within)
        if near and not any(min(cx, near[0][2]) < x < max(cx, near[0][2]) and lo <= max(cy, near[0][3]) and hi >= min(cy, near[0][3]) for x, lo, hi in dividers):
            groups[near[0][1]].append(i)
        else:
            groups.append([i])
    return groups


@pytest.mark.parametrize("seed", range(4))
def test_sequential_groups(seed):
    r = random.Random(seed)
    dims = [(x := r.randrange(600), y := r.randrange(400), x + 20, y + 5) for _ in range(30)]
    cuts = [(r.randrange(600), 0, 400) for _ in range(2)]
    numbers = G.sequential_groups(dims, cuts, 120.0)
    want = groups_by_hand(dims, cuts, 120.0)
    assert [[i for i, n in enumerate(numbers) if n == k] for k in range(max(numbers) + 1)] == want


def test_dimension_groups_cover_all_dimensions(spark, e):
    got = G.dimension_groups(e).collect()
    assert len(got) == e.filter("kind = 'Dimension'").count() and all(r.group_id <= r.handle for r in got)


def test_greedy_distinct_equals_plain_loops(spark, e):
    rows = e.filter("kind = 'BlockReference'").withColumn("score", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    got = {r.handle for r in U.greedy_distinct(rows, 0.10).select("handle").collect()}
    by = defaultdict(list)
    for r in rows.collect():
        by[r.sheet_id].append(r)
    want = set()
    for sheet in by.values():
        kept = []
        for r in sorted(sheet, key=lambda r: (-r.score, r.handle)):
            def over(k, r=r):
                w = max(0.0, min(k.max_x, r.max_x) - max(k.min_x, r.min_x)) * max(0.0, min(k.max_y, r.max_y) - max(k.min_y, r.min_y))
                joint = k.score + r.score - w
                return w / joint if joint > 0 else 0.0
            if all(over(k) < 0.10 for k in kept):
                kept.append(r)
        want |= {r.handle for r in kept}
    assert got == want


def test_unit_packs_equal_components_by_hand(spark, sf_dir, e):
    """Every pack: which units, their totals, and the score."""
    from drawlake.plans.more import pack_units

    units = pack_units(e).collect()
    gaps = {r.sheet_id: r.connect_gap for r in catalog.QUERIES["connect_gaps"](spark, sf_dir).collect()}
    got = sorted((r.sheet_id, r.units, r.geometry, r.meta_hits, round(r.score, 4)) for r in catalog.QUERIES["unit_packs"](spark, sf_dir).collect())
    want = []
    for sheet, gap in gaps.items():
        left = [u for u in units if u.sheet_id == sheet]

        def near(a, b):
            dx, dy = max(0.0, b.min_x - a.max_x, a.min_x - b.max_x), max(0.0, b.min_y - a.max_y, a.min_y - b.max_y)
            middle = ((a.min_x + a.max_x - b.min_x - b.max_x) ** 2 + (a.min_y + a.max_y - b.min_y - b.max_y) ** 2) ** 0.5 / 2
            return max(dx, dy) <= 1.0 or (dx * dx + dy * dy) ** 0.5 <= gap or middle <= gap

        while left:
            pack, edge = [], [left.pop()]
            while edge:
                u = edge.pop()
                pack.append(u)
                edge += [v for v in left if near(u, v)]
                left = [v for v in left if not near(u, v)]
            area = (max(u.max_x for u in pack) - min(u.min_x for u in pack)) * (max(u.max_y for u in pack) - min(u.min_y for u in pack))
            g, m = sum(u.geometry for u in pack), sum(u.meta_hits for u in pack)
            want.append((sheet, len(pack), g, m, round(g * 3 + len(pack) * 5 - m * 25 - area * 0.0005, 4)))
    assert got == sorted(want) and any(n > 2 for _, n, *_ in got)


def test_merged_zones_equal_loops(spark):
    """Which zone each one joins, from boxes that overlap in chains."""
    from drawlake.operators.contours import merged_zones

    r = random.Random(5)
    zones = []
    for i in range(160):
        x, y = r.randrange(60), r.randrange(60)
        zones.append((i % 4, i, r.choice("ab"), float(x), float(y), float(x + r.randrange(0, 30)), float(y + r.randrange(1, 30)), float(r.randrange(9))))
    df = spark.createDataFrame(zones, "sheet_id BIGINT, zone_id BIGINT, zone_kind STRING, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, score DOUBLE")
    want = []
    for sheet, kind in itertools.product(range(4), "ab"):
        grown = []  # id, box, score, parts
        for _, i, _, *box, score in sorted((z for z in zones if z[0] == sheet and z[2] == kind), key=lambda z: (-z[7], z[1])):
            for g in grown:
                k = g[1]
                common = max(0.0, min(k[2], box[2]) - max(k[0], box[0])) * max(0.0, min(k[3], box[3]) - max(k[1], box[1]))
                least = min((k[2] - k[0]) * (k[3] - k[1]), (box[2] - box[0]) * (box[3] - box[1]))
                if least > 0 and common > 0 and common / least >= 0.20:
                    g[1] = [min(k[0], box[0]), min(k[1], box[1]), max(k[2], box[2]), max(k[3], box[3])]
                    g[3] += 1
                    break
            else:
                grown.append([i, box, score, 1])
        want += [(sheet, i, kind, *box, score, parts) for i, box, score, parts in grown]
    assert sorted(tuple(x) for x in merged_zones(df).collect()) == sorted(want)


def test_values_beside_labels_equal_loops(spark):
    from drawlake.operators.drawing import label_neighbours

    r = random.Random(8)
    rows = []
    for i in range(400):
        text = r.choice(["QTY", "Q'TY", "수량", "4 EA", "17", "x 3", "600", "2.5", "THRU", "NOTE", None, "QTY: 9"])
        rows.append((i % 3, i, text, float(r.randrange(500)), float(r.randrange(300)), r.choice([None, 0.0, 2.5, 9.0]), r.choice("mt"), None))
    kinds = {"m": "MetaTable", "t": "TitleBlock"}
    rows = [(*x[:7], kinds[x[6]] if x[1] % 11 else "Geometry") for x in rows] + [(0, 900, "5", None, None, None, "m", "MetaTable")]
    df = spark.createDataFrame(rows, "sheet_id BIGINT, handle BIGINT, text STRING, ax DOUBLE, ay DOUBLE, height DOUBLE, region_id STRING, region_kind STRING")
    number = {"4 EA": 4, "17": 17, "x 3": 3, "600": 600}
    want = []
    for s, label, text, lx, ly, lh, region, kind in rows:
        if text not in ("QTY", "Q'TY", "수량", "QTY: 9") or kind == "Geometry":
            continue
        found = []
        for s2, handle, value, x, y, h, region2, kind2 in rows:
            if s2 != s or region2 != region or handle == label or value not in number or x is None:
                continue
            base, dx, dy = max(lh or 3.5, h or 3.5), x - lx, y - ly
            far = (dx * dx + dy * dy) ** 0.5
            if 0 <= dx <= max(120, base * 35) and abs(dy) <= max(8, base * 1.8):
                near, relation = 0.34, "right"
            elif dy <= 0 and abs(dx) <= max(10, base * 2) and abs(dy) <= max(80, base * 22):
                near, relation = 0.24, "below"
            elif far <= max(16, base * 4.5):
                near, relation = 0.18, "close"
            else:
                continue
            score = min(1.0, 0.52 + {"MetaTable": 0.10, "TitleBlock": 0.06, "Geometry": -0.18}[kind2] + near) - (0.06 if number[value] > 500 else 0)
            found.append((-round(score, 9), far, handle, number[value], relation))
        want += [(s, label, h, q, round(-m, 6), rel, k + 1) for k, (m, _, h, q, rel) in enumerate(sorted(found)[:3])]
    got = [(x.sheet_id, x.label, x.handle, x.quantity, round(x.score, 6), x.relation, x["rank"]) for x in label_neighbours(df).collect()]
    assert sorted(got) == sorted(want) and {x[5] for x in got} == {"right", "below", "close"}


def test_kmeans_of_each_sheet(spark, sf_dir, e):
    """As many clusters as texts, and every entity nearest to the mean of its own cluster."""
    got = {r.handle: r.cluster for r in catalog.QUERIES["kmeans_boxes"](spark, sf_dir).collect()}
    by = defaultdict(list)
    for r in e.collect():
        by[r.sheet_id].append(r)
    for rows in by.values():
        x = [[r.ax, r.ay, r.max_x - r.min_x, r.max_y - r.min_y] for r in rows]
        low, high = [min(c) for c in zip(*x, strict=True)], [max(c) for c in zip(*x, strict=True)]
        x = [[(v - a) / (b - a) if b > a else 0.0 for v, a, b in zip(p, low, high, strict=True)] for p in x]
        groups = defaultdict(list)
        for r, p in zip(rows, x, strict=True):
            groups[got[r.handle]].append(p)
        assert len(groups) <= max(1, sum(r.kind in ("Text", "MText") for r in rows))
        means = {g: [sum(c) / len(ps) for c in zip(*ps, strict=True)] for g, ps in groups.items()}
        apart = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
        for r, p in zip(rows, x, strict=True):
            assert apart(p, means[got[r.handle]]) <= min(apart(p, m) for m in means.values()) + 1e-9


def test_analysis_fields(spark, sf_dir):
    got = catalog.QUERIES["analysis_fields"](spark, sf_dir).collect()
    quantity = {r.sheet_id: r.status for r in catalog.QUERIES["quantity_decision"](spark, sf_dir).collect()}
    assert got and {r.sheet_id for r in got} <= set(quantity)


def test_components_by_key_equal_plain_ones(spark):
    r = random.Random(2)
    edges = [(k, r.randrange(40), r.randrange(40)) for k in (1, 2) for _ in range(25)]
    df = spark.createDataFrame(edges, "k BIGINT, u BIGINT, v BIGINT")
    ways = [{(x.k, x.node): x.component for x in components(df, "k", local=n).collect()} for n in (0, 25, 1 << 18)]
    assert ways[0] == ways[1] == ways[2]
    got = ways[0]
    root = {(k, v): v for k, a, b in edges for v in (a, b)}
    for _ in range(60):
        for k, a, b in edges:
            root[k, a] = root[k, b] = min(root[k, a], root[k, b])
    linked = {(k, v) for k, a, b in edges if a != b for v in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_shared_folder_needs_a_setting_on_a_cluster():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session(), "x")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, 1.0, 2.0), (1, 6, 3.0, 4.0), (2, 7, 5.0, 6.0)], "sheet_id BIGINT, handle BIGINT, min_x DOUBLE, min_y DOUBLE")
    path = str(tmp_path / "json")
    sinks.write_json(rows, path)
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(path).collect())) == sorted(map(tuple, rows.collect()))
    docs = [json.loads(r.document) for r in sinks.part_list(rows, "demo").collect()]
    assert sorted(d["part_count"] for d in docs) == [1, 2] and all(len(d["parts"]) == d["part_count"] for d in docs if "parts" in d)


def test_capture_plans_and_reports(spark, tmp_path):
    tiles = spark.createDataFrame([(1, 0, 2), (1, 1, 0)], "sheet_id BIGINT, row INT, col INT")
    got = {r.id: (list(r.min), list(r.max)) for r in sinks.capture_plan(tiles).collect()}
    assert got == {"R0_C2": ([320.0, 0.0], [520.0, 200.0]), "R1_C0": ([0.0, 160.0], [200.0, 360.0])}
    path = str(tmp_path / "report")
    sinks.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "sheet_id BIGINT, line STRING"), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["a", "b"]


def test_sheets_as_a_stream(spark, tmp_path):
    from drawlake.operators.spatial import box_of
    from drawlake.streaming.sheets import run_sheets

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 3.0), (1, -1.0, 1.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 7.0)], "sheet_id BIGINT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    run_sheets(stream, lambda b: box_of(b, "sheet_id"), out, str(tmp_path / "check")).awaitTermination()
    got = {r.sheet_id: (r.min_x, r.max_y, r.n) for r in spark.read.parquet(out).collect()}
    assert got == {1: (-1.0, 3.0, 2), 2: (5.0, 7.0, 1)}


def test_analysis_takes_other_parts(spark, e):
    from drawlake.operators import drawing as D
    from drawlake.plans.analyze import Analysis

    parts = Analysis(detect=lambda x: D.band_regions(x).filter("region_kind = 'Geometry'"), extract=(lambda x: x.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n")),))
    found = parts.run(e)
    assert {r.region_kind for r in found["regions"].collect()} == {"Geometry"}
    assert found["entities"].count() == e.count() and found["fields"].columns == ["sheet_id", "n"]


def test_trees_deeper_than_the_limit_are_an_error(spark):
    from drawlake.sources.drawings import expand_blocks, leaf_boxes

    box = {"id": "a", "min_x": 0.0, "min_y": 0.0, "max_x": 1.0, "max_y": 1.0}
    leaf = "struct<id:string,min_x:double,min_y:double,max_x:double,max_y:double"
    schema = f"tree_id BIGINT, node {leaf},children:array<{leaf},children:array<{leaf}>>>>>"
    node = box | {"children": [box | {"id": "b", "children": [box | {"id": "c"}]}, box | {"id": "d", "children": []}]}
    trees = spark.createDataFrame([(1, node)], schema)
    assert sorted(r.id for r in leaf_boxes(trees).collect()) == ["c", "d"]
    with pytest.raises(ValueError, match="nested deeper"):
        leaf_boxes(trees, 2)
    chain = spark.createDataFrame([(i, i + 1, 1.0, 0.0) for i in range(6)], "parent BIGINT, child BIGINT, dx DOUBLE, dy DOUBLE")
    roots = spark.createDataFrame([(0,)], "node BIGINT")
    assert expand_blocks(chain, roots).count() == 7
    with pytest.raises(ValueError, match="nested deeper"):
        expand_blocks(chain, roots, 3)


@pytest.mark.parametrize("seed", range(4))
def test_zones_merge_in_order(seed):
    from drawlake.operators.contours import merge_zone_list

    r = random.Random(seed)
    zones = [{"sheet_id": 1, "zone_id": i, "zone_kind": r.choice("ab"), "min_x": (x := r.random() * 50), "min_y": (y := r.random() * 50), "max_x": x + 5 + r.random() * 20, "max_y": y + 5 + r.random() * 20, "score": r.random()} for i in range(20)]
    kept = merge_zone_list([dict(z) for z in zones])
    assert sum(k["parts"] for k in kept) == len(zones)
    # Every zone lies in one kept zone of its kind at least, and each kept zone scores as its best part.
    for z in zones:
        around = [k for k in kept if k["zone_kind"] == z["zone_kind"] and k["min_x"] <= z["min_x"] and k["max_x"] >= z["max_x"] and k["min_y"] <= z["min_y"] and k["max_y"] >= z["max_y"]]
        assert around
    best = {kind: max(z["score"] for z in zones if z["zone_kind"] == kind) for kind in "ab"}
    assert {kind: max(k["score"] for k in kept if k["zone_kind"] == kind) for kind in "ab"} == best
    assert [(k["zone_kind"], -k["score"]) for k in kept] == sorted((k["zone_kind"], -k["score"]) for k in kept)


def test_merged_zones_query(spark, sf_dir, e):
    got = catalog.QUERIES["merged_zones"](spark, sf_dir).collect()
    assert sum(r.parts for r in got) == e.filter("kind = 'BlockReference'").count()


def test_svg_centres(spark):
    from drawlake.sources.drawings import svg_centres

    text = '<svg><rect x="10" y="20" width="4" height="6"/><circle cx="5" cy="-7.5" r="2"/>\n<line x1="0" y1="2" x2="10" y2="4" /><ellipse cx="1" cy="2" rx="3" ry="4"/><rect x="1"/><path d="M 0 0"/></svg>'
    got = sorted(tuple(r) for r in svg_centres(spark.createDataFrame([(x,) for x in text.split("\n")], "value STRING")).collect())
    assert got == [("circle", 5.0, -7.5), ("ellipse", 1.0, 2.0), ("line", 5.0, 3.0), ("rect", 12.0, 23.0)]


def test_distinct_zones_equal_loops(spark, e):
    from drawlake.operators.zones import ZoneOptions, distinct_zones
    from drawlake.plans.more import block_zones

    zones, members = block_zones(e)
    opt = ZoneOptions(boxes=0.2, members=0.4)
    held = defaultdict(set)
    for m in members.collect():
        held[m.sheet_id, m.zone_id].add(m.handle)
    by = defaultdict(list)
    for z in zones.collect():
        by[z.sheet_id].append(z)
    want, dropped = [], set()
    for sheet, rows in by.items():
        kept = []
        for z in sorted(rows, key=lambda z: (-z.score, z.zone_id)):
            why = None
            for k in kept:
                w, h = min(k.max_x, z.max_x) - max(k.min_x, z.min_x), min(k.max_y, z.max_y) - max(k.min_y, z.min_y)
                common = max(0.0, w) * max(0.0, h)
                joint = sum((x.max_x - x.min_x) * (x.max_y - x.min_y) for x in (k, z)) - common
                a, b = held[sheet, k.zone_id], held[sheet, z.zone_id]
                if common / joint >= opt.boxes:
                    why = "box"
                elif a and b and len(a & b) / min(len(a), len(b)) >= opt.members:
                    why = why or "members"
            if why:
                dropped.add(why)
            else:
                kept.append(z)
        want += [(sheet, z.zone_id) for z in kept]
    assert sorted((z.sheet_id, z.zone_id) for z in distinct_zones(zones, members, opt).collect()) == sorted(want)
    assert dropped == {"box", "members"}
    assert distinct_zones(zones.limit(0), members).count() == 0
    bare = zones.withColumns({"min_x": F.lit(None).cast("double"), "score": F.lit(None).cast("bigint")})
    assert distinct_zones(bare, members.limit(0)).count() == zones.count()
