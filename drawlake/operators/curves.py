"""Segments, sample points, closed loops and contour links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.operators.spatial import best_per, box_join

SEGMENT = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def _segment(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def segments(e: DataFrame, chords: int = 16) -> DataFrame:
    """Straight segments of entities: lines as their diagonal, polylines as their outline,
    round ones as chords of the ellipse in their box. Adds seq and x0, y0, x1, y1."""
    b = B.box()
    turn = lambda i: i * (2.0 * np.pi / chords)
    at_x = lambda i: b.center_x + b.width * 0.5 * F.cos(turn(i))
    at_y = lambda i: b.center_y + b.height * 0.5 * F.sin(turn(i))
    outline = F.array(
        _segment(b.min_x, b.min_y, b.max_x, b.min_y), _segment(b.max_x, b.min_y, b.max_x, b.max_y),
        _segment(b.max_x, b.max_y, b.min_x, b.max_y), _segment(b.min_x, b.max_y, b.min_x, b.min_y),
    )
    ring = F.transform(F.sequence(F.lit(0), F.lit(chords - 1)), lambda i: _segment(at_x(i), at_y(i), at_x(i + 1), at_y(i + 1)))
    kind = F.col("kind")
    parts = F.when(kind == "Line", F.array(_segment(b.min_x, b.min_y, b.max_x, b.max_y))).when(kind == "Polyline", outline).when(kind.isin("Circle", "Arc", "Ellipse"), ring)
    out = e.filter(parts.isNotNull()).select("sheet_id", "handle", "kind", F.posexplode(parts).alias("seq", "s"))
    return out.select("sheet_id", "handle", "kind", "seq", "s.x0", "s.y0", "s.x1", "s.y1")


def sample_points(lines: DataFrame, step: float) -> DataFrame:
    """Points along segments, at most `step` apart, ends included."""
    length = B.point_distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    n = F.greatest(F.lit(1), F.ceil(F.round(length / step, 9))).cast("int")
    rows = lines.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    t = F.col("k") / F.col("n")
    return rows.select("sheet_id", "handle", "seq", "k", (F.col("x0") + (F.col("x1") - F.col("x0")) * t).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * t).alias("y"))


def end_links(lines: DataFrame, tolerance: float = 0.5, most: int = 8) -> DataFrame:
    """Pairs of segments of different entities with ends within the tolerance: the `most`
    closest ones of each segment, in its order of distance, handle and seq."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y"))))
    p = lines.select("sheet_id", "handle", "seq", ends.alias("p")).select("sheet_id", "handle", "seq", "p.end", F.col("p.x").alias("min_x"), F.col("p.y").alias("min_y"), F.col("p.x").alias("max_x"), F.col("p.y").alias("max_y"))
    near = box_join(p, p, tolerance, 16.0).withColumn("distance", B.point_distance(F.col("a_min_x"), F.col("a_min_y"), F.col("b_min_x"), F.col("b_min_y")))
    near = near.filter((F.col("a_handle") != F.col("b_handle")) & (F.col("distance") <= tolerance))
    pairs = near.groupBy("sheet_id", "a_handle", "a_seq", "b_handle", "b_seq").agg(F.min("distance").alias("distance"))
    return best_per(pairs, ["sheet_id", "a_handle", "a_seq"], [F.col("distance"), F.col("b_handle"), F.col("b_seq")], most)


def trace_loops(lines: list[tuple[int, float, float, float, float]], tolerance: float) -> list[tuple[list[int], float]]:
    """Closed loops of one sheet: ends snap to the first node within the tolerance, and each
    unused segment in order starts a walk that takes the first unused neighbour. Returns the
    segment numbers and the enclosed area of each loop."""
    nodes: list[tuple[float, float]] = []
    cells: dict[tuple[int, int], list[int]] = {}  # nodes by cell of the tolerance

    def node(x: float, y: float) -> int:
        cx, cy = int(x // tolerance), int(y // tolerance)
        near = (i for dx in (-1, 0, 1) for dy in (-1, 0, 1) for i in cells.get((cx + dx, cy + dy), ()))
        first = min((i for i in near if (nodes[i][0] - x) ** 2 + (nodes[i][1] - y) ** 2 <= tolerance**2), default=None)
        if first is not None:
            return first
        nodes.append((x, y))
        cells.setdefault((cx, cy), []).append(len(nodes) - 1)
        return len(nodes) - 1

    ends = [(node(x0, y0), node(x1, y1)) for _, x0, y0, x1, y1 in lines]
    at: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(ends):
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    used: set[int] = set()
    out = []
    for start, (a, b) in enumerate(ends):
        if start in used or a == b:
            continue
        path, corners, here = [start], [a, b], b
        used.add(start)
        while here != a:
            step = next((i for i in at[here] if i not in used and ends[i][0] != ends[i][1]), None)
            if step is None:
                break
            used.add(step)
            here = ends[step][1] if ends[step][0] == here else ends[step][0]
            path.append(step)
            corners.append(here)
        if here == a and len(path) >= 3:
            p = np.array([nodes[i] for i in corners[:-1]])
            q = np.roll(p, -1, axis=0)
            out.append(([lines[i][0] for i in path], float(abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2)))
    return out


LOOP = "sheet_id BIGINT, loop INT, segments INT, handles ARRAY<BIGINT>, area DOUBLE"


def closed_loops(lines: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Loops of every sheet. The walk is sequential, so a sheet's segments meet in one task;
    they are ordered by handle and seq."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["handle", "seq"], kind="stable")
        found = trace_loops(list(zip(rows["handle"], rows["x0"], rows["y0"], rows["x1"], rows["y1"], strict=True)), tolerance)
        data = [(int(key[0]), i, len(h), sorted(set(map(int, h))), a) for i, (h, a) in enumerate(found)]
        return pd.DataFrame(data, columns=["sheet_id", "loop", "segments", "handles", "area"])

    return lines.groupBy("sheet_id").applyInPandas(run, LOOP)


def greedy_distinct(rows: DataFrame, most_overlap: float = 0.75) -> DataFrame:
    """Boxes of each sheet by falling score, without those whose overlap over union with a
    box kept before reaches the limit. Ties go to the smallest handle."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "handle"], ascending=[False, True], kind="stable")
        x0, y0, x1, y1 = (g[c].to_numpy(float) for c in ("min_x", "min_y", "max_x", "max_y"))
        area = (x1 - x0) * (y1 - y0)
        kept = np.empty(0, np.int64)
        for i in range(len(g)):
            w = np.minimum(x1[i], x1[kept]) - np.maximum(x0[i], x0[kept])
            h = np.minimum(y1[i], y1[kept]) - np.maximum(y0[i], y0[kept])
            common = np.maximum(0.0, w) * np.maximum(0.0, h)
            joint = area[i] + area[kept] - common
            if not ((joint > 0) & (common >= most_overlap * joint)).any():
                kept = np.append(kept, i)
        return pd.DataFrame({"sheet_id": int(key[0]), "handle": g["handle"].to_numpy()[kept]})

    return rows.select("sheet_id", "handle", "score", "min_x", "min_y", "max_x", "max_y").groupBy("sheet_id").applyInPandas(run, "sheet_id BIGINT, handle BIGINT")


def lloyd(x: np.ndarray, k: int, rounds: int = 50, seed: int = 42) -> np.ndarray:
    """Cluster of each row: k-means from seeds that are far apart, until nothing moves. Each
    row goes to the nearest centre, the first one of equals."""
    k = max(1, min(k, len(np.unique(x, axis=0))))
    r = np.random.RandomState(seed)
    centres = x[[r.randint(len(x))]]
    while len(centres) < k:  # the row that is farthest from all centres
        far = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, x[int(far.argmax())]])
    label = np.full(len(x), -1)
    for _ in range(rounds):
        now = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (now == label).all():
            break
        label = now
        centres = np.array([x[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)])
    return label


def sheet_clusters(e: DataFrame) -> DataFrame:
    """sheet_id, handle, cluster: k-means on centre and size, each scaled to 0 to 1 in its sheet,
    with as many clusters as the sheet has texts, or half its polylines if it has none. A sheet
    is a model of its own, so sheets run side by side, one to a task."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("handle")
        x = g[["ax", "ay", "w", "h"]].to_numpy(float)
        span = x.max(axis=0) - x.min(axis=0)
        x = (x - x.min(axis=0)) / np.where(span > 0, span, 1.0)
        k = int(g["kind"].isin(["Text", "MText"]).sum()) or int((g["kind"] == "Polyline").sum()) // 2
        return pd.DataFrame({"sheet_id": key[0], "handle": g["handle"].to_numpy(), "cluster": lloyd(x, k)})

    rows = e.filter("min_x IS NOT NULL").select("sheet_id", "handle", "kind", "ax", "ay", (F.col("max_x") - F.col("min_x")).alias("w"), (F.col("max_y") - F.col("min_y")).alias("h"))
    return rows.groupBy("sheet_id").applyInPandas(run, "sheet_id BIGINT, handle BIGINT, cluster INT")
