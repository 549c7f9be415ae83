"""Clean-up of geometry clusters: frames and noise go, fragments and aligned parts join."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.operators.spatial import box_join, connected, prefixed

BOX = ("min_x", "min_y", "max_x", "max_y")


@dataclass(frozen=True)
class PreFilterOptions:
    frame_share: float = 0.75  # of the sheet's width and height
    frame_most_geometry: int = 4
    frame_contains: int = 6
    frame_huge_area: float = 50_000.0
    contain_tolerance: float = 2.0
    tiny_geometry: int = 2
    tiny_side: float = 6.0
    tiny_area: float = 25.0
    merge_gap: float = 8.0
    band_overlap: float = 2.0
    round_gap: float = 1.5  # times the merge gap, if either is round
    loose_gap: float = 1.5  # times the merge gap, if both are small together
    loose_geometry: int = 20
    fragment_geometry: int = 6
    fragment_side: float = 12.0
    fragment_area: float = 100.0
    host_gap: float = 6.0
    column_overlap: float = 0.90
    column_gap: float = 40.0
    column_shift: float = 12.0
    column_area: float = 150.0


def verdicts(clusters: DataFrame, sheets: DataFrame, opt: PreFilterOptions = PreFilterOptions()) -> DataFrame:
    """Adds verdict: outer_frame (sparse and nearly as large as the sheet, or around many
    others, or huge), tiny_noise (without round geometry) or kept. clusters: sheet_id,
    cluster_id, box, geometry, rounds, polylines, lines."""
    box = clusters.select("sheet_id", "cluster_id", *BOX)
    a, b = B.box("a_"), B.box("b_")
    held = box_join(box, box, opt.contain_tolerance, 128.0).filter((F.col("a_cluster_id") != F.col("b_cluster_id")) & B.contains_box(a, b, opt.contain_tolerance))
    n = held.groupBy("sheet_id", F.col("a_cluster_id").alias("cluster_id")).agg(F.count(F.lit(1)).alias("inside"))
    x = clusters.join(n, ["sheet_id", "cluster_id"], "left").na.fill(0, ["inside"]).join(prefixed(sheets.select("sheet_id", *BOX), "s_"), "sheet_id")
    c, o, s = F.col, B.box(), B.box("s_")
    sparse = (c("geometry") <= opt.frame_most_geometry) & ((c("polylines") >= 1) | (c("lines") >= 4))
    wide = (o.width >= s.width * opt.frame_share) & (o.height >= s.height * opt.frame_share)
    huge = (c("geometry") <= 2) & (o.area >= opt.frame_huge_area) & ((c("polylines") >= 1) | (c("lines") >= 1))
    frame = (c("geometry") > 0) & ((sparse & (wide | (c("inside") >= opt.frame_contains))) | huge)
    small = (c("geometry") <= opt.tiny_geometry) & (((o.width <= opt.tiny_side) & (o.height <= opt.tiny_side)) | (o.area <= opt.tiny_area))
    flat = (c("geometry") == 1) & ((F.abs(o.width) <= 1e-9) | (F.abs(o.height) <= 1e-9))
    verdict = F.when(frame, "outer_frame").when((small | flat) & (c("rounds") == 0), "tiny_noise").otherwise("kept")
    return x.select(*clusters.columns, "inside", verdict.alias("verdict"))


def merge_edges(clusters: DataFrame, opt: PreFilterOptions = PreFilterOptions()) -> DataFrame:
    """Pairs of clusters in one band whose gap is small; round or small ones may be farther."""
    reach = opt.merge_gap * max(opt.round_gap, opt.loose_gap)
    x = clusters.select("sheet_id", "cluster_id", *BOX, "geometry", "rounds")
    a, b = B.box("a_"), B.box("b_")
    pairs = box_join(x, x, reach, 128.0).filter("a_cluster_id < b_cluster_id")
    row = B.axis_overlap(a.min_y, a.max_y, b.min_y, b.max_y) >= opt.band_overlap
    column = B.axis_overlap(a.min_x, a.max_x, b.min_x, b.max_x) >= opt.band_overlap
    within = lambda gap: (row & (B.gap_x(a, b) <= gap)) | (column & (B.gap_y(a, b) <= gap))
    round_one = (F.col("a_rounds") > 0) | (F.col("b_rounds") > 0)
    few = F.col("a_geometry") + F.col("b_geometry") <= opt.loose_geometry
    ok = within(opt.merge_gap) | (round_one & within(opt.merge_gap * opt.round_gap)) | (few & within(opt.merge_gap * opt.loose_gap))
    return pairs.filter(ok).select("sheet_id", F.col("a_cluster_id").alias("a"), F.col("b_cluster_id").alias("b"))


def merged(clusters: DataFrame, opt: PreFilterOptions = PreFilterOptions()) -> DataFrame:
    """Clusters united along merge_edges: sheet_id, cluster_id (the smallest), box, geometry, rounds, parts."""
    found = connected(clusters.withColumnRenamed("cluster_id", "handle"), merge_edges(clusters, opt))
    return found.groupBy("sheet_id", F.col("component").alias("cluster_id")).agg(
        *[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in BOX], F.sum("geometry").alias("geometry"), F.sum("rounds").alias("rounds"), F.count(F.lit(1)).alias("parts")
    )


MERGED = "sheet_id BIGINT, cluster_id BIGINT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, geometry BIGINT, rounds BIGINT, parts BIGINT"


def _joins(a: dict, b: dict, opt: PreFilterOptions) -> bool:
    """Whether two clusters can become one: by a band, with a gap that is small unless they are few."""
    few = a["geometry"] + b["geometry"] <= opt.loose_geometry
    gap = opt.merge_gap * (1000.0 if few else opt.round_gap if a["rounds"] or b["rounds"] else 1.0)
    for near, band in (("x", "y"), ("y", "x")):
        overlap = max(0.0, min(a[f"max_{band}"], b[f"max_{band}"]) - max(a[f"min_{band}"], b[f"min_{band}"]))
        if overlap >= opt.band_overlap and max(0.0, b[f"min_{near}"] - a[f"max_{near}"], a[f"min_{near}"] - b[f"max_{near}"]) <= gap:
            return True
    return False


def _union(a: dict, b: dict) -> dict:
    out = {"cluster_id": min(a["cluster_id"], b["cluster_id"])}
    out |= {c: (min if c.startswith("min") else max)(a[c], b[c]) for c in BOX}
    return out | {c: a[c] + b[c] for c in ("geometry", "rounds", "parts")}


def _area(c: dict) -> float:
    return (c["max_x"] - c["min_x"]) * (c["max_y"] - c["min_y"])


def _order(c: dict) -> tuple:
    return -_area(c), -c["geometry"], c["cluster_id"]


def absorb_and_align(rows: list[dict], opt: PreFilterOptions = PreFilterOptions()) -> list[dict]:
    """Small fragments join the nearest host that is as large, then clusters that stand in one
    column join, one pair at a time until none is left. The order (area, geometry, id) matters."""
    work = sorted(rows, key=_order)

    def fragment(c: dict) -> bool:
        w, h = c["max_x"] - c["min_x"], c["max_y"] - c["min_y"]
        return not c["rounds"] and c["geometry"] <= opt.fragment_geometry and (w <= opt.fragment_side or h <= opt.fragment_side) and w * h <= opt.fragment_area

    def gap(a: dict, b: dict) -> float:
        dx, dy = (max(0.0, b[f"min_{k}"] - a[f"max_{k}"], a[f"min_{k}"] - b[f"max_{k}"]) for k in "xy")
        return (dx * dx + dy * dy) ** 0.5

    again = True
    while again and len(work) > 1:
        again = False
        for i, c in enumerate(work):
            hosts = [(gap(c, h), j) for j, h in enumerate(work) if j != i and h["geometry"] >= c["geometry"]] if fragment(c) else []
            hosts = [x for x in hosts if x[0] <= opt.host_gap]
            if hosts and _joins(work[j := min(hosts)[1]], c, opt):
                work[j] = _union(work[j], c)
                del work[i]
                again = True
                break

    def aligned(a: dict, b: dict) -> bool:
        overlap, least = min(a["max_x"], b["max_x"]) - max(a["min_x"], b["min_x"]), min(a["max_x"] - a["min_x"], b["max_x"] - b["min_x"])
        return (
            min(_area(a), _area(b)) >= opt.column_area and overlap > 0 and least > 0 and overlap / least >= opt.column_overlap
            and abs(a["min_x"] + a["max_x"] - b["min_x"] - b["max_x"]) * 0.5 <= opt.column_shift and max(0.0, b["min_y"] - a["max_y"], a["min_y"] - b["max_y"]) <= opt.column_gap
        )

    work.sort(key=_order)
    again = True
    while again and len(work) > 1:
        again = False
        for i, j in ((i, j) for i in range(len(work)) for j in range(i + 1, len(work))):
            if aligned(work[i], work[j]) and _joins(work[i], work[j], opt):
                work[i] = _union(work[i], work[j])
                del work[j]
                again = True
                break
    return sorted(work, key=_order)


def pre_filtered(clusters: DataFrame, sheets: DataFrame, opt: PreFilterOptions = PreFilterOptions()) -> DataFrame:
    """Drops frames and noise, unites what belongs together, absorbs fragments and joins
    columns. The last two go on pair by pair, so they run a sheet at a time over its few
    clusters; the rest are joins by grid cell."""
    kept = verdicts(clusters, sheets, opt).filter("verdict = 'kept'").select(*clusters.columns)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        done = absorb_and_align(rows.drop(columns="sheet_id").to_dict("records"), opt)
        return pd.DataFrame([{"sheet_id": key[0], **c} for c in done])[[c.split()[0] for c in MERGED.split(", ")]]

    return merged(kept, opt).groupBy("sheet_id").applyInPandas(run, MERGED)
