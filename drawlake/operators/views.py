"""View candidates, packs of views, content regions, relations of views and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.functions import boxes as B
from drawlake.functions import kinds as K
from drawlake.operators import drawing as D
from drawlake.operators.spatial import best_per, box_of, prefixed
from drawlake.storage import written

BOX = ("min_x", "min_y", "max_x", "max_y")


def cluster_members(e: DataFrame) -> DataFrame:
    """Seeds of every geometry cluster with the texts and dimensions attached to it:
    sheet_id, cluster_id, kind, box."""
    seeds = D.geometry_clusters(e)
    clusters = box_of(seeds, "sheet_id", "cluster_id")
    attached = D.attach_nearest(e, clusters).filter("cluster_id IS NOT NULL").select("sheet_id", "handle", "cluster_id")
    later = e.select("sheet_id", "handle", "kind", *BOX).join(attached, ["sheet_id", "handle"])
    columns = ("sheet_id", "cluster_id", "kind", *BOX)
    return seeds.select(*columns).unionByName(later.select(*columns))


def cluster_totals(members: DataFrame) -> DataFrame:
    """Total box and counts of each cluster."""
    kind = F.col("kind")
    return members.groupBy("sheet_id", "cluster_id").agg(
        *[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in BOX], F.count_if(K.is_geometry(kind)).alias("geometry"), F.count_if(K.is_round(kind)).alias("rounds"),
        F.count_if(K.is_dimension(kind)).alias("dimensions"), F.count_if(K.is_text(kind)).alias("texts"),
        F.count_if(kind == "Polyline").alias("polylines"), F.count_if(kind == "Line").alias("lines"),
    )


def view_candidates(clusters: DataFrame, sheets: DataFrame) -> DataFrame:
    """Adds score, round_heavy and slender: how much a cluster looks like a view."""
    x = clusters.join(prefixed(sheets.select("sheet_id", *BOX), "s_"), "sheet_id")
    c, b, s = F.col, B.box(), B.box("s_")
    g = c("geometry")
    heavy = (c("rounds") > 0) & (c("rounds") >= F.greatest(F.lit(1), F.floor(g / 3)))
    aspect = F.when(F.least(b.width, b.height) <= 0, F.when(F.greatest(b.width, b.height) <= 0, 1.0).otherwise(9999.0)).otherwise(F.greatest(b.width, b.height) / F.least(b.width, b.height))
    margin = F.least(s.width, s.height) * 0.08
    inside = B.contains_box(B.inflated(s, -margin), b)
    off = F.when(s.diagonal > 0, B.point_distance(b.center_x, b.center_y, s.center_x, s.center_y) / s.diagonal).otherwise(1.0)
    share = F.when(s.area > 0, b.area / s.area).otherwise(0.0)
    score = (
        F.when(g >= 3, 0.22).when(g == 2, 0.12).when(g == 1, 0.05).otherwise(0.0) + F.when(heavy, 0.18).when(c("rounds") > 0, 0.10).otherwise(0.0)
        + F.least(F.lit(0.18), c("dimensions") * 0.06) + F.when((c("texts") > 0) & (c("texts") <= g), 0.05).when(c("texts") > g * 2, -0.10).otherwise(0.0)
        + F.when(inside, 0.12).when(off <= 0.22, 0.06).when(off >= 0.45, -0.08).otherwise(0.0) + F.when(aspect >= 18.0, -0.20).when(aspect >= 10.0, -0.08).otherwise(0.0)
        + F.when(share >= 0.55, -0.18).when(share <= 0.00008, -0.08).otherwise(0.05) + F.when((g >= 2) & (c("texts") <= g + 2), 0.05).otherwise(0.0)
    )
    return x.select(*clusters.columns, F.round(B.clamp01(score), 9).alias("score"), heavy.alias("round_heavy"), (aspect >= 10.0).alias("slender"))


def view_packs(candidates: DataFrame, sheets: DataFrame, most: int = 8) -> DataFrame:
    """Sets of two and three of a sheet's best candidates that overlap little and do not cover
    the sheet, scored by their relations: sheet_id, a, b, c (null in pairs), box, geometry, score."""
    order = [F.col("score").desc(), F.col("geometry").desc(), F.col("cluster_id")]
    rank = F.row_number().over(W.partitionBy("sheet_id").orderBy(*order))
    top = candidates.filter("score >= 0.38").withColumn("k", rank).filter(F.col("k") <= most)
    keep = ("k", "cluster_id", *BOX, "geometry", "texts", "score", "round_heavy", "slender")
    one = lambda p: top.select("sheet_id", *[F.col(c).alias(p + c) for c in keep])
    s = prefixed(sheets.select("sheet_id", *BOX), "s_")
    sb, a, b = B.box("s_"), B.box("a_"), B.box("b_")
    tolerance = F.least(sb.width, sb.height) * 0.10

    def span(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
        least = F.least(hi - lo, hi2 - lo2)
        return F.when(least > 0, B.axis_overlap(lo, hi, lo2, hi2) / least).otherwise(0.0)

    far = B.box_distance(a, b) > sb.diagonal * 0.42
    flat = ~far & ((F.abs(a.center_y - b.center_y) <= tolerance) | (span(a.min_y, a.max_y, b.min_y, b.max_y) >= 0.28))
    upright = ~far & ((F.abs(a.center_x - b.center_x) <= tolerance) | (span(a.min_x, a.max_x, b.min_x, b.max_x) >= 0.28))
    part = F.when(far, -0.08).otherwise(F.when(flat | upright, 0.10).otherwise(0.0) + F.when(flat, 0.05).otherwise(0.0) + F.when(upright, 0.05).otherwise(0.0))
    pairs = one("a_").join(one("b_"), "sheet_id").filter("a_k < b_k").join(s, "sheet_id").filter(B.overlap_of_smaller(a, b) <= 0.35)
    pairs = pairs.withColumn("flat", flat).withColumn("upright", upright).withColumn("part", part)
    disc = (F.col("a_round_heavy") & F.col("b_slender")) | (F.col("b_round_heavy") & F.col("a_slender"))
    sizes = lambda c, *ps: sum([F.col(f"{p}{c}") for p in ps[1:]], F.col(f"{ps[0]}{c}"))

    def scored(rows: DataFrame, joint: B.Box, base: Column, ps: tuple[str, ...]) -> DataFrame:
        inside = B.contains_box(B.inflated(sb, -(F.least(sb.width, sb.height) * 0.06)), joint)
        texts, geometry = sizes("texts", *ps), sizes("geometry", *ps)
        score = sizes("score", *ps) / len(ps) * 0.45 + base + F.when(inside, 0.08).otherwise(0.0) - F.when(texts > geometry * 2, 0.12).otherwise(0.0)
        third = F.col("c_cluster_id") if "c_" in ps else F.lit(None).cast("bigint")
        return rows.filter(F.when(sb.area > 0, joint.area / sb.area).otherwise(0.0) <= 0.72).select(
            "sheet_id", F.col("a_cluster_id").alias("a"), F.col("b_cluster_id").alias("b"), third.alias("c"), *[v.alias(n) for n, v in zip(BOX, joint, strict=True)],
            geometry.alias("geometry"), F.round(B.clamp01(score), 9).alias("score"),
        )

    two = scored(pairs, B.union(a, b), F.col("part") + F.when(disc, 0.16).when(F.col("flat") | F.col("upright"), 0.06).otherwise(0.0), ("a_", "b_"))
    edge = lambda p, q: pairs.select("sheet_id", F.col("a_k").alias(f"{p}k"), F.col("b_k").alias(f"{q}k"), *[F.col(n).alias(n + p + q) for n in ("flat", "upright", "part")])
    rows = pairs.join(one("c_"), "sheet_id").filter("b_k < c_k").join(edge("b_", "c_"), ["sheet_id", "b_k", "c_k"]).join(edge("a_", "c_"), ["sheet_id", "a_k", "c_k"])
    flats, ups = [F.col("flat"), F.col("flatb_c_"), F.col("flata_c_")], [F.col("upright"), F.col("uprightb_c_"), F.col("uprighta_c_")]
    good = sum([F.when(f | u, 1).otherwise(0) for f, u in zip(flats, ups, strict=True)], F.lit(0))
    mixed = (flats[0] | flats[1] | flats[2]) & (ups[0] | ups[1] | ups[2])
    base = F.col("part") + F.col("partb_c_") + F.col("parta_c_") + 0.14 + F.when(mixed, 0.10).otherwise(0.0) + F.when(good >= 2, 0.06).otherwise(0.0)
    three = scored(rows, B.union(B.union(a, b), B.box("c_")), base, ("a_", "b_", "c_"))
    return two.unionByName(three).filter("score >= 0.42")


def best_pack(packs: DataFrame) -> DataFrame:
    views = F.when(F.col("c").isNull(), 2).otherwise(3)
    return best_per(packs, ["sheet_id"], [F.col("score").desc(), views.desc(), F.col("geometry").desc(), F.col("a"), F.col("b"), F.col("c")])


#: Words that speak for a band of metadata.
BAND_WORDS = ("QTY", "Q'TY", "MAT", "MATERIAL", "THK", "SCALE", "SPEC", "DESCRIPTION", "DWG", "TITLE", "UNIT", "REMARK")


def outside_content(e: DataFrame, content: DataFrame) -> DataFrame:
    """Entities of which neither anchor nor box, widened by 1, meets the content widened by 4."""
    x = e.join(prefixed(content.select("sheet_id", *BOX), "k_"), "sheet_id")
    wide = B.inflated(B.box("k_"), 4.0)
    return x.filter(~B.contains_point(wide, F.col("ax"), F.col("ay")) & ~B.intersects(wide, B.box(), 1.0)).select(*e.columns)


def content_regions(e: DataFrame) -> DataFrame:
    """Content first: the best pack of views, else the best candidate, is the geometry and the
    drawing content; a title band at the bottom and a band of metadata at the right follow
    from what lies outside. Sheets without a candidate are one unknown region."""
    sheets = D.sheet_bounds(e)
    candidates = written(view_candidates(cluster_totals(cluster_members(e)), sheets), "view-candidates")  # a row per cluster, used several times
    pack = best_pack(view_packs(candidates, sheets)).select("sheet_id", *BOX, "score", F.lit(0).alias("tier"))
    single = best_per(candidates.filter("geometry > 0"), ["sheet_id"], [F.col("score").desc(), F.col("geometry").desc(), F.col("cluster_id")])
    content = written(best_per(pack.unionByName(single.select("sheet_id", *BOX, "score", F.lit(1).alias("tier"))), ["sheet_id"], [F.col("tier")]), "content-boxes")
    region = lambda name, kind, confidence: (F.lit(name).alias("region_id"), F.lit(kind).alias("region_kind"), *BOX, confidence.alias("confidence"))
    out = content.select("sheet_id", *region("geometry-main", "Geometry", F.col("score"))).unionByName(
        content.select("sheet_id", *region("drawing-content", "DimensionNote", F.greatest(F.lit(0.45), F.col("score") - 0.03)))
    )
    rest = outside_content(e, content)
    b = B.box("s_")
    bands = {"title-bottom": ("TitleBlock", B.Box(b.min_x, b.min_y, b.max_x, b.min_y + b.height * 0.26)), "meta-right": ("MetaTable", B.Box(b.max_x - b.width * 0.24, b.min_y, b.max_x, b.max_y))}
    fields = [
        F.struct(F.lit(n).alias("region_id"), F.lit(k).alias("region_kind"), *[v.alias(f"r_{c}") for c, v in zip(BOX, box, strict=True)]) for n, (k, box) in bands.items()
    ]
    strips = prefixed(sheets.select("sheet_id", *BOX), "s_").join(prefixed(content.select("sheet_id", *BOX), "k_"), "sheet_id").withColumn("r", F.explode(F.array(*fields))).select("sheet_id", *[f"k_{c}" for c in BOX], "r.*")
    strips = strips.filter(B.overlap_of_smaller(B.box("r_"), B.box("k_")) <= 0.30)
    kind, r = F.col("kind"), B.box("r_")
    anchored = B.contains_point(r, F.col("ax"), F.col("ay"))
    counts = rest.join(strips, "sheet_id").groupBy("sheet_id", "region_id", "region_kind", *[f"r_{c}" for c in BOX]).agg(
        F.count_if(K.is_text(kind) & anchored).alias("texts"), F.count_if(K.is_line(kind) & (anchored | B.intersects(r, B.box()))).alias("lines"),
        F.count_if(K.is_text(kind) & anchored & K.mentions(F.upper(F.coalesce("text", F.lit(""))), BAND_WORDS)).alias("words"),
    )
    sure = F.least(F.lit(0.90), F.lit(0.40) + F.col("texts") * 0.05 + F.col("lines") * 0.03 + F.col("words") * 0.10)
    found = counts.filter("texts >= 3 AND (lines >= 2 OR words >= 1)").select("sheet_id", "region_id", "region_kind", *[F.col(f"r_{c}").alias(c) for c in BOX], sure.alias("confidence"))
    unknown = sheets.join(content.select("sheet_id"), "sheet_id", "left_anti").select("sheet_id", *region("whole-sheet-unknown", "Unknown", F.lit(0.15)))
    return out.unionByName(found).unionByName(unknown)


# --- relations ---------------------------------------------------------------------------------


def relations(views: DataFrame) -> DataFrame:
    """All unordered pairs of a sheet's views (every pair is an answer): similarity, alignment,
    position of b as seen from a, and the kind of relation."""
    v = views.select("sheet_id", "view_id", *BOX)
    pairs = prefixed(v, "a_").join(prefixed(v, "b_"), "sheet_id").filter("a_view_id < b_view_id")
    a, b = B.box("a_"), B.box("b_")
    dx, dy = b.center_x - a.center_x, b.center_y - a.center_y
    mean_w, mean_h = (a.width + b.width) * 0.5, (a.height + b.height) * 0.5
    like = lambda p, q: F.when(F.greatest(p, q) > 1e-9, F.least(p, q) / F.greatest(p, q)).otherwise(0.0)
    x = pairs.select(
        "*", dx.alias("dx"), dy.alias("dy"), F.when(mean_w > 1e-9, F.abs(dx) / mean_w).otherwise(0.0).alias("far_x"), F.when(mean_h > 1e-9, F.abs(dy) / mean_h).otherwise(0.0).alias("far_y"),
        ((mean_h > 1e-9) & (F.abs(dy) <= mean_h * 0.35)).alias("in_row"), ((mean_w > 1e-9) & (F.abs(dx) <= mean_w * 0.35)).alias("in_column"),
        like(a.width, b.width).alias("width_like"), like(a.height, b.height).alias("height_like"), like(a.area, b.area).alias("area_like"), B.intersection_area(a, b).alias("common"),
    )
    c = F.col
    part = lambda of: F.when(of.area > 1e-9, c("common") / of.area).otherwise(0.0)
    a_holds = (part(b) >= 0.92) & B.contains_point(a, b.center_x, b.center_y, 1e-6)
    b_holds = (part(a) >= 0.92) & B.contains_point(b, a.center_x, a.center_y, 1e-6)
    ratio = lambda p, q: F.when(q > 1e-9, p / q).otherwise(0.0)
    small = lambda child, parent: (ratio(child.area, parent.area) <= 0.08) & (ratio(child.width, parent.width) <= 0.35) & (ratio(child.height, parent.height) <= 0.35)
    same_size = (c("width_like") >= 0.45) & (c("height_like") >= 0.45) & (c("area_like") >= 0.20)
    near = (c("far_x") <= 4.0) & (c("far_y") <= 4.0)
    kind = (
        F.when(a_holds & small(b, a), "EmbeddedFeature").when(b_holds & small(a, b), "EmbeddedFeature").when(a_holds | b_holds, "ParentChildContainment")
        .when((c("in_row") | c("in_column")) & same_size & near, "ProjectionCandidate").when(c("in_row") | c("in_column") | (c("common") > 1e-6), "WeakNeighbor").otherwise("Unknown")
    )
    side, height = F.when(dx >= 0, "Right").otherwise("Left"), F.when(dy >= 0, "Above").otherwise("Below")
    position = F.when((F.abs(dx) <= 1e-6) & (F.abs(dy) <= 1e-6), "Overlapping").when(c("in_row"), side).when(c("in_column"), height).when(F.abs(dx) >= F.abs(dy), side).otherwise(height)
    return x.withColumn("relation", kind).withColumn("position", position)


def projection_score(position: Column, bonus: Column | float = 0.25) -> Column:
    """How well a view is another one's projection: alike in width above and below, in height
    left and right; far ones lose; bonus is that of two views of geometry. Over the columns of
    `relations`."""
    c = F.col

    def one(aligned: str, main: str, other: str, far: str) -> Column:
        late = F.when(c(far) > 2.5, F.least(F.lit(0.5), (c(far) - 2.5) * 0.2)).otherwise(0.0)
        return F.when(c(aligned), 0.9).otherwise(0.0) + c(main) * 1.2 + c(other) * 0.15 + c("area_like") * 0.10 - late

    score = F.when(position.isin("Above", "Below"), one("in_column", "width_like", "height_like", "far_y")).when(position.isin("Left", "Right"), one("in_row", "height_like", "width_like", "far_x"))
    return F.coalesce(F.greatest(F.lit(0.0), score + bonus), F.lit(0.0))


def projection_links(views: DataFrame) -> DataFrame:
    """For each view its best projection source and where the view lies from it."""
    r = relations(views)
    turned = F.create_map(*[F.lit(x) for x in ("Left", "Right", "Right", "Left", "Above", "Below", "Below", "Above", "Overlapping", "Overlapping")])[F.col("position")]
    forth = r.select("sheet_id", F.col("b_view_id").alias("view_id"), F.col("a_view_id").alias("source_id"), "position", F.round(projection_score(F.col("position")), 9).alias("score"))
    back = r.select("sheet_id", F.col("a_view_id").alias("view_id"), F.col("b_view_id").alias("source_id"), turned.alias("position"), F.round(projection_score(turned), 9).alias("score"))
    return best_per(forth.unionByName(back).filter("score > 0"), ["sheet_id", "view_id"], [F.col("score").desc(), F.col("source_id")])


def anchor_match(a: Column, b: Column) -> Column:
    """1 less the mean distance of a's places to the nearest of b's, both clamped to 0 to 1."""
    clean = lambda x: F.array_distinct(F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))))
    p, q = clean(a), clean(b)
    nearest = F.transform(p, lambda x: F.array_min(F.transform(q, lambda y: F.abs(x - y))))
    mean = F.aggregate(nearest, F.lit(0.0), lambda acc, d: acc + d) / F.size(p)
    return F.when((F.size(p) > 0) & (F.size(q) > 0), B.clamp01(F.lit(1.0) - mean)).otherwise(0.0)


def role_candidates(views: DataFrame) -> DataFrame:
    """Scores of the seven roles of each view, by its strong relations: sheet_id, view_id,
    role, score, rank (ties in the order of the roles)."""
    r = D.view_pairs(views).filter("score >= 0.40")
    strong = lambda way, band: F.count_if((F.col("direction") == way) & (F.col(band) >= 0.45))
    edges = r.groupBy("sheet_id", F.col("source_id").alias("view_id")).agg(
        strong("Above", "x_overlap").alias("above"), strong("Below", "x_overlap").alias("below"), strong("LeftOf", "y_overlap").alias("left"), strong("RightOf", "y_overlap").alias("right")
    )
    b = B.box()
    v = views.select("sheet_id", "view_id", b.width.alias("w"), b.height.alias("h"), b.area.alias("area"))
    v = v.join(views.groupBy("sheet_id").agg(F.max(b.area).alias("most")), "sheet_id").join(edges, ["sheet_id", "view_id"], "left").na.fill(0, ["above", "below", "left", "right"])
    c = F.col
    any_of = lambda n: F.least(F.lit(1.0), n.cast("double"))
    pick = lambda first, second: F.when(c(first) > 0, 0.72).when(c(second) > 0, 0.45).otherwise(0.10)
    front = F.lit(0.45) * (c("area") / F.greatest(F.lit(1e-9), c("most"))) + F.lit(0.20) * any_of(c("above")) + F.lit(0.20) * any_of(c("below")) + F.lit(0.15) * any_of(c("left") + c("right"))
    thin = (c("w") > c("h") * 2.0) | (c("h") > c("w") * 2.0)
    roles = [
        ("Front", front), ("Top", pick("below", "above")), ("Bottom", pick("above", "below")), ("Left", pick("right", "left")), ("Right", pick("left", "right")),
        ("Section", F.when(thin, 0.40).otherwise(0.15)), ("Detail", F.when(c("area") <= c("most") * 0.03, 0.55).otherwise(0.10)),
    ]
    all_roles = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("role"), F.round(s, 9).alias("score")) for i, (n, s) in enumerate(roles)])
    rows = v.select("sheet_id", "view_id", F.explode(all_roles).alias("r")).select("sheet_id", "view_id", "r.*")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("sheet_id", "view_id").orderBy(F.col("score").desc(), "place"))).drop("place")
