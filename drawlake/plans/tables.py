"""Aggregates, windows, set operations, hierarchies and quantities."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.functions import kinds as K
from drawlake.operators import drawing as D
from drawlake.operators.spatial import best_per, connected
from drawlake.plans.rows import DIM, GEO, SHEETS_SQL, TEXT
from drawlake.plans.shapes import reach
from drawlake.sources.drawings import ENTITIES_SQL, entities, expand_blocks

ENTRIES: dict = {}


def entry(name: str, sql: str | None):
    def register(f):
        text = None if sql is None else f"WITH RECURSIVE {ENTITIES_SQL}, {SHEETS_SQL} {sql}"
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(entities(spark, sf_dir))), text
        return f

    return register


def raw(name: str, sql: str | None):
    def register(f):
        ENTRIES[name] = (f, sql)
        return f

    return register


@entry("count_by_kind", "SELECT kind AS name, count(*) AS n FROM e GROUP BY kind")
def count_by_kind(e):
    return e.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@entry("top_layers", "SELECT layer AS name, count(*) AS n FROM e GROUP BY layer ORDER BY n DESC, name LIMIT 30")
def top_layers(e):
    return e.groupBy(F.col("layer").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(30)


@entry("block_counts", f"SELECT block_name, count(*) AS total, count(*) FILTER (kind IN {GEO}) AS shapes, count(*) FILTER (kind IN {TEXT}) AS texts FROM e WHERE block_name IS NOT NULL GROUP BY block_name HAVING count(*) FILTER (kind IN {GEO}) >= 5")
def block_counts(e):
    k = F.col("kind")
    g = e.filter("block_name IS NOT NULL").groupBy("block_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(K.is_geometry(k)).alias("shapes"), F.count_if(K.is_text(k)).alias("texts"))
    return g.filter("shapes >= 5")


@entry("composition", f"SELECT sheet_id, count(*) AS total, count(*) FILTER (kind = 'Line') AS n_line, count(*) FILTER (kind = 'Hatch') AS n_hatch, count(*) FILTER (kind IN {GEO}) AS geometry, count(*) FILTER (kind IN {TEXT}) AS texts, count(*) FILTER (kind IN {DIM}) AS annotations, count(*) FILTER (kind IN {TEXT}) >= 3 AND count(*) FILTER (kind IN {TEXT}) >= count(*) FILTER (kind IN {GEO}) AS text_heavy, count(*) FILTER (kind IN {GEO}) >= 3 AND count(*) FILTER (kind IN {GEO}) > count(*) FILTER (kind IN {TEXT}) AS geometry_heavy, count(*) FILTER (kind IN {DIM}) >= 2 AND count(*) FILTER (kind IN {DIM}) >= count(*) FILTER (kind IN {GEO}) * 0.5 AS annotation_heavy FROM e GROUP BY sheet_id")
def composition(e):
    return D.composition(e, "sheet_id").select("sheet_id", "total", "n_line", "n_hatch", "geometry", "texts", "annotations", "text_heavy", "geometry_heavy", "annotation_heavy")


@entry("structural_units", f""", u AS (SELECT *, 'Branch' AS unit_kind, block_path AS unit_key FROM e WHERE block_path IS NOT NULL UNION ALL SELECT *, 'BlockFamily', block_name FROM e WHERE block_path IS NOT NULL
 UNION ALL SELECT *, 'Loose', CASE WHEN kind IN {TEXT} THEN 'loose-text' WHEN kind IN {DIM} THEN 'loose-dimension' WHEN kind = 'BlockReference' THEN 'loose-block' WHEN kind IN {GEO} THEN 'loose-geometry' ELSE 'loose-other' END FROM e WHERE block_path IS NULL),
 g AS (SELECT sheet_id, unit_kind, unit_key, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, count(*) AS n FROM u GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY sheet_id, unit_kind ORDER BY n DESC, unit_key) AS INTEGER) AS unit_index FROM g""")  # fmt: skip
def structural_units(e):
    return D.structural_units(e)


@entry("ownership", "SELECT handle FROM e WHERE block_path IS NULL")
def ownership(e):
    return D.ownership(e).select("handle")


@entry("block_mode", ", c AS (SELECT sheet_id, block_name, count(*) AS n, min(handle) AS f FROM e WHERE block_name IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, f) AS k FROM c) SELECT sheet_id, block_name, n FROM k WHERE k = 1")
def block_mode(e):
    """The most frequent leaf block; ties go to the one that is seen first."""
    c = e.filter("block_name IS NOT NULL").groupBy("sheet_id", "block_name").agg(F.count(F.lit(1)).alias("n"), F.min("handle").alias("f"))
    return best_per(c, ["sheet_id"], [F.col("n").desc(), F.col("f")]).select("sheet_id", "block_name", "n")


@entry("unit_anchor", f", k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY CASE WHEN kind IN {TEXT} THEN 0 WHEN kind IN {DIM} THEN 1 ELSE 2 END, handle) AS k FROM e) SELECT sheet_id, CASE WHEN kind IN {TEXT} OR kind IN {DIM} THEN ax ELSE (s_min_x + s_max_x) * 0.5 END AS x, CASE WHEN kind IN {TEXT} OR kind IN {DIM} THEN ay ELSE (s_min_y + s_max_y) * 0.5 END AS y FROM k JOIN s USING (sheet_id) WHERE k = 1")
def unit_anchor(e):
    """Anchor of the first text, else of the first dimension, else the centre."""
    k = F.col("kind")
    at = F.struct("handle", "ax", "ay")
    g = e.groupBy("sheet_id").agg(
        F.min(F.when(K.is_text(k), at)).alias("t"), F.min(F.when(K.is_dimension(k), at)).alias("d"),
        ((F.min("min_x") + F.max("max_x")) * 0.5).alias("cx"), ((F.min("min_y") + F.max("max_y")) * 0.5).alias("cy"),
    )
    return g.select("sheet_id", F.coalesce("t.ax", "d.ax", "cx").alias("x"), F.coalesce("t.ay", "d.ay", "cy").alias("y"))


@entry("path_prefix", ", p AS (SELECT sheet_id, count(DISTINCT string_split(block_path, '>')[1]) AS n, min(string_split(block_path, '>')[1]) AS first FROM e WHERE block_path IS NOT NULL GROUP BY sheet_id) SELECT sheet_id, CASE WHEN n = 1 THEN first ELSE '' END AS root FROM p")
def path_prefix(e):
    """First step that all block paths of a sheet share."""
    head = F.split("block_path", ">")[0]
    g = e.filter("block_path IS NOT NULL").groupBy("sheet_id").agg(F.min(head).alias("lo"), F.max(head).alias("hi"))
    return g.select("sheet_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias("root"))


@entry("median_diagonal", ", d AS (SELECT sheet_id, list_sort(list(sqrt((max_x - min_x) * (max_x - min_x) + (max_y - min_y) * (max_y - min_y)))) AS l FROM e GROUP BY sheet_id) SELECT sheet_id, round(8.0 * l[len(l) // 2 + 1], 6) AS eps FROM d")
def median_diagonal(e):
    """Eight times the upper median of the diagonals."""
    diag = F.sqrt((F.col("max_x") - F.col("min_x")) * (F.col("max_x") - F.col("min_x")) + (F.col("max_y") - F.col("min_y")) * (F.col("max_y") - F.col("min_y")))
    r = e.select("sheet_id", diag.alias("d")).withColumn("k", F.row_number().over(W.partitionBy("sheet_id").orderBy("d"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("sheet_id")))
    return r.filter(F.col("k") == F.floor(F.col("n") / 2) + 1).select("sheet_id", F.round(F.lit(8.0) * F.col("d"), 6).alias("eps"))


@entry("gap_percentile", ", g AS (SELECT sheet_id, ax - lag(ax) OVER (PARTITION BY sheet_id ORDER BY ax, handle) AS gap FROM e) SELECT sheet_id, round(quantile_cont(gap, 0.65) * 1.45, 6) AS connect_gap FROM g WHERE gap > 0 GROUP BY sheet_id")
def gap_percentile(e):
    gap = F.col("ax") - F.lag("ax").over(W.partitionBy("sheet_id").orderBy("ax", "handle"))
    return e.select("sheet_id", gap.alias("gap")).filter("gap > 0").groupBy("sheet_id").agg(F.round(F.percentile("gap", 0.65) * 1.45, 6).alias("connect_gap"))


@entry("axis_clusters", ", l AS (SELECT sheet_id, handle, min_y, CASE WHEN min_y - lag(min_y) OVER w > 5 THEN 1 ELSE 0 END AS b FROM e WHERE kind = 'Line' WINDOW w AS (PARTITION BY sheet_id ORDER BY min_y, handle)), c AS (SELECT *, sum(b) OVER (PARTITION BY sheet_id ORDER BY min_y, handle ROWS UNBOUNDED PRECEDING) AS axis FROM l) SELECT sheet_id, CAST(axis AS BIGINT) AS axis, count(*) AS n, min(min_y) AS low, max(min_y) AS high FROM c GROUP BY ALL")
def axis_clusters(e):
    """Lines by coordinate, parted where the gap exceeds 5."""
    w = W.partitionBy("sheet_id").orderBy("min_y", "handle")
    jump = F.when(F.col("min_y") - F.lag("min_y").over(w) > 5, 1).otherwise(0)
    lines = e.filter("kind = 'Line'").withColumn("b", jump).withColumn("axis", F.sum("b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return lines.groupBy("sheet_id", "axis").agg(F.count(F.lit(1)).alias("n"), F.min("min_y").alias("low"), F.max("min_y").alias("high"))


@entry("interval_union", ", l AS (SELECT sheet_id, min_x, max_x, handle, max(max_x) OVER (PARTITION BY sheet_id ORDER BY min_x, handle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e WHERE kind = 'Line') SELECT sheet_id, sum(greatest(0, max_x - greatest(min_x, coalesce(reach, min_x)))) AS covered FROM l GROUP BY sheet_id")
def interval_union(e):
    """Length that the x spans of a sheet's lines cover."""
    reach = F.max("max_x").over(W.partitionBy("sheet_id").orderBy("min_x", "handle").rowsBetween(W.unboundedPreceding, -1))
    lines = e.filter("kind = 'Line'").withColumn("reach", reach)
    add = F.greatest(F.lit(0.0), F.col("max_x") - F.greatest("min_x", F.coalesce("reach", "min_x")))
    return lines.select("sheet_id", add.alias("add")).groupBy("sheet_id").agg(F.sum("add").alias("covered"))


@entry("reading_order", ", k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY min_y DESC, min_x, handle) AS k FROM e WHERE kind = 'BlockReference') SELECT handle, concat('Sheet-', k) AS name FROM k")
def reading_order(e):
    k = F.row_number().over(W.partitionBy("sheet_id").orderBy(F.col("min_y").desc(), "min_x", "handle"))
    return e.filter("kind = 'BlockReference'").select("handle", F.concat(F.lit("Sheet-"), k).alias("name"))


@entry("top_candidates", ", k AS (SELECT *, (max_x - min_x) * (max_y - min_y) AS area, row_number() OVER (PARTITION BY sheet_id ORDER BY (max_x - min_x) * (max_y - min_y) DESC, handle) AS k FROM e WHERE kind = 'BlockReference') SELECT handle, area FROM k WHERE k <= 8")
def top_candidates(e):
    rows = e.filter("kind = 'BlockReference'").withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    return best_per(rows, ["sheet_id"], [F.col("area").desc(), F.col("handle")], 8).select("handle", "area")


@entry("top_two_gap", ", c AS (SELECT sheet_id, layer, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT *, lead(n) OVER w AS second, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY sheet_id ORDER BY n DESC, layer)) SELECT sheet_id, layer, n, n - coalesce(second, 0) AS lead FROM k WHERE k = 1")
def top_two_gap(e):
    w = W.partitionBy("sheet_id").orderBy(F.col("n").desc(), "layer")
    c = e.groupBy("sheet_id", "layer").agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("lead", F.col("n") - F.coalesce(F.lead("n").over(w), F.lit(0))).withColumn("k", F.row_number().over(w))
    return r.filter("k = 1").select("sheet_id", "layer", "n", "lead")


@entry("share_of_best", ", a AS (SELECT handle, sheet_id, (max_x - min_x) * (max_y - min_y) AS area FROM e WHERE kind = 'BlockReference') SELECT handle FROM (SELECT *, max(area) OVER (PARTITION BY sheet_id) AS top FROM a) WHERE area >= greatest(4, top * 0.4)")
def share_of_best(e):
    rows = e.filter("kind = 'BlockReference'").withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    top = F.max("area").over(W.partitionBy("sheet_id"))
    return rows.withColumn("top", top).filter(F.col("area") >= F.greatest(F.lit(4.0), F.col("top") * 0.4)).select("handle")


@entry("member_union", f"SELECT handle, 'text' AS member FROM e WHERE kind IN {TEXT} UNION ALL SELECT handle, 'center' FROM e WHERE layer = 'CENTER'")
def member_union(e):
    return e.filter(K.is_text(F.col("kind"))).select("handle", F.lit("text").alias("member")).unionByName(e.filter("layer = 'CENTER'").select("handle", F.lit("center").alias("member")))


@entry("member_except", "SELECT handle FROM e WHERE layer = 'OUTLINE' EXCEPT SELECT handle FROM e WHERE kind = 'Line'")
def member_except(e):
    return e.filter("layer = 'OUTLINE'").select("handle").subtract(e.filter("kind = 'Line'").select("handle"))


@entry("member_overlap", ", t AS (SELECT sheet_id, count(*) FILTER (kind = 'Line' AND layer = 'OUTLINE') AS ab, count(*) FILTER (kind = 'Line') AS a, count(*) FILTER (layer = 'OUTLINE') AS b FROM e GROUP BY sheet_id) SELECT sheet_id, round(CASE WHEN least(a, b) > 0 THEN ab / least(a, b) ELSE 0 END, 6)::DOUBLE AS overlap FROM t")
def member_overlap(e):
    a = F.collect_set(F.when(F.col("kind") == "Line", F.col("handle"))).alias("a")
    b = F.collect_set(F.when(F.col("layer") == "OUTLINE", F.col("handle"))).alias("b")
    g = e.groupBy("sheet_id").agg(a, b)
    small = F.least(F.size("a"), F.size("b"))
    return g.select("sheet_id", F.round(F.when(small > 0, F.size(F.array_intersect("a", "b")) / small).otherwise(0.0), 6).alias("overlap"))


@entry("distinct_members", "SELECT DISTINCT sheet_id, kind, layer FROM e")
def distinct_members(e):
    return e.select("sheet_id", "kind", "layer").dropDuplicates()


@entry("style_groups", ", g AS (SELECT sheet_id, layer, kind, sum((max_x - min_x) + (max_y - min_y)) * 3 + count(*) * 100 AS score FROM e GROUP BY ALL) SELECT sheet_id, layer, kind, score FROM (SELECT *, max(score) OVER (PARTITION BY sheet_id) AS top FROM g) WHERE score >= top * 0.55")
def style_groups(e):
    length = (F.col("max_x") - F.col("min_x")) + (F.col("max_y") - F.col("min_y"))
    g = e.groupBy("sheet_id", "layer", "kind").agg((F.sum(length) * 3 + F.count(F.lit(1)) * 100).alias("score"))
    return g.withColumn("top", F.max("score").over(W.partitionBy("sheet_id"))).filter(F.col("score") >= F.col("top") * 0.55).drop("top")


@entry("cell_buckets", f"SELECT sheet_id, CAST(floor(ax / 100) AS INTEGER) AS col, CAST(floor(ay / 100) AS INTEGER) AS row, sum(CASE WHEN kind IN {TEXT} THEN 3.0 WHEN kind = 'BlockReference' THEN 2.0 WHEN kind IN {GEO} THEN 1.0 ELSE 0.5 END)::DOUBLE AS score, count(*) AS n FROM e GROUP BY ALL")
def cell_buckets(e):
    k = F.col("kind")
    weight = F.when(K.is_text(k), 3.0).when(k == "BlockReference", 2.0).when(K.is_geometry(k), 1.0).otherwise(0.5)
    cell = lambda c: F.floor(F.col(c) / 100).cast("int")
    return e.groupBy("sheet_id", cell("ax").alias("col"), cell("ay").alias("row")).agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("n"))


@entry("text_lists", ", t AS (SELECT sheet_id, text FROM e WHERE text IS NOT NULL) SELECT sheet_id, string_agg(DISTINCT text, ' | ' ORDER BY text) AS texts FROM t GROUP BY sheet_id")
def text_lists(e):
    return e.filter("text IS NOT NULL").groupBy("sheet_id").agg(F.array_join(F.array_sort(F.collect_set("text")), " | ").alias("texts"))


@entry("quantity_candidates", r""", t AS (SELECT e.*, trim(text) AS t, CASE WHEN ay <= s_min_y + (s_max_y - s_min_y) * 0.26 THEN 0.06 WHEN ax >= s_max_x - (s_max_x - s_min_x) * 0.24 THEN 0.10 ELSE -0.18 END::DOUBLE AS base FROM e JOIN s USING (sheet_id) WHERE text IS NOT NULL),
 f AS (SELECT * FROM t WHERE NOT (contains(upper(t), 'R') OR contains(t, '.') OR contains(upper(t), 'TAP')))
SELECT handle, CAST(regexp_extract(t, '\d+', 0) AS INTEGER) AS quantity, CASE WHEN t LIKE 'QTY%' THEN 0.97 ELSE round(least(1, base + 0.82), 6) END AS score FROM f WHERE t LIKE 'QTY: %' OR t LIKE '% EA'""")  # fmt: skip
def quantity_candidates(e):
    return D.quantity_candidates(e).select("handle", "quantity", F.round("score", 6).alias("score"))


@entry("quantity_decision", r""", t AS (SELECT e.*, trim(text) AS t, CASE WHEN ay <= s_min_y + (s_max_y - s_min_y) * 0.26 THEN 0.06 WHEN ax >= s_max_x - (s_max_x - s_min_x) * 0.24 THEN 0.10 ELSE -0.18 END::DOUBLE AS base FROM e JOIN s USING (sheet_id) WHERE text IS NOT NULL),
 c AS (SELECT sheet_id, CAST(regexp_extract(t, '\d+', 0) AS INTEGER) AS quantity, CASE WHEN t LIKE 'QTY%' THEN 0.97 ELSE least(1, base + 0.82) END AS score FROM t WHERE NOT (contains(upper(t), 'R') OR contains(t, '.') OR contains(upper(t), 'TAP')) AND (t LIKE 'QTY: %' OR t LIKE '% EA')),
 g AS (SELECT sheet_id, quantity, max(score) AS best, count(*) AS n, round(max(score) + least(0.20, (count(*) - 1) * 0.05), 9) AS total FROM c GROUP BY ALL),
 k AS (SELECT *, row_number() OVER w AS k, lead(total) OVER w AS second FROM g WINDOW w AS (PARTITION BY sheet_id ORDER BY total DESC, n DESC, best DESC, quantity))
SELECT s.sheet_id, CASE WHEN total IS NULL THEN 'NotFound' WHEN second IS NOT NULL AND total >= 0.7 AND second >= 0.7 AND abs(total - second) < 0.12 THEN 'Ambiguous'
 WHEN (best >= 0.88 AND (second IS NULL OR total - second >= 0.12)) OR (best >= 0.76 AND n >= 2 AND (second IS NULL OR total - second >= 0.08)) THEN 'Confirmed' WHEN best >= 0.6 THEN 'Ambiguous' ELSE 'NotFound' END AS status FROM s LEFT JOIN k ON k.sheet_id = s.sheet_id AND k.k = 1""")  # fmt: skip
def quantity_decision(e):
    return D.decide_quantity(D.quantity_candidates(e), D.sheet_bounds(e)).select("sheet_id", "status")


@entry("running_layout", ", k AS (SELECT handle, sum(max_y - min_y + 10) OVER (PARTITION BY sheet_id ORDER BY handle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM e WHERE kind = 'Circle') SELECT handle, coalesce(off, 0.0) AS offset_y FROM k")
def running_layout(e):
    before = W.partitionBy("sheet_id").orderBy("handle").rowsBetween(W.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.col("max_y") - F.col("min_y") + 10).over(before), F.lit(0.0))
    return e.filter("kind = 'Circle'").select("handle", off.alias("offset_y"))


@entry("diagnostics", "SELECT sheet_id, format('sheet {} has {} entities', sheet_id, count(*)) AS line FROM e GROUP BY sheet_id")
def diagnostics(e):
    return e.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n")).select("sheet_id", F.format_string("sheet %d has %d entities", "sheet_id", "n").alias("line"))


@entry("markers", "SELECT handle, concat('V', handle) AS label, CASE WHEN kind = 'BlockReference' THEN 'red' ELSE 'green' END AS colour, min_x, min_y, max_x, max_y FROM e WHERE kind IN ('BlockReference', 'Circle')")
def markers(e):
    colour = F.when(F.col("kind") == "BlockReference", "red").otherwise("green")
    return e.filter(F.col("kind").isin("BlockReference", "Circle")).select("handle", F.concat(F.lit("V"), "handle").alias("label"), colour.alias("colour"), "min_x", "min_y", "max_x", "max_y")


@raw("block_expansion", """WITH RECURSIVE i AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child, CAST(n_nationkey AS DOUBLE) AS dx FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, CAST(s_suppkey AS DOUBLE) FROM supplier),
 w(root, node, depth, dx) AS (SELECT 'R' || r_regionkey, 'R' || r_regionkey, 0, 0.0::DOUBLE FROM region UNION ALL SELECT root, child, depth + 1, w.dx + i.dx FROM w JOIN i ON i.parent = w.node)
SELECT root, node, CAST(depth AS INTEGER) AS depth, dx FROM w""")  # fmt: skip
def block_expansion(spark, sf_dir):
    """Regions, nations and suppliers as nested block definitions."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    inserts = (
        read("nation").select(name("R", "n_regionkey").alias("parent"), name("N", "n_nationkey").alias("child"), F.col("n_nationkey").cast("double").alias("dx"), F.lit(0.0).alias("dy"))
        .unionByName(read("supplier").select(name("N", "s_nationkey").alias("parent"), name("S", "s_suppkey").alias("child"), F.col("s_suppkey").cast("double").alias("dx"), F.lit(0.0).alias("dy")))
    )
    return expand_blocks(inserts, read("region").select(name("R", "r_regionkey").alias("node"))).select("root", "node", "depth", "dx")


@raw("block_totals", "SELECT 'R' || n_regionkey AS root, count(*) AS parts FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def block_totals(spark, sf_dir):
    """Leaves below each root, counted through the recursive expansion."""
    return block_expansion(spark, sf_dir).filter("depth = 2").groupBy("root").agg(F.count(F.lit(1)).alias("parts"))


@raw("density_clusters", f"WITH RECURSIVE d AS (SELECT CAST(0 AS BIGINT) AS sheet_id, vec_id AS handle, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), g AS (SELECT a.sheet_id, a.handle AS a, b.handle AS b FROM d a JOIN d b ON a.handle < b.handle WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0001), {reach('d', 'g', 'cc')} SELECT handle, component AS cluster FROM cc")
def density_clusters(spark, sf_dir):
    """Points within 0.01 of each other, chained: density clustering with one point enough."""
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit(0).cast("bigint").alias("sheet_id"), F.col("vec_id").alias("handle"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    from drawlake.functions import boxes as B
    from drawlake.operators.spatial import box_join

    pts = p.select("sheet_id", "handle", F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"))
    a, b = B.box("a_"), B.box("b_")
    square = (a.min_x - b.min_x) * (a.min_x - b.min_x) + (a.min_y - b.min_y) * (a.min_y - b.min_y)
    edges = box_join(pts, pts, 0.01, 0.02).filter((F.col("a_handle") < F.col("b_handle")) & (square <= 0.0001)).select("sheet_id", F.col("a_handle").alias("a"), F.col("b_handle").alias("b"))
    return connected(p, edges).select("handle", F.col("component").alias("cluster"))


_LABELS_SQL = r""", t AS (SELECT e.sheet_id, handle, ax, ay, trim(text) AS t, CASE WHEN ay <= s_min_y + (s_max_y - s_min_y) * 0.26 THEN 'TitleBlock' WHEN ax >= s_max_x - (s_max_x - s_min_x) * 0.24 THEN 'MetaTable' ELSE 'Geometry' END AS rk FROM e JOIN s USING (sheet_id) WHERE text IS NOT NULL),
 lb AS (SELECT * FROM t WHERE contains(upper(t), 'QTY') AND rk <> 'Geometry'), vl AS (SELECT *, CAST(regexp_extract(t, '\d+', 0) AS INTEGER) AS q FROM t WHERE t LIKE '% EA' AND NOT (contains(upper(t), 'R') OR contains(t, '.') OR contains(upper(t), 'TAP'))),
 pr AS (SELECT l.sheet_id, l.handle AS label, v.handle, q AS quantity, v.rk, v.ax - l.ax AS dx, v.ay - l.ay AS dy, sqrt((v.ax - l.ax) * (v.ax - l.ax) + (v.ay - l.ay) * (v.ay - l.ay)) AS distance FROM lb l JOIN vl v ON l.sheet_id = v.sheet_id AND l.rk = v.rk AND l.handle <> v.handle),
 rl AS (SELECT *, CASE WHEN dx BETWEEN 0 AND 122.5 AND abs(dy) <= 8 THEN 'right' WHEN dy <= 0 AND abs(dx) <= 10 AND abs(dy) <= 80 THEN 'below' WHEN distance <= 16 THEN 'close' END AS relation FROM pr),
 nb AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet_id, label ORDER BY score DESC, distance, handle) AS INTEGER) AS rank FROM (SELECT *, round(least(1, 0.52 + CASE rk WHEN 'MetaTable' THEN 0.10 ELSE 0.06 END + CASE relation WHEN 'right' THEN 0.34 WHEN 'below' THEN 0.24 ELSE 0.18 END)::DOUBLE, 9) AS score FROM rl WHERE relation IS NOT NULL) QUALIFY rank <= 3)"""


@entry("label_neighbours", _LABELS_SQL + " SELECT sheet_id, label, handle, quantity, round(score, 6) AS score, relation, round(distance, 6) AS distance, rank FROM nb")
def label_neighbours(e):
    from drawlake.functions import kinds as K

    texts = e.filter(K.is_text(F.col("kind"))).join(D.preliminary_region(e), ["sheet_id", "handle"]).withColumn("height", F.lit(None).cast("double"))
    return D.label_neighbours(texts).select("sheet_id", "label", "handle", "quantity", F.round("score", 6).alias("score"), "relation", F.round("distance", 6).alias("distance"), "rank")


@entry("all_quantities", _LABELS_SQL + r""", il AS (SELECT sheet_id, handle, CAST(regexp_extract(t, '\d+', 0) AS INTEGER) AS quantity, CASE WHEN t LIKE 'QTY%' THEN 0.97 ELSE least(1, CASE rk WHEN 'TitleBlock' THEN 0.06 WHEN 'MetaTable' THEN 0.10 ELSE -0.18 END + 0.82) END AS score FROM t WHERE NOT (contains(upper(t), 'R') OR contains(t, '.') OR contains(upper(t), 'TAP')) AND (t LIKE 'QTY: %' OR t LIKE '% EA'))
 SELECT sheet_id, handle, CAST(NULL AS BIGINT) AS label, quantity, round(score, 6)::DOUBLE AS score FROM il UNION ALL SELECT sheet_id, handle, label, quantity, round(score, 6) FROM nb""")
def all_quantities(e):
    return D.all_quantities(e).select("sheet_id", "handle", "label", "quantity", F.round("score", 6).alias("score"))
