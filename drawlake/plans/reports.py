"""Text reports: one line for each unit, relation, cluster, seed reason and view role."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawlake.operators import drawing as D
from drawlake.operators import views as V
from drawlake.plans import primitives as P
from drawlake.plans.rows import SHEETS_SQL
from drawlake.plans.shapes import block_views
from drawlake.plans.views import CANDIDATES_SQL, RELATIONS_SQL, ROLES_SQL
from drawlake.sources.drawings import ENTITIES_SQL, entities

ENTRIES: dict = {}


def entry(name: str, sql: str):
    def register(f):
        ENTRIES[name] = (lambda spark, sf_dir, f=f: f(entities(spark, sf_dir))), f"WITH RECURSIVE {ENTITIES_SQL}, {SHEETS_SQL}, {sql}"
        return f

    return register


def percent(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


@entry("unit_report", """m AS (SELECT sheet_id, 'Branch' AS unit_kind, block_path AS unit_key FROM e WHERE block_path IS NOT NULL UNION ALL SELECT sheet_id, 'BlockFamily', block_name FROM e WHERE block_path IS NOT NULL
  UNION ALL SELECT sheet_id, 'Loose', CASE WHEN kind IN ('Text', 'MText') THEN 'loose-text' WHEN kind IN ('Dimension', 'Leader') THEN 'loose-dimension' WHEN kind = 'BlockReference' THEN 'loose-block' ELSE 'loose-geometry' END FROM e WHERE block_path IS NULL),
 g AS (SELECT sheet_id, unit_kind, unit_key, count(*) AS n FROM m GROUP BY ALL) SELECT sheet_id, printf('%s-%d %s members=%d', unit_kind, row_number() OVER (PARTITION BY sheet_id, unit_kind ORDER BY n DESC, unit_key), unit_key, n) AS line FROM g""")  # fmt: skip
def unit_report(e):
    u = D.structural_units(e)
    return u.select("sheet_id", F.format_string("%s-%d %s members=%d", "unit_kind", "unit_index", "unit_key", "n").alias("line"))


@entry("relation_report", f"{RELATIONS_SQL} SELECT sheet_id, printf('%d-%d %s %s width=%d%% height=%d%% area=%d%%', a, b, relation, position, CAST(round(wl * 100) AS BIGINT), CAST(round(hl * 100) AS BIGINT), CAST(round(al * 100) AS BIGINT)) AS line FROM rr")
def relation_report(e):
    x = V.relations(block_views(e))
    line = F.format_string("%d-%d %s %s width=%d%% height=%d%% area=%d%%", "a_view_id", "b_view_id", "relation", "position", percent("width_like"), percent("height_like"), percent("area_like"))
    return x.select("sheet_id", line.alias("line"))


@entry("cluster_report", f"{CANDIDATES_SQL} SELECT sheet_id, printf('cluster %d geometry=%d round=%d dimensions=%d texts=%d score=%d%% %s', cluster_id, geometry, rounds, dimensions, texts, CAST(round(score * 100) AS BIGINT), CASE WHEN score >= 0.38 THEN 'accepted' ELSE 'rejected' END) AS line FROM vc")
def cluster_report(e):
    c = V.view_candidates(V.cluster_totals(V.cluster_members(e)), D.sheet_bounds(e))
    verdict = F.when(F.col("score") >= 0.38, "accepted").otherwise("rejected")
    line = F.format_string("cluster %d geometry=%d round=%d dimensions=%d texts=%d score=%d%% %s", "cluster_id", "geometry", "rounds", "dimensions", "texts", percent("score"), verdict)
    return c.select("sheet_id", line.alias("line"))


@entry("role_report", f"{ROLES_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, view_id ORDER BY score DESC, place) AS k FROM ro) SELECT sheet_id, printf('view %d: %s', view_id, string_agg(printf('%s %d%%', role, CAST(round(score * 100) AS BIGINT)), ', ' ORDER BY k)) AS line FROM rk WHERE k <= 3 GROUP BY sheet_id, view_id")
def role_report(e):
    top = V.role_candidates(block_views(e)).filter("rank <= 3")
    one = F.struct("rank", F.format_string("%s %d%%", "role", percent("score")).alias("text"))
    g = top.groupBy("sheet_id", "view_id").agg(F.array_sort(F.collect_list(one)).alias("roles"))
    return g.select("sheet_id", F.format_string("view %d: %s", "view_id", F.array_join(F.transform("roles", lambda x: x["text"]), ", ")).alias("line"))


def _reject_report(spark, sf_dir):
    counts = P.ENTRIES["seed_rejects"][0](spark, sf_dir)
    return counts.select(F.format_string("%s: %d", "reason", "n").alias("line"))


ENTRIES["reject_report"] = _reject_report, P.ENTRIES["seed_rejects"][1].replace(" SELECT CASE WHEN kind = 'BlockReference'", " SELECT printf('%s: %d', reason, n) AS line FROM (SELECT CASE WHEN kind = 'BlockReference'", 1) + ")"
