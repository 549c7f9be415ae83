"""Sheets that share handles do not answer for each other: a sheet that is copied under another
id gives its rows a second time."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from drawlake.plans import catalog

#: Queries that join or connect rows of a sheet; all others too with ALL_QUERIES set.
JOINED = (
    "dimension_parts", "part_inventory", "island_overlaps", "island_contents", "containment_parent", "containment_tree", "attach_nearest", "best_region", "sheet_owners",
    "geometry_clusters", "cluster_merges", "sub_clusters", "mask_islands", "mask_hints", "nested_loops", "view_relations", "dimension_owner", "header_values", "table_values",
    "component_roles", "block_attachments", "badge_candidates", "annotation_texts", "merged_zones", "nearest_value", "view_roles", "content_regions", "text_clusters",
)
#: Rows of these are of the whole table, or number rows across sheets.
WHOLE = set(os.environ.get("WHOLE_QUERIES", "").split(","))


@pytest.fixture(scope="module")
def sheets(spark, sf_dir, tmp_path_factory):
    """Two folders of tables: a sheet alone, and with a copy."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_custkey div 10 = 3")
    out = []
    for n in (1, 2):
        folder = str(tmp_path_factory.mktemp(f"sheets{n}"))
        rows = orders if n == 1 else orders.unionByName(orders.withColumn("o_custkey", (F.col("o_custkey") + 9000).cast(dict(orders.dtypes)["o_custkey"])))
        rows.coalesce(1).write.parquet(f"{folder}/orders.parquet")
        for f in os.listdir(sf_dir):
            if f != "orders.parquet":
                os.symlink(f"{sf_dir}/{f}", f"{folder}/{f}")
        out.append(folder)
    return out


def rows_of(df):
    names = [c for c in df.columns if "sheet" not in c]
    return Counter(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.select(*names).collect())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES) if os.environ.get("ALL_QUERIES") else [n for n in JOINED if n in catalog.QUERIES])
def test_copies_of_a_sheet(spark, sheets, name):
    if name in WHOLE:
        pytest.skip("about the whole table")
    one, two = (rows_of(catalog.QUERIES[name](spark, d)) for d in sheets)
    assert two == Counter({k: 2 * n for k, n in one.items()})
