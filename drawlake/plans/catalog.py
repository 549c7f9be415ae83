"""The drawing queries and their SQL, by name.

A query takes (spark, sf_dir). Its SQL runs on the same tables in another engine and must
give the same rows; it is written from the definition, not from the Spark plan.
"""

from __future__ import annotations


from drawlake.plans import blocks, cells, components, contours, grids, more, primitives, reports, rows, shapes, tables, tracing, trees, views

QUERIES: dict = {}
ORACLES: dict = {}
for part in (rows, shapes, tables, more, primitives, components, views, blocks, cells, grids, contours, tracing, trees, reports):
    for name, (query, sql) in part.ENTRIES.items():
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
