"""Writers: JSON trees and part lists, capture plans, text reports. Each goes through Spark's
committed output, a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def part_list(parts: DataFrame, project: str) -> DataFrame:
    """One document per sheet: project, part count and the parts in order of their handle."""
    columns = [c for c in parts.columns if c != "sheet_id"]
    g = parts.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("part_count"), F.array_sort(F.collect_list(F.struct(*columns))).alias("parts"))
    return g.select("sheet_id", F.to_json(F.struct(F.lit(project).alias("project"), "part_count", "parts")).alias("document"))


def capture_plan(tiles: DataFrame, size: float = 200.0, step: float = 160.0) -> DataFrame:
    """Tiles (sheet_id, row, col) as rows with id, min and max corners."""
    x, y = F.col("col") * step, F.col("row") * step
    return tiles.select("sheet_id", F.format_string("R%d_C%d", "row", "col").alias("id"), F.array(x, y).alias("min"), F.array(x + size, y + size).alias("max"))


def write_report(lines: DataFrame, path: str) -> None:
    """Text lines (column `line`) of sheets, a file for each range of sheets."""
    lines.repartitionByRange("sheet_id").sortWithinPartitions("sheet_id").select("line").write.mode("overwrite").text(path)
