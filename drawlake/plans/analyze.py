"""The whole analysis of sheets, from pluggable parts: a region detector, a classifier and
field extractors, each a function from DataFrames to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.operators import drawing as D


def classify_in_regions(e: DataFrame, regions: DataFrame) -> DataFrame:
    placed = D.best_region(e, regions)
    role, confidence = D.region_role(F.col("region_kind"))
    return placed.withColumn("role", role).withColumn("confidence", confidence)


def quantity_field(e: DataFrame) -> DataFrame:
    found = D.decide_quantity(D.quantity_candidates(e), D.sheet_bounds(e))
    return found.select("sheet_id", F.lit("Quantity").alias("field"), "status", F.col("quantity").cast("string").alias("value"))


@dataclass(frozen=True)
class Analysis:
    detect: Callable[[DataFrame], DataFrame] = D.band_regions
    classify: Callable[[DataFrame, DataFrame], DataFrame] = classify_in_regions
    extract: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=(quantity_field,))

    def run(self, e: DataFrame) -> dict[str, DataFrame]:
        """regions, entities (with region and role) and fields of all sheets."""
        regions = self.detect(e)
        fields = None
        for f in self.extract:
            fields = f(e) if fields is None else fields.unionByName(f(e))
        return {"regions": regions, "entities": self.classify(e, regions), "fields": fields}
