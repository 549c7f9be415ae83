"""Answers that the driver's tables do not reach, on rows made for them."""

import pytest
from pyspark.sql import functions as F

from drawlake.functions import cadtext as T
from drawlake.functions import kinds as K
from drawlake.operators import components as C


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_stroke_semantics(spark):
    c = F.col
    rows = [("Line", "HIDDEN", None, None), ("Line", "0", "HID_BLOCK", None), ("Line", "0", None, "hid"), ("Arc", "CTR", None, None), ("Line", "DIMS", None, None), ("Text", "HIDDEN", None, None), ("Line", None, None, None), ("Viewport", "0", None, None)]
    got = values(spark, rows, "kind STRING, layer STRING, block STRING, text STRING", s=K.stroke_semantic(c("kind"), c("layer"), c("block"), c("text")))
    assert [x for (x,) in got] == ["Hidden", "Hidden", "Hidden", "Center", "Annotation", "Annotation", "VisibleOutline", "Unknown"]


def test_quantity_rules(spark):
    q, rule = T.quantity_rules(F.col("t"))
    rows = [("X 4",), ("× 12 SET",), ("3 PCS",), ("수량: 7",), ("QTY 0",), ("none",), (None,)]
    assert values(spark, rows, "t STRING", q=q, rule=rule) == [(4, "times"), (12, "unit"), (3, "unit"), (7, "label"), (None, None), (None, None), (None, None)]


def test_part_attributes(spark):
    got = values(spark, [("SUS304, 6T, 2x3",), ("thk 2.5 AL5052",), ("plain",)], "t STRING", **T.part_attributes(F.col("t")))
    assert [g[2] for g in got] == [6, 1, 1] and got[0][0].startswith("SUS") and got[1][0].startswith("AL") and got[2] == ("UNKNOWN", 0.0, 1)
    assert got[0][1] == 6.0 and got[1][1] == 2.5


def test_dimension_kinds(spark):
    rows = [("R12",), ("Ø 5",), ("%%c20",), ("25",), (None,)]
    assert [x for (x,) in values(spark, rows, "t STRING", k=T.dimension_kind(F.col("t")))] == ["Radial", "Diametric", "Diametric", "Linear", "Linear"]


MEMBER = "sheet_id BIGINT, comp BIGINT, handle BIGINT, kind STRING, layer STRING, text STRING, rotation DOUBLE, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE"


@pytest.fixture(scope="module")
def features(spark):
    ring = lambda comp, h, x, y, r: (1, comp, h, "Circle", "0", None, None, x - r, y - r, x + r, y + r)
    line = lambda comp, h, x, y, layer="0": (1, comp, h, "Line", layer, None, None, x, y, x + 10.0, y)
    rows = [
        # A projection symbol: two circles of one centre, sides of a trapezoid, a centre line.
        ring(1, 1, 300.0, 300.0, 5.0), ring(1, 2, 301.0, 300.0, 9.0), line(1, 3, 310.0, 300.0), line(1, 4, 310.0, 305.0), line(1, 5, 310.0, 295.0, "CENTER"),
        # Circles of one centre and one radius, and of one centre in two components.
        ring(2, 6, 500.0, 500.0, 5.0), ring(2, 7, 500.0, 500.5, 5.5), ring(3, 8, 700.0, 300.0, 5.0), ring(4, 9, 700.0, 300.0, 9.0),
        # An ellipse, which is geometry itself, with a number at the border.
        (1, 5, 10, "Ellipse", "0", None, None, 0.0, 0.0, 12.0, 12.0), (1, 5, 11, "Text", "0", "12", None, 3.0, 3.0, 8.0, 8.0), line(6, 12, 990.0, 990.0),
        # The same handles on another sheet.
        (2, 1, 1, "Circle", "0", None, None, 0.0, 0.0, 10.0, 10.0), (2, 1, 2, "Line", "0", None, None, 0.0, 0.0, 900.0, 900.0),
    ]
    return C.component_roles(C.component_features(spark.createDataFrame(rows, MEMBER))).cache()


def test_component_flags(features):
    got = {(r.sheet_id, r.comp): r for r in features.collect()}
    assert [k for k, r in sorted(got.items()) if r.concentric] == [(1, 1)]
    assert got[1, 1].trapezoid and got[1, 1].projection_symbol and got[1, 1].center_lines == 1
    assert len(got) == 7


def test_component_roles(features):
    got = {(r.sheet_id, r.comp): (r.role, r.role_score) for r in features.collect()}
    assert got[1, 1] == ("ProjectionMethodSymbol", 80)
    assert set(features.columns).isdisjoint({"has_dimension", "has_number", "meta_word", "has_center_line"})
