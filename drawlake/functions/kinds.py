"""Row classifiers: what an entity is, from its kind, type name, layer and text.

First match wins in every conditional, in the order written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of each family, and type names and keywords of each class.
TEXT_KINDS = ("Text", "MText", "InsertAttribute")
DIMENSION_KINDS = ("Dimension", "Leader")
GEOMETRY_KINDS = ("Line", "Polyline", "Arc", "Circle", "Ellipse", "Hatch", "Solid", "Face", "Point", "Spline", "Region")
SEED_KINDS = ("Line", "Polyline", "Arc", "Circle", "Ellipse", "Hatch", "Solid")
ROLE_TYPES = {
    "Geometry": ("line", "arc", "circle", "ellipse", "polyline", "lwpolyline", "pline", "spline", "region"),
    "ReferenceGeometry": ("xline", "ray", "centerline", "constructionline"),
    "Text": ("dbtext", "text", "mtext", "attributereference", "attribute"),
    "Dimension": (
        "dimension", "aligneddimension", "rotateddimension", "radialdimension", "radialdimensionlarge",
        "diametricdimension", "2lineangulardimension", "3pointangulardimension", "arcdimension", "ordinatedimension",
    ),
    "Leader": ("leader", "mleader"),
    "HatchLike": ("hatch", "solid", "trace", "wipeout"),
    "Symbol": ("point", "shape", "tolerance"),
    "BlockContainer": ("blockreference",),
}
STROKE_CENTER = ("CENTER", "CENTRE", "CTR", "CEN", "CL", "CENTERLINE", "CENTLINE")
STROKE_HIDDEN = ("HIDDEN", "HID", "HDN", "HIDLINE")
STROKE_NOTE = ("DIM", "DIMS", "LEADER", "TEXT", "NOTE", "CALLOUT")
FLAG_CENTER = ("CENTER", "CENTRE", "CNTR", "CTR", "CL", "CENTERLINE", "중심")
FLAG_HIDDEN = ("HIDDEN", "HID", "HL", "DOT", "PHANTOM", "숨은", "은선")
FLAG_TITLE = ("TITLE", "TITLEBLOCK", "표제", "표제란", "도곽", "SHEET", "FRAMEINFO")
FLAG_TABLE = ("TABLE", "TAB", "BOM", "LIST", "SCHEDULE", "표", "자재", "부품")
FLAG_CONTOUR = ("OUTER", "OUTLINE", "CONTOUR", "외형", "외곽")


def is_text(kind: Column) -> Column:
    return kind.isin(*TEXT_KINDS)


def is_dimension(kind: Column) -> Column:
    return kind.isin(*DIMENSION_KINDS)


def is_geometry(kind: Column) -> Column:
    return kind.isin(*GEOMETRY_KINDS)


def is_line(kind: Column) -> Column:
    return kind.isin("Line", "Polyline")


def is_round(kind: Column) -> Column:
    return kind.isin("Arc", "Circle", "Ellipse")


def plain(value: Column) -> Column:
    return F.upper(F.trim(F.coalesce(value, F.lit(""))))


def mentions(value: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(value, F.lit(w))
    return out


def role_of_type(type_name: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(type_name, F.lit(""))))
    out = None
    for role, names in ROLE_TYPES.items():
        out = F.when(t.isin(*names), role) if out is None else out.when(t.isin(*names), role)
    return out.otherwise("Unknown")


def seed_kind(kind: Column) -> Column:
    k = F.lower(kind)
    later = F.contains(k, F.lit("text")) | F.contains(k, F.lit("attribute")) | F.contains(k, F.lit("dimension")) | F.contains(k, F.lit("leader"))
    core = k.isin("line", "arc", "circle", "ellipse", "polyline", "lwpolyline", "spline", "hatch", "region")
    return F.when(later, "AttachLater").when(core, "CoreGeometry").otherwise("AttachLater")


def scene_bucket(kind: Column) -> Column:
    return (
        F.when(is_dimension(kind), "Annotation")
        .when(is_text(kind) | (kind == "BlockReference"), "Metadata")
        .when(is_geometry(kind), "GeometryCore").otherwise("Unknown")
    )


def stroke_semantic(kind: Column, layer: Column, block_name: Column, text: Column) -> Column:
    lay, block, t = plain(layer), plain(block_name), plain(text)
    center = mentions(lay, STROKE_CENTER) | mentions(block, ("CENTER", "CENTERLINE", "CENTLINE")) | mentions(t, ("CENTER", "CENTRE", "C/L", "CL"))
    hidden = mentions(lay, STROKE_HIDDEN) | mentions(block, ("HIDDEN", "HID")) | mentions(t, ("HIDDEN", "HID"))
    return (
        F.when(is_text(kind) | is_dimension(kind), "Annotation")
        .when(~is_geometry(kind), "Unknown")
        .when(center, "Center").when(hidden, "Hidden")
        .when(mentions(lay, STROKE_NOTE), "Annotation").otherwise("VisibleOutline")
    )


def semantic_flags(layer: Column, linetype: Column | None = None) -> dict[str, Column]:
    lay = plain(layer)
    lt = plain(linetype) if linetype is not None else F.lit("")
    title, rows = mentions(lay, FLAG_TITLE), mentions(lay, FLAG_TABLE)
    return {
        "is_center_line": mentions(lay, FLAG_CENTER) | mentions(lt, FLAG_CENTER),
        "is_hidden_line": mentions(lay, FLAG_HIDDEN) | mentions(lt, FLAG_HIDDEN),
        "is_title_layer": title,
        "is_table_layer": rows,
        "is_contour_layer": mentions(lay, FLAG_CONTOUR),
        "is_noise": title | rows,
    }
