"""Boxes, points and style flags of primitives, and tests of their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawlake.functions import kinds as K
from drawlake.functions.boxes import Box

#: Keywords of faded styles, of component texts and of blocks' roles.
FADED_LAYERS = ("GUIDE", "AUX", "REFERENCE", "REF", "MARK", "DEFPOINTS")
FADED_LINETYPES = ("PHANTOM", "DOT", "DASH")
SCALE_WORDS = ("SCALE",)
MATERIAL_WORDS = ("MAT", "MATERIAL", "SPEC", "SS400", "SUS", "AL")
QUANTITY_WORDS = ("QTY", "Q'TY", "QUANTITY")
TITLE_WORDS = ("TITLE", "DESCRIPTION", "DWG", "DRAWING")
CONTROL_WORDS = ("DOCUMENT", "SIZE", "CREDENCIAL", "CREDENTIAL", "REV", "DATE", "APPROVED", "CHECK")
BLOCK_WORDS = (
    "TITLE", "DWG", "DRAWING", "SCALE", "DATE", "REV", "NO", "NAME", "PART", "MATERIAL", "SIZE", "SHEET",
    "도면", "품명", "재질", "축척", "일자", "번호", "품번", "도번", "검토", "승인", "작성", "중량", "단위",
)
QUANTITY_NOTE = r"(?i)^\s*\d+\s*(?:[*xX×]\s*\d+\s*)?(?:SET|SETS|EA|EACH|PCS|PC)\s*$|^\s*\d+\s*(?:[*xX×])\s*\d+\s*(?:SET|SETS|EA|EACH|PCS|PC)\s*$"
PAD = 1e-4


def ensured_box(vertices: Column | None = None) -> Box:
    """The box of a row, else one from its parameters: end points, vertices, centre and radius,
    or its point with a margin of PAD; sides that are too short are padded."""
    kind = F.col("kind")
    corners = F.col("vertices") if vertices is None else vertices

    def padded(low: Column, high: Column) -> tuple[Column, Column]:
        short = F.abs(high - low) < PAD
        return F.when(short, low - PAD).otherwise(low), F.when(short, high + PAD).otherwise(high)

    def axis(box: tuple[str, str], ends: tuple[str, str], centre: str, reach: Column, point: str, pick: str) -> tuple[Column, Column]:
        line = padded(F.least(*map(F.col, ends)), F.greatest(*map(F.col, ends)))
        values = F.transform(corners, lambda p: p[pick])
        many = padded(F.array_min(values), F.array_max(values))
        out = []
        for i, sign in enumerate((-1.0, 1.0)):
            fallback = (
                F.when(kind == "Line", line[i])
                .when(kind.isin("Circle", "Arc", "Ellipse"), F.when(reach > 0, F.col(centre) + reach * sign))
                .when(kind.isin("Polyline", "Spline"), many[i])
                .when(F.size(corners) > 0, many[i]).otherwise(F.col(point) + sign * PAD)
            )
            out.append(F.coalesce(F.col(box[i]), fallback))
        return out[0], out[1]

    major = F.col("radius")
    minor = F.when(kind == "Ellipse", major * F.col("ratio")).otherwise(major)
    x0, x1 = axis(("min_x", "max_x"), ("sx", "ex"), "cx", F.when(minor > 0, major), "x", "x")
    y0, y1 = axis(("min_y", "max_y"), ("sy", "ey"), "cy", minor, "y", "y")
    return Box(x0, y0, x1, y1)


def vertices() -> Column:
    """The corners of polylines, splines and solids, counter-clockwise; null for other kinds."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    return F.when(F.col("kind").isin("Polyline", "Spline", "Solid"), F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)))


def scan_anchor() -> tuple[Column, Column]:
    """Insertion point of texts and blocks, centre of round ones, middle of lines, else the
    middle of the box; 0, 0 without any."""
    kind = F.col("kind")

    def axis(point: str, centre: str, ends: tuple[str, str], box: tuple[str, str]) -> Column:
        middle = (F.col(box[0]) + F.col(box[1])) * 0.5
        return F.coalesce(
            F.when(K.is_text(kind) | (kind == "BlockReference"), F.col(point))
            .when(K.is_round(kind), F.col(centre))
            .when(kind == "Line", (F.col(ends[0]) + F.col(ends[1])) * 0.5).otherwise(middle), F.lit(0.0)
        )

    return axis("x", "cx", ("sx", "ex"), ("min_x", "max_x")), axis("y", "cy", ("sy", "ey"), ("min_y", "max_y"))


def representative_point() -> tuple[Column, Column, Column]:
    """Point and class of an entity in a grid cell: Text, Block, Curve or Other. Null without a
    box where one is needed."""
    kind = F.col("kind")
    text, block, curve = kind.isin("Text", "MText"), kind == "BlockReference", kind.isin("Line", "Arc", "Circle", "Polyline")
    middle = lambda a, b: (F.col(a) + F.col(b)) * 0.5
    own = lambda p, c, s, e, lo, hi: F.when(text | block, F.col(p)).when(kind == "Line", middle(s, e)).when(kind.isin("Arc", "Circle"), F.col(c)).otherwise(middle(lo, hi))
    x, y = own("x", "cx", "sx", "ex", "min_x", "max_x"), own("y", "cy", "sy", "ey", "min_y", "max_y")
    name = F.when(text, "Text").when(block, "Block").when(curve, "Curve").otherwise("Other")
    return x, y, F.when(x.isNotNull(), name)


def effective_linetype(own: Column, of_layer: Column) -> Column:
    """An entity's own line type unless it is blank or by layer, else the layer's if it has one."""
    blank = own.isNull() | (F.trim(own) == "")
    return F.when(~blank & (F.lower(own) != "bylayer"), own).otherwise(F.coalesce(F.when(F.trim(of_layer) != "", F.trim(of_layer)), own))


def is_faded(layer: Column, linetype: Column, transparency: Column) -> Column:
    return K.mentions(K.plain(layer), FADED_LAYERS) | K.mentions(K.plain(linetype), FADED_LINETYPES) | (F.coalesce(transparency, F.lit(0)) > 0)


def component_text(text: Column) -> Column:
    """A component's text without line ends, underline marks and braces; diameters as a sign."""
    t = F.trim(text)
    for old, new in (("\\P", " "), ("%%U", ""), ("%%C", "Ø"), ("{", ""), ("}", "")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def zone_keyword_text(text: Column) -> Column:
    return F.upper(F.translate(F.trim(text), " \t'’.", ""))


def is_quantity_note(text: Column) -> Column:
    """A short count such as 4 EA or 2 x 3 SET, without Korean letters and marks."""
    t = F.trim(F.regexp_replace(text, "[\r\n]", " "))
    return (t != "") & (F.length(t) <= 32) & ~t.rlike("[ᄀ-ᇿ㄰-㆏가-힯]") & ~t.rlike("[.,:;]") & t.rlike(QUANTITY_NOTE)


def column_attributes(text: Column) -> Column:
    """Quantity, thickness and material of a column's text, each null where it says none."""
    found = lambda pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    thick = found(r"(?i)PL(\d+)", 1)
    return F.struct(
        found(r"(?i)(X|\*)\s?(\d+)", 2).alias("quantity"), F.concat(thick, F.lit("T")).alias("thickness"), F.when(F.contains(text, F.lit("SUS")), "SUS").alias("material")
    )


def is_numeric_like(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "").rlike(r"^[0-9.+\-/()]+$")


def is_vertical_text(kind: Column, rotation: Column, width: Column, height: Column) -> Column:
    """Turned by 90 or 270 degrees within 12, or much higher than wide."""
    deg = F.pmod(F.coalesce(rotation, F.lit(0.0)), F.lit(360.0))
    return K.is_text(kind) & ((F.abs(deg - 90.0) <= 12.0) | (F.abs(deg - 270.0) <= 12.0) | F.coalesce(height > width * 2.2, F.lit(False)))


def human_name_score(name: Column) -> Column:
    """How much a block's name looks chosen by a person: low for generated and dated names."""
    n = F.upper(name)
    one = lambda test, points: F.when(test, points).otherwise(0)
    return (
        one(F.startswith(n, F.lit("G$")), -4) + one(F.startswith(n, F.lit("A$")), -4) + one(F.contains(name, F.lit("!")), -2)
        + one(name.rlike(r"\b20\d{6}\b"), -2) + one(name.rlike(r"\b20\d{2}[_.]\d{2}\b"), -1)
        + one(F.contains(name, F.lit("-")), 2) + one(name.rlike("[A-Za-z]{3,}"), 2) + one(F.contains(n, F.lit("NDRC")), 1)
    )
