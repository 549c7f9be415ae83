"""Column functions on drawing texts: clean-up, quantities, attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and keywords of the text rules.
INLINE_QTY = r"(?i)\b(Q['’]?\s*TY|QTY|Q'TY|QUANTITY|수량)\b\s*[:=]?\s*(\d{1,4})\b"
UNIT_QTY = r"(?i)\b(\d{1,4})\s*(EA|PCS|SET)\b"
TIMES_QTY = r"(?i)\b[X×]\s*(\d{1,4})\s*(SET|EA|PCS)?\b"
PURE_INT = r"^\s*(\d{1,4})\s*$"
NOT_QTY = ("THRU", "TAP", "C'BORE", "CBORE", "CBOR", "R", "Ø", "PHI", "M3", "M4", "M5", "M6", "M8", ".")
METAL = r"(?i)(SS400|SUS\d+|AL|SM45C|S\d+C|SPCC|SHP|GI|STS\d+)"
FINISH = r"(?i)(아연도금|Zn\s*도금|Paint|Mirror)"
THICK = r"(?i)(\d+(\.\d+)?)\s*(T|thk)"
THICK_AFTER = r"(?i)(T|thk)\s*(\d+(\.\d+)?)"
FORMULA = r"(\d+)\s*[\*xX]\s*(\d+)"
SIMPLE_QTY = r"(?i)(\d+)\s*(EA|개|SET|수량)"
META_LABELS = ("QTY", "Q'TY", "MAT", "MATERIAL", "THK", "SCALE", "SPEC", "DESCRIPTION", "DWG", "TITLE", "UNIT", "REMARK", "NO", "NAME")
SIMPLE_LABELS = ("QTY", "QUANTITY", "MAT", "MATERIAL", "THK", "T", "DWG", "NO")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normalize_cad_text(text: Column) -> Column:
    t = F.replace(text, F.lit("\\P"), F.lit(" "))
    for mark in ("%%U", "%%u"):
        t = F.replace(t, F.lit(mark), F.lit(""))
    for mark in ("%%C", "%%c"):
        t = F.replace(t, F.lit(mark), F.lit("Ø"))
    return F.trim(F.regexp_replace(F.translate(t, "\r\n", "  "), " {2,}", " "))


def strip_format_codes(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:[A-Z][^;]*;|.)|[{}]", "")


def quantity_rules(text: Column) -> tuple[Column, Column]:
    """Quantity and rule of a text that carries one inline: label, unit or times."""
    q1 = found(text, INLINE_QTY, 2).cast("int")
    q2 = found(text, UNIT_QTY, 1).cast("int")
    q3 = found(text, TIMES_QTY, 1).cast("int")
    ok = lambda q: q.isNotNull() & (q > 0)
    quantity = F.when(ok(q1), q1).when(ok(q2), q2).when(ok(q3), q3)
    rule = F.when(ok(q1), "label").when(ok(q2), "unit").when(ok(q3), "times")
    return quantity, rule


def standalone_quantity(text: Column) -> Column:
    parts = [found(text, p, 1).cast("int") for p in (PURE_INT, UNIT_QTY, TIMES_QTY)]
    return F.coalesce(*[F.when(p > 0, p) for p in parts])


def is_engineering_text(text: Column) -> Column:
    """Texts that look like notes on features, never like quantities: by substring, so any
    letter R and any dot count."""
    t = F.upper(text)
    out = t.rlike(r"^\s*\d+\s*[-].+$")
    for w in NOT_QTY:
        out = out | F.contains(t, F.lit(w))
    return out


def part_attributes(text: Column) -> dict[str, Column]:
    """Material, thickness and quantity of a part's joined texts."""
    t = F.regexp_replace(text, r"\\[A-Z].*?;", " ")
    thick = F.coalesce(found(t, THICK, 1), found(t, THICK_AFTER, 2))
    product = found(t, FORMULA, 1).cast("bigint") * found(t, FORMULA, 2).cast("bigint")
    return {
        "material": F.coalesce(F.upper(found(t, METAL)), F.upper(found(t, FINISH)), F.lit("UNKNOWN")),
        "thickness": F.coalesce(thick.cast("double"), F.lit(0.0)),
        "quantity": F.coalesce(product, found(t, SIMPLE_QTY, 1).cast("bigint"), F.lit(1).cast("bigint")),
    }


def is_meta_label(text: Column) -> Column:
    out = F.lit(False)
    for w in META_LABELS:
        out = out | F.contains(text, F.lit(w))
    return out


def is_meta_value(text: Column) -> Column:
    shape = text.rlike(r"^[A-Z0-9\-\._/ ]{1,40}$") | text.rlike(r"^\d+(\.\d+)?$") | text.rlike(r"^\d+\s*[Xx]\s*\d+$")
    return (F.trim(text) != "") & ~is_meta_label(text) & shape


def is_title_text(text: Column) -> Column:
    return (F.trim(text) != "") & ~is_meta_label(text) & ~is_meta_value(text) & (F.length(text) >= 4)


def measured_value(text: Column) -> Column:
    return found(text, r"[-+]?\d+(\.\d+)?").cast("double")


def digits_or_one(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("int"), F.lit(1))


def dimension_kind(text: Column) -> Column:
    t = F.upper(F.coalesce(text, F.lit("")))
    return F.when(F.contains(t, F.lit("R")), "Radial").when(F.contains(t, F.lit("Ø")) | F.contains(t, F.lit("%%C")), "Diametric").otherwise("Linear")
