"""Quantities, tolerances, packages and lead times read from cells, as columns. Null means not readable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions.text import clean

_NUMBER = r"-?\d+(?:\.\d+)?"


def first_number(x: Column) -> Column:
    return F.regexp_extract(clean(x), _NUMBER, 0).try_cast("double")


def parse_quantity(x: Column, decimal_comma: bool | Column = False) -> Column:
    """Units, thousands separators and parenthesised negatives; decimal_comma is the column's convention."""
    text = clean(x)
    negative = text.startswith("(") & text.endswith(")")
    text = F.when(negative, F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)
    text = F.regexp_replace(text, r"(?i)\b(pcs?|pieces?|ea|each|nos?|qty|units?|off)\b", " ")
    body = F.trim(F.regexp_replace(text, "[xX]", " "))
    bare = F.regexp_replace(body, r"[^0-9.\-]", "")
    with_comma = F.when(body.rlike(r"^-?[\d.]+(,\d+)?$"), F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
    with_point = F.when(body.rlike(r"^-?\d+,\d{1,2}$"), F.replace(body, F.lit(","), F.lit("."))).otherwise(bare)
    number = F.when(decimal_comma, with_comma).otherwise(with_point) if isinstance(decimal_comma, Column) else with_comma if decimal_comma else with_point
    value = F.regexp_extract(number, _NUMBER, 0).try_cast("double")
    return F.when(negative, -value).otherwise(value)


def parse_tolerance(x: Column) -> Column:
    """Percent, from a number with a percent sign or from a letter code."""
    text = clean(x)
    letters = F.create_map(*[F.lit(v) for kv in C.TOLERANCE_LETTERS.items() for v in kv])
    return F.coalesce(F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double"), F.try_element_at(letters, F.upper(text)))


def normalize_package(x: Column) -> Column:
    """One name for a footprint: library prefixes go, chip sizes are imperial, known packages take their hyphen."""
    table = lambda m: F.expr("map(" + ", ".join(f"'{v}'" for kv in m.items() for v in kv) + ")")
    metric, alias = table(C.METRIC_CHIPS), table(C.PACKAGE_ALIASES)
    imperial = tuple(C.METRIC_CHIPS.values())
    text = F.regexp_replace(F.upper(clean(x)), r"^(FOOTPRINT|PKG|PACKAGE|LIB|SM|SMD|SMT)[_\-: ]+", "")
    text = F.regexp_replace(F.translate(text, "_", "-"), r"^[- ]+|[- ]+$", "")
    ipc = F.regexp_extract(text, r"^(RES|CAP|IND|DIO|LED)[CM]?(\d{4})[XN]?", 2)
    bare = F.regexp_replace(text, "[^A-Z0-9]", "")
    lead = F.regexp_extract(text, r"^(\d{4,5})\b", 1)
    return F.coalesce(
        F.try_element_at(metric, ipc),
        F.when(bare.isin(*imperial), bare),
        F.when(bare.endswith("M"), F.try_element_at(metric, F.regexp_replace(bare, "M$", ""))),
        F.try_element_at(metric, bare),
        F.try_element_at(alias, bare),
        F.when(lead.isin(*imperial), lead),
        F.try_element_at(metric, lead),
        text,
    )


def packages_equivalent(a: Column, b: Column) -> Column:
    """True, false, or null where the two say too little to compare."""
    return same_package(normalize_package(a), normalize_package(b))


def same_package(a: Column, b: Column) -> Column:
    """packages_equivalent of names that are normalised already."""
    generic = ("THT", "SMD", "SMT", "SMDSMT", "THROUGHHOLE", "SURFACEMOUNT", "MODULE", "SMDMODULE", "BULK", "RADIAL", "AXIAL", "PANEL", "CHASSIS", "BOARD", "MECHANICAL", "HARDWARE", "N/A", "NA", "OTHER", "CUSTOM", "STANDARD", "NONSTANDARD", "SMDPACKAGE", "PCB")  # fixed values
    vague = lambda x: (x == "") | F.regexp_replace(x, "[^A-Z0-9]", "").isin(*generic)
    return F.when(vague(a) | vague(b), None).when(a == b, True).when((F.length(a) < 3) | (F.length(b) < 3), None).otherwise(False)


def parse_lead_time_days(x: Column) -> Column:
    """Days; 0 from stock, null where unknown or out of stock. Ranges count by their middle."""
    text = F.lower(clean(x))
    shape = r"(\d+(?:\.\d+)?)\s*(?:-|to)?\s*(\d+(?:\.\d+)?)?\s*(day|days|d|week|weeks|wk|wks|w|month|months|mo|year|years)"
    low, high = F.regexp_extract(text, shape, 1).try_cast("double"), F.regexp_extract(text, shape, 2).try_cast("double")
    unit = F.substring(F.regexp_extract(text, shape, 3), 1, 1)
    factor = F.when(unit == "d", 1).when(unit == "w", 7).when(unit == "m", 30).otherwise(365)
    return (
        F.when((text == "") | text.rlike("out of stock|no stock|not in stock|0 in stock|backorder|back order|on order|non-stock|unavailable"), None)
        .when(text.rlike("stock|immediate|ready|available now|same day"), 0)
        .when(low.isNotNull(), F.bround((low + F.coalesce(high, low)) / 2 * factor).cast("int"))
        .otherwise(F.regexp_extract(text, r"\d+", 0).try_cast("int"))
    )


def format_lead_time(days: Column) -> Column:
    text = lambda n, unit: F.concat(n.cast("int").cast("string"), F.lit(unit))
    return F.when(days.isNull(), "").when(days <= 0, "In stock").when(days < 14, text(days, " d")).when(days < 120, text(F.bround(days / 7), " wk")).otherwise(text(F.bround(days / 30), " mo"))
