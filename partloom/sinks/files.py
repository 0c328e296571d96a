"""Results as files: CSV that a spreadsheet won't run as formulas, and JSON. One file a task; nothing goes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import csv_safe, normalize_mpn


def safe_cells(df: DataFrame) -> DataFrame:
    """Every column as text: arrays joined, nulls blank, formulas disarmed."""
    out = []
    for f in df.schema.fields:
        kind, x = f.dataType.typeName(), F.col(f"`{f.name}`")
        text = F.array_join(x.cast("array<string>"), ", ") if kind == "array" and f.dataType.elementType.typeName() not in ("struct", "map", "array") else F.to_json(x) if kind in ("array", "struct", "map") else x.cast("string")
        text = F.coalesce(text, F.lit(""))
        out.append((csv_safe(text) if kind == "string" else text).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists") -> None:
    safe_cells(df).write.mode(mode).option("header", True).option("sep", delimiter).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def quote_rows(scored: DataFrame) -> DataFrame:
    """What to ask distributors for: populated lines with a part number and the quantity the build needs."""
    return scored.where(~F.col("dnp") & (normalize_mpn(F.col("mpn")) != "")).select("bom_id", "source_row", csv_safe(F.col("mpn")).alias("mpn"), csv_safe(F.col("manufacturer")).alias("manufacturer"), F.col("required").alias("quantity"))


def compliance_exceptions(scored: DataFrame) -> DataFrame:
    """Lines that aren't plainly compliant: by RoHS, by REACH or by export control."""
    fine = (F.col("rohs") == "Compliant") & F.col("reach").isin("Compliant", "Unknown") & (F.col("eccn") == "EAR99")
    return scored.where(~F.coalesce(fine, F.lit(False))).select("bom_id", "source_row", "part_id", "rohs", "reach", "eccn")
