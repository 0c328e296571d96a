"""Issues of analysed lines and of whole BOMs, a row each, and the summary that the latter follow from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.operators.risk import long_factors

Found = list[tuple[str, Column, Column]]  # code, condition, severity


def _rows(df: DataFrame, keys: list[str], found: Found) -> DataFrame:
    """keys, code, severity: a row for each condition that holds. One pass, no shuffle."""
    each = F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), severity.alias("severity"))) for code, cond, severity in found])
    return df.select(*keys, F.explode(F.array_compact(each)).alias("i")).select(*keys, "i.code", "i.severity")


LINE = ["bom_id", "source_row"]


def _level(error: Column) -> Column:
    return F.when(error, "error").otherwise("warning")


def compliance_issues(scored: DataFrame, require_rohs: bool = True, require_reach: bool = False) -> DataFrame:
    """What the law may hold against populated lines with a part. Origin, tariff code and moisture level count if the lines
    have such columns (origin, hts, msl)."""
    warning, info = F.lit("warning"), F.lit("info")
    found: Found = [
        ("rohs_non_compliant", F.col("rohs") == "Non-compliant", F.lit("error" if require_rohs else "warning")), ("rohs_exempt", F.col("rohs") == "Exempt", warning),
        ("rohs_unknown", (F.col("rohs") == "Unknown") & F.lit(require_rohs), warning), ("reach_svhc", F.col("reach") == "Non-compliant", F.lit("error" if require_reach else "warning")),
        ("reach_unknown", (F.col("reach") == "Unknown") & F.lit(require_reach), warning), ("export_controlled", F.col("eccn") != "EAR99", warning),
    ]
    if "origin" in scored.columns:
        found.append(("origin_review", F.upper(F.substring("origin", 1, 2)).isin(*C.REVIEW_ORIGINS), warning))
    if "hts" in scored.columns:
        found.append(("hts_missing", (F.coalesce("hts", F.lit("")) == "") & (F.col("listed") > 0), info))
    if "msl" in scored.columns:
        found.append(("msl_handling", ~F.coalesce("msl", F.lit("")).isin("", "1", "MSL1", "MSL 1"), info))
    return _rows(scored.where(~F.col("dnp") & F.col("lifecycle").isNotNull()), LINE, found)


def match_issues(scored: DataFrame, review: int = C.REVIEW_CONFIDENCE) -> DataFrame:
    hit = F.col("kind") != "none"
    return _rows(scored, LINE, [
        ("no_catalogue_match", ~hit & F.col("has_part") & ~F.col("dnp"), F.lit("error")), ("match_needs_review", hit & (F.col("confidence") < review), _level(F.col("confidence") < 60)),
        ("match_packaging_variant", F.col("kind") == "root", F.lit("info")), ("match_from_description", F.col("kind") == "description", F.lit("warning")),
    ])


def risk_issues(scored: DataFrame) -> DataFrame:
    """A row for each factor of 60 and more of a populated line."""
    long = long_factors(scored.where(~F.col("dnp"))).where(F.col("factor_score") >= 60)
    return long.select(*LINE, F.concat(F.lit("risk_"), "code").alias("code"), _level(F.col("factor_score") >= 85).alias("severity"))


def summary(scored: DataFrame, review: int = C.REVIEW_CONFIDENCE, warn_days: int = C.LEAD_WARN_DAYS) -> DataFrame:
    """The figures of each BOM that its issues follow from."""
    live, hit, known = ~F.col("dnp"), F.col("kind") != "none", F.col("lifecycle").isNotNull()
    wanted = live & (F.col("required") > 0)
    return scored.groupBy("bom_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(live).alias("live"), F.count_if(hit).alias("matched"), F.count_if(live & ~hit & F.col("has_part")).alias("unmatched"), F.count_if(hit & (F.col("confidence") < review)).alias("review"),
        F.count_if(live & known & (F.col("stocking") == 1)).alias("single_source"), F.count_if(live & known & (F.col("stock") <= 0)).alias("out_of_stock"), F.count_if(live & known & (F.col("stock") <= 0) & (F.col("lead_days") >= warn_days)).alias("long_lead"),
        F.max(F.when(live & known, F.col("lead_days"))).alias("max_lead_days"), F.count_if(wanted).alias("to_cost"), F.count_if(wanted & F.col("unit_micro").isNotNull()).alias("costed"),
        F.count_if(live & (F.col("rohs") == "Non-compliant")).alias("blockers"), F.count_if(live & F.coalesce(F.col("rohs") != "Unknown", F.lit(False))).alias("declared"), F.count_if(live & (F.col("eccn") != "EAR99")).alias("export"),
    )


def bom_issues(figures: DataFrame) -> DataFrame:
    """bom_id, code, severity from the summary."""
    n, warning = F.col, F.lit("warning")
    return _rows(figures, ["bom_id"], [
        ("unmatched_lines", n("unmatched") > 0, _level(n("unmatched") * 4 > n("live"))), ("matches_need_review", n("review") > 0, warning), ("out_of_stock", n("out_of_stock") > 0, _level(n("out_of_stock") > 2)),
        ("single_source", n("single_source") > 0, warning), ("long_lead", n("long_lead") > 0, warning), ("cost_coverage", n("costed") * 100 < n("to_cost") * 90, warning),
        ("compliance_blockers", n("blockers") > 0, F.lit("error")), ("compliance_coverage_low", n("declared") * 100 < n("live") * 80, warning), ("compliance_export", n("export") > 0, warning),
    ])
