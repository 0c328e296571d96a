"""Supply risk of lines, and the health of whole BOMs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions.vocab import grade, rank_of, risk_level

FACTORS = tuple(C.WEIGHTS)


def tenth(x: Column) -> Column:
    """Half up to one decimal, by the same two operations in every engine."""
    return F.floor(x * 10 + 0.5) / 10


def factor_columns(require_rohs: bool = True, require_reach: bool = False) -> dict[str, Column]:
    """The seven factors, 0 (no risk) to 100, over a line with its part, supply, match and cost columns."""
    known = F.col("lifecycle").isNotNull()
    state = rank_of(F.col("lifecycle"), C.LIFECYCLE_RISK)
    need10 = F.col("required") * (100 + C.STOCK_BUFFER_PCT)
    cover = lambda n, d=1: F.col("stock") * 100 * d >= need10 * n
    deep = F.when(cover(10), 0).when(cover(3), 8).when(cover(3, 2), 20).when(cover(1), 38).when(cover(1, 2), 62).otherwise(85).cast("double")
    deep = F.when(F.col("stock") <= 0, 100.0).when(F.col("stocking") >= 3, deep * 0.8).when(F.col("stocking") == 1, F.least(deep + 8, F.lit(100.0))).otherwise(deep)
    # Only authorised distributors count as sources; stock at others alone is worse than none.
    n = F.col("authorized_stocking")
    wide = F.when((n == 0) & (F.col("authorized_listed") == 0), 100.0).when(n == 0, 82.0).when(n == 1, 58.0).when(n < C.MIN_SOURCES, 40.0).when(n == C.MIN_SOURCES, 18.0).otherwise(F.greatest(F.lit(0.0), 14 - 2.5 * (n - C.MIN_SOURCES)))
    wide = F.when((n == 0) & (F.col("stocking") > 0), F.least(wide + 8, F.lit(100.0))).otherwise(wide)
    d, warn, worst = F.col("lead_days"), C.LEAD_WARN_DAYS, C.LEAD_CRITICAL_DAYS
    lead = F.when(d.isNull(), 50.0).when(d <= 0, 0.0).when(d >= worst, 100.0).when(d >= warn, 55 + 45 * (d - warn) / (worst - warn)).otherwise(55 * d / warn)
    rohs = F.when(F.col("rohs") == "Non-compliant", 85 if require_rohs else 30).when(F.col("rohs") == "Exempt", 20).when(F.col("rohs") == "Unknown", 35 if require_rohs else 0).otherwise(0)
    reach = F.when(F.col("reach") == "Non-compliant", 55 if require_reach else 22).when(F.col("reach") == "Unknown", 28 if require_reach else 0).otherwise(0)
    law = F.least(rohs + reach + F.when(F.col("eccn") != "EAR99", 35).otherwise(0), F.lit(100))
    data = F.when(F.col("kind") == "none", 100.0).otherwise(F.least(F.lit(85.0), 1.6 * F.greatest(C.REVIEW_CONFIDENCE - F.col("confidence"), F.lit(0))))
    data = F.least(data + 22 * F.col("errors") + 7 * F.col("warnings"), F.lit(100.0))
    gap = F.col("high") - F.col("low")
    spread = F.when(gap > 2 * F.col("low"), 55.0).when(gap * 10 > 8 * F.col("low"), 30.0).when(gap * 10 > 3 * F.col("low"), 12.0).otherwise(0.0)
    price = F.when(F.col("unit_micro").isNull(), 60.0).otherwise(F.coalesce(spread, F.lit(0.0)) + F.when(F.col("overbuy") > 2 * F.col("required"), 30.0).when(F.col("overbuy") * 2 > F.col("required"), 15.0).otherwise(0.0) + F.when(~F.col("covers"), 40.0).otherwise(0.0))
    return {
        "lifecycle": F.when(known, F.when(state >= 65, state + 4).otherwise(state).cast("double")).otherwise(55.0), "availability": F.when(known, deep).otherwise(55.0), "sourcing": F.when(known, wide).otherwise(55.0),
        "lead_time": F.when(known, lead).otherwise(45.0), "compliance": F.when(known, law.cast("double")).otherwise(40.0), "data_quality": data, "cost": price,
    }


def score_lines(lines: DataFrame) -> DataFrame:
    """Each line with its factors (f_...), score and level. A line that is not populated has no risk."""
    out = lines.withColumns({f"f_{k}": F.least(v, F.lit(100.0)) for k, v in factor_columns().items()})
    total = sum(C.WEIGHTS.values())
    score = None
    for k, w in C.WEIGHTS.items():
        score = F.col(f"f_{k}") * w if score is None else score + F.col(f"f_{k}") * w
    score = score / total
    grave = F.greatest(*[F.col(f"f_{k}") for k in FACTORS])
    worst = F.element_at(F.array(*map(F.lit, FACTORS)), F.array_position(F.array(*[F.col(f"f_{k}") for k in FACTORS]), grave).cast("int"))  # the first of equal ones
    decisive = (grave >= 95) & worst.isin("lifecycle", "availability", "sourcing", "compliance")
    score = F.when(decisive, F.greatest(score, F.lit(72.0))).when((grave >= 85) & worst.isin("lifecycle", "availability"), F.greatest(score, F.lit(55.0))).otherwise(score)
    floor = F.when(F.col("lifecycle") == "NRND", 30.0).when(F.col("lifecycle") == "EOL", 52.0).when(F.col("lifecycle") == "Obsolete", 72.0).when((F.col("lifecycle") == "Unknown") & (F.col("kind") != "none"), 25.0).when(F.col("lifecycle").isNull() & F.col("has_part"), 45.0).otherwise(0.0)
    score = F.when(F.col("dnp"), 0.0).otherwise(F.greatest(score, floor))
    return out.withColumn("raw_score", score).withColumns({"score": tenth(F.col("raw_score")), "level": risk_level(F.col("raw_score"))}).drop("raw_score")


def long_factors(scored: DataFrame, keys: Sequence[str] = ("bom_id", "source_row")) -> DataFrame:
    """keys, code, score, weight: a row a factor."""
    return scored.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("code"), F.col(f"f_{k}").alias("factor_score"), F.lit(w).alias("weight")) for k, w in C.WEIGHTS.items()])))


def flags() -> Column:
    """Badges of a line, in order."""
    return F.array_compact(F.array(
        F.when(F.col("dnp"), "DNP"), F.when(F.col("lifecycle").isin("NRND", "EOL", "Obsolete"), F.col("lifecycle")), F.when((F.col("authorized_listed") == 0) & (F.col("stock") > 0), "Broker only"), F.when(F.col("lifecycle") == "Unknown", "Lifecycle unknown"), F.when(F.col("stock") <= 0, "No stock"),
        F.when((F.col("stock") > 0) & (F.col("stocking") == 1), "Single source"), F.when(F.col("lead_days") >= C.LEAD_WARN_DAYS, "Long lead"), F.when(F.col("rohs") == "Non-compliant", "Not RoHS"), F.when(F.col("rohs") == "Exempt", "RoHS exempt"),
        F.when(F.col("reach") == "Non-compliant", "REACH SVHC"), F.when(F.col("eccn") != "EAR99", "Export controlled"), F.when(F.col("kind") == "none", "No data"), F.when((F.col("kind") != "none") & (F.col("confidence") < C.REVIEW_CONFIDENCE), "Review match"),
        F.when(F.col("errors") > 0, "Data error"), F.when(F.col("overbuy") * 2 > F.col("required"), "MOQ overbuy"),
    ))


def health(scored: DataFrame) -> DataFrame:
    """Component and total health of each BOM, with penalties that no average hides."""
    live = scored.where(~F.col("dnp")).withColumn("w", F.greatest(F.lit(1.0), F.col("quantity")).cast("decimal(18,6)"))
    used = [k for k in FACTORS if k != "cost"]
    got = live.groupBy("bom_id").agg(
        *[F.sum(F.floor(F.col(f"f_{k}") * 1000 + 0.5).cast("decimal(6,0)") * F.col("w")).alias(k) for k in used], F.sum("w").alias("w"), F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("lifecycle") == "Obsolete").alias("obsolete"), F.count_if(F.col("lifecycle").isNotNull() & (F.col("stock") <= 0)).alias("no_stock"), F.count_if(F.col("kind") == "none").alias("unmatched"), F.count_if(F.col("rohs") == "Non-compliant").alias("non_rohs"),
    )
    # 100 less the mean of whole thousandths, half up to a tenth: exact, so neither the order of adding nor a double's error decides a tie.
    got = got.withColumns({k: F.expr(f"(100050 * w - {k}) div (100 * w)") / 10 for k in used}).drop("w")
    score = None
    for k in used:
        score = F.col(k) * C.WEIGHTS[k] if score is None else score + F.col(k) * C.WEIGHTS[k]
    penalty = F.least(F.lit(18.0), 4.0 * F.col("obsolete")) + F.least(F.lit(15.0), 2.0 * F.col("no_stock")) + F.least(F.lit(20.0), 40.0 * F.col("unmatched") / F.col("lines")) + F.least(F.lit(12.0), 3.0 * F.col("non_rohs"))
    got = got.withColumn("raw", F.greatest(F.lit(0.0), score / sum(C.WEIGHTS[k] for k in used) - penalty))
    return got.withColumns({"score": tenth(F.col("raw")), "grade": grade(F.col("raw"))}).drop("raw")


def counters(scored: DataFrame) -> DataFrame:
    """How many lines have each lifecycle, level and RoHS state: three histograms in one pass."""
    rows = scored.select("bom_id", F.coalesce("lifecycle", F.lit("No data")).alias("lifecycle"), "level", F.coalesce("rohs", F.lit("Unknown")).alias("rohs"))
    got = rows.groupingSets([["bom_id", "lifecycle"], ["bom_id", "level"], ["bom_id", "rohs"]], "bom_id", "lifecycle", "level", "rohs").agg(F.count(F.lit(1)).alias("n"), F.grouping("lifecycle").alias("gl"), F.grouping("level").alias("gv"))
    name = F.when(F.col("gl") == 0, "lifecycle").when(F.col("gv") == 0, "level").otherwise("rohs")
    return got.select("bom_id", name.alias("counter"), F.coalesce("lifecycle", "level", "rohs").alias("bucket"), "n")


def top_risks(scored: DataFrame, n: int = 10) -> DataFrame:
    """The riskiest populated lines of each BOM and what drives each."""
    row = W.partitionBy("bom_id").orderBy(F.desc("score"), F.desc("quantity"), "source_row")
    driver = F.array_max(F.array(*[F.struct(F.col(f"f_{k}").alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("code")) for i, k in enumerate(FACTORS)]))["code"]
    return scored.where("not dnp and score > 0").withColumn("place", F.row_number().over(row)).where(F.col("place") <= n).select("bom_id", "place", "source_row", "score", driver.alias("driver"))
