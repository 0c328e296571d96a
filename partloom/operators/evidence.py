"""A part's dossier from several sources: whose word counts, what they disagree on, how sure and how risky it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions.vocab import rank_of
from partloom.operators.history import trends

#: What a source may claim about a part.
FACTS = ("mpn", "manufacturer", "description", "package", "lifecycle", "rohs", "reach")


def _said(fact: str) -> Column:
    return F.nullif(F.col(fact), F.lit(""))


def _weighed(claims: DataFrame, facts: tuple[str, ...]) -> DataFrame:
    """Each claim beside the winning value of every fact, in one shuffle: the most authoritative source's, ties by name.

    An unknown lifecycle never wins, but is a claim like any other.
    """
    of_part = W.partitionBy("part_id").orderBy("source_rank", "source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = claims.withColumn("source_rank", F.coalesce(rank_of(F.col("source_type"), C.SOURCE_RANK), F.lit(2)))
    wins = lambda f: F.nullif(_said(f), F.lit("Unknown")) if f == "lifecycle" else _said(f)
    won = {f"won_{f}": F.first(F.when(wins(f).isNotNull(), F.struct(F.col(f).alias("value"), "source", "source_rank")), ignorenulls=True).over(of_part) for f in facts}
    got = ranked.withColumns(won)
    differs = lambda f: F.coalesce(_said(f) != F.col(f"won_{f}.value"), F.lit(False))
    total = lambda conds: sum((F.coalesce(c, F.lit(False)).cast("int") for c in conds), F.lit(0))
    return got.withColumns({
        "claimed": total([_said(f).isNotNull() for f in facts]),
        "contested": total([differs(f) for f in facts]),
        "conflicts": total([differs(f) & (F.col("source_rank") >= F.col(f"won_{f}.source_rank")) for f in facts]),
    })


def evidence(claims: DataFrame, facts: tuple[str, ...] = FACTS) -> DataFrame:
    """What each source's word is worth. claims: part_id, source, source_type, confidence (thousandths) and the facts."""
    agreed, mock = F.col("contested") == 0, F.col("source_type") == "mock"
    status = F.when((F.col("claimed") == 0) | mock & ~agreed, "unknown").when(agreed & (mock | (F.col("confidence") >= 500)), "verified").when(~agreed, "conflicting").otherwise("unknown")
    return _weighed(claims, facts).select("part_id", "source", "claimed", "contested", "conflicts", status.alias("status"))


def merged_facts(claims: DataFrame, facts: tuple[str, ...] = FACTS) -> DataFrame:
    """One record a part: the winning facts, who said them, the number of conflicts, the confidence in thousandths."""
    weight = F.element_at(F.array(F.lit(6), F.lit(3), F.lit(2)), F.col("source_rank") + 1)  # 1, 1/2, 1/3
    share = F.when(F.max((F.col("source_type") == "mock").cast("int")) == 1, 85).otherwise(100)
    sure = F.sum(F.col("confidence") * weight) * share
    return _weighed(claims, facts).groupBy("part_id").agg(
        *[F.coalesce(F.first(f"won_{f}.value"), F.lit("")).alias(f) for f in facts],
        F.coalesce(F.first("won_lifecycle.source"), F.lit("")).alias("lifecycle_source"),
        F.sum("conflicts").alias("conflicts"),
        F.floor((sure * 2 + F.sum(weight) * 100) / (F.sum(weight) * 200)).cast("long").alias("confidence"),
    )


def first_available(offers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the offers with the same keys the first that is available, else the first."""
    row = W.partitionBy(*keys).orderBy(F.desc("available"), order)
    return offers.withColumn("r", F.row_number().over(row)).where("r = 1").drop("r")


def dossier_usd(micro: Column, currency: Column) -> Column:
    """Dollars at the dossier's own rates, to four decimals; an unknown currency counts as dollars."""
    rate = F.coalesce(rank_of(F.upper(currency), C.DOSSIER_RATES), F.lit(10000)).cast("long")
    return F.floor((micro * rate + 500_000) / 1_000_000).cast("long") * 100


def part_risk(parts: DataFrame, snapshots: DataFrame, offers: DataFrame, since: str) -> DataFrame:
    """Six shares of risk, in thousandths, and a score from 0 to 100 for every part. Snapshots from since on are current.

    Snapshots fold to one row a part and distributor before they meet the offers. Halves of a point are rounded up.
    """
    now = F.col("checked_at") >= F.lit(since).cast("timestamp_ntz")
    held = now & F.col("available")
    vendor = snapshots.groupBy("part_id", "supp_id").agg(F.count_if(now).alias("seen"), F.coalesce(F.sum(F.when(held, F.col("available_qty"))), F.lit(0)).alias("qty"), F.count_if(held).alias("held"))
    moved = trends(snapshots).where("points >= 2").select("part_id", "supp_id", "change_permille")
    lead = offers.select("part_id", "supp_id", F.when(F.col("stock") <= 0, F.floor((F.col("factory_lead_days") * 200 + 7) / 14)).alias("weeks"))
    both = vendor.join(moved, ["part_id", "supp_id"], "left").join(lead, ["part_id", "supp_id"], "left")
    timed = F.when(F.col("weeks").isNotNull(), F.col("seen")).otherwise(0)
    of_part = both.groupBy("part_id").agg(
        F.sum("seen").alias("seen"), F.sum("qty").alias("qty"), F.count_if(F.col("held") > 0).alias("vendors"), F.sum("change_permille").alias("change"), F.count("change_permille").alias("moved"),
        F.sum(F.coalesce("weeks", F.lit(0)) * timed).alias("weeks"), F.sum(timed).alias("timed"),
    )
    got, known, current = parts.join(of_part, "part_id", "left"), F.col("seen").isNotNull(), F.col("seen") > 0
    mean = F.floor((F.col("weeks") * 2000 + F.col("timed") * 5200) / (F.col("timed") * 10400)).cast("long")
    shares = {
        "lifecycle_risk": F.coalesce(rank_of(F.col("lifecycle"), C.DOSSIER_LIFECYCLE), F.lit(500)),
        "stock_risk": F.when(current, 1000 - F.least(F.lit(1000), F.col("qty"))).when(known, 500).otherwise(800),
        "lead_risk": F.when(current & (F.col("timed") > 0), F.least(F.lit(1000), mean)).when(current, 800).when(known, 500).otherwise(900),
        "vendor_risk": F.when(F.col("vendors") >= 3, 0).when(F.col("vendors") == 2, 400).when(F.col("vendors") == 1, 700).otherwise(1000),
        "trend_risk": F.when(F.col("moved") > 0, F.when(F.col("change") > F.col("moved") * 50, 900).otherwise(200)).otherwise(500),
        "maker_risk": F.when(F.coalesce("manufacturer", F.lit("")) != "", 0).otherwise(1000),
    }
    got = got.select("part_id", *[x.cast("long").alias(c) for c, x in shares.items()])
    points = sum((F.col(c) * w for c, w in zip(shares, C.DOSSIER_WEIGHTS, strict=True)), F.lit(0))
    got = got.withColumn("score", F.floor((points + 500) / 1000).cast("long"))
    return got.withColumn("level", F.when(F.col("score") < 25, "LOW").when(F.col("score") < 50, "MEDIUM").when(F.col("score") < 75, "HIGH").otherwise("CRITICAL"))
