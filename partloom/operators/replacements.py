"""Replacements of a part: drop-in or functional, by category, package, electrical limits and supply.

A score depends on a part's traits alone, so traits are scored against traits and parts are only looked up afterwards: no
pair of parts is made that isn't among the best. The number of trait combinations grows with the vocabulary, not the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions.vocab import rank_of

TRAITS = ("category", "package_key", "voltage", "lifecycle", "available")
_NUMBER = r"([-+]?\d*\.?\d+)"
_RANGE = r"(\d+(?:\.\d+)?)\s*(?:-|to|…)\s*(\d+(?:\.\d+)?)"


def category_group(category: Column) -> Column:
    """The function group of a category: by the first keyword in it, else its first word."""
    low, out = F.lower(F.coalesce(category, F.lit(""))), None
    for word, group in C.CATEGORY_GROUPS.items():
        out = F.when(low.contains(word), group) if out is None else out.when(low.contains(word), group)
    return out.when(low == "", "unknown").otherwise(F.split(category, " ")[0])


def limits(text: Column) -> Column:
    """low, high of a range such as 3-5, both the number where there is one only, null where there is none."""
    low, high, one = (F.regexp_extract(text, p, i).try_cast("double") for p, i in ((_RANGE, 1), (_RANGE, 2), (_NUMBER, 1)))
    return F.when(text.rlike(_RANGE), F.struct(low.alias("low"), high.alias("high"))).otherwise(F.struct(one.alias("low"), one.alias("high")))


def covers(wanted: Column, offered: Column) -> Column:
    """Whether the limits offered hold those wanted; what is not given is no objection."""
    w, o = limits(wanted), limits(offered)
    inside = (w["low"] >= o["low"] - 1e-9) & (w["high"] <= o["high"] + 1e-9)
    return F.when((F.coalesce(wanted, F.lit("")) == "") | (F.coalesce(offered, F.lit("")) == ""), True).when(w["low"].isNull(), o["low"].isNull()).when(o["low"].isNull(), True).otherwise(inside)


def best(parts: DataFrame, limit: int = 12) -> DataFrame:
    """part_id, place, candidate_id, kind, score (thousandths): the best parts of the same function group.

    parts: part_id, mpn and the traits. Drop-ins come first, then by score and part number. Candidates outside the group,
    which could only be parametric, are not offered. Equal part numbers are the same part and never candidates.
    """
    keyed = parts.withColumn("package_key", F.regexp_replace(F.upper(F.coalesce("package", F.lit(""))), "[- ]", "")).select("part_id", F.upper("mpn").alias("mpn"), *TRAITS)
    kept = limit + 1  # one may be the part itself
    row = W.partitionBy(*TRAITS).orderBy("mpn", "part_id")
    # Of parts that share a number the first stands for all.
    offered = keyed.groupBy("mpn").agg(F.min(F.struct("part_id", *TRAITS)).alias("first")).select("mpn", "first.*").withColumn("r", F.row_number().over(row)).where(F.col("r") <= kept)
    classes = keyed.select(*TRAITS).distinct().withColumn("group", category_group(F.col("category")))
    t = classes.select("group", *[F.col(c).alias(f"t_{c}") for c in TRAITS])
    c = classes.select("group", *[F.col(c).alias(f"c_{c}") for c in TRAITS])
    pairs = t.join(c.hint("merge"), "group")
    same_package, same_category = F.col("t_package_key") == F.col("c_package_key"), F.lower("t_category") == F.lower("c_category")
    volts = covers(F.col("t_voltage"), F.col("c_voltage"))
    risk = F.coalesce(rank_of(F.col("c_lifecycle"), C.DOSSIER_LIFECYCLE), F.lit(500))
    # In hundred-thousandths; three of the four electrical windows are not known here, which is no objection.
    raw = 35_000 + F.when(same_category, 15_000).otherwise(0) + F.when(same_package, 25_000).otherwise(0) + F.when(volts, 10_000).otherwise(3_500) + 20_000 + (1000 - risk) * 5 + F.when(F.col("c_available"), 5_000).otherwise(3_000)
    half_up = lambda x, by: F.floor((x + by // 2) / by).cast("long")
    known = F.coalesce("c_voltage", F.lit("")) != ""
    drop_in = same_package & same_category & volts & ((F.coalesce("t_voltage", F.lit("")) == "") | known)
    score = half_up(F.least(raw, F.lit(100_000)), 100)
    score = F.when(drop_in & ~known, half_up(score * 8, 10)).otherwise(score)
    score = F.when(risk > 0, half_up(score * (100_000 - risk * 15), 100_000)).otherwise(score)
    scored = pairs.select(*[f"t_{x}" for x in TRAITS], *[f"c_{x}" for x in TRAITS], F.when(drop_in, "DROP_IN").otherwise("FUNCTIONAL").alias("kind"), score.alias("score"))
    one = offered.select(F.col("mpn").alias("candidate_mpn"), F.col("part_id").alias("candidate_id"), *[F.col(x).alias(f"c_{x}") for x in TRAITS])
    order = [F.col("kind"), F.desc("score"), F.col("candidate_mpn"), F.col("candidate_id")]  # DROP_IN sorts first
    of_class = W.partitionBy(*[f"t_{x}" for x in TRAITS]).orderBy(*order)
    # A class needs its best `kept` candidates, so its pairs with other classes end where those hold as many.
    short = scored.join(one.hint("merge"), [f"c_{x}" for x in TRAITS]).withColumn("r", F.row_number().over(of_class)).where(F.col("r") <= kept)
    got = keyed.select("part_id", "mpn", *[F.col(x).alias(f"t_{x}") for x in TRAITS]).join(short.drop("r"), [f"t_{x}" for x in TRAITS])
    placed = got.where("mpn <> candidate_mpn").withColumn("place", F.row_number().over(W.partitionBy("part_id").orderBy(*order)))
    return placed.where(F.col("place") <= limit).select("part_id", "place", "candidate_id", "kind", "score")
