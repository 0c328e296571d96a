"""Which part of the catalogue a line means, and how surely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions import similar
from partloom.functions import text as T
from partloom.functions import units as U
from partloom.functions.names import with_maker_key


def keyed_parts(parts: DataFrame, offers: DataFrame | None = None) -> DataFrame:
    """Parts as lines meet them: keys, maker, footprint, and whether anyone offers them (taken for granted without offers)."""
    offered = parts.withColumn("offered", F.lit(True)) if offers is None else parts.join(offers.select("part_id").distinct().withColumn("offered", F.lit(True)), "part_id", "left")
    return with_maker_key(offered, "p_maker").select(
        "part_id", F.col("mpn_key").alias("p_key"), F.col("root_key").alias("p_root"), "p_maker", U.normalize_package(F.col("package")).alias("p_package"), F.coalesce("offered", F.lit(False)).alias("offered")
    )


def settled(sure: Column, offered: Column) -> Column:
    """The confidence, 0 to 100, in a part that agrees so far: one that nobody offers loses 4."""
    return F.least(F.greatest(sure + F.when(offered, 0).otherwise(-4), F.lit(0)), F.lit(100))


ASK = ["mpn", "manufacturer", "package"]


def classify(lines: DataFrame, parts: DataFrame, offers: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """bom_id, source_row, part_id, kind, confidence for every line; lines: with mpn, manufacturer and package, parts: with
    mpn_key and root_key. carry: columns of the lines that come along.

    Lines that ask the same get keys and are matched once, and meet the outcome in one join.
    """
    given = lines.select("bom_id", "source_row", *[F.col(c).alias(f"ask_{i}") for i, c in enumerate(ASK)], *[F.col(c).alias(f"own_{c}") for c in carry])
    asks = lines.select(*ASK).distinct().withColumns({"mpn_key": T.normalize_mpn(F.col("mpn")), "root_key": T.normalize_mpn(T.mpn_root(F.col("mpn")))})
    told = classify_each(asks, ASK, parts, offers)
    got = given.join(told, F.expr(" and ".join(f"ask_{i} <=> {c}" for i, c in enumerate(ASK))), "left")
    return got.select("bom_id", "source_row", "part_id", "kind", "confidence", *[F.col(f"own_{c}").alias(c) for c in carry])


def classify_each(lines: DataFrame, keys: list[str], parts: DataFrame, offers: DataFrame | None = None, carry: tuple[str, ...] = (), settle: bool = True) -> DataFrame:
    """keys, part_id, kind, confidence for every row of lines (mpn_key, root_key, manufacturer, package), which has keys of its own.

    Each line asks for its key and for its root in one join, and of the parts that it meets the one of the better tier,
    then of the smaller id counts. Makers that agree add 4 where they weren't asked for, a conflict takes 28, a missing one
    2; footprints that agree add 6 and take 13 if they differ; a part that nobody offers loses 4. With settle=False that is
    left to `settled`, for those who get to know the offers later.
    """
    own = [f"key_{i}" for i in range(len(keys))]
    line = with_maker_key(lines, "maker").select(*keys, "maker", U.normalize_package(F.col("package")).alias("package_key"), F.struct(*carry) if carry else F.lit(0), "mpn_key", "root_key")
    line = line.toDF(*own, "maker", "package_key", "carried", "mpn_key", "root_key")
    asks = F.array(F.struct(F.lit(0).alias("by"), F.nullif("mpn_key", F.lit("")).alias("key")), F.struct(F.lit(2).alias("by"), F.when(F.length("root_key") >= 5, F.col("root_key")).alias("key")))
    line = line.select(*own, "maker", "package_key", "carried", F.inline(asks))
    has = F.array(F.struct(F.lit(0).alias("by"), F.col("p_key").alias("key")), F.struct(F.lit(2).alias("by"), F.col("p_root").alias("key")))
    part = keyed_parts(parts, offers).select("part_id", "p_maker", "p_package", "offered", F.inline(has))
    met = line.join(part, ["by", "key"], "left")
    agree = (F.col("maker") == F.col("p_maker")) & (F.col("maker") != "")
    tier = F.when((F.col("by") == 0) & ~agree, 1).otherwise(F.col("by"))
    base = F.when(F.col("tier") == 0, 100).when(F.col("tier") == 1, 92).otherwise(82)
    maker = F.when(agree, F.when(F.col("tier") == 0, 0).otherwise(4)).when((F.col("maker") != "") & (F.col("p_maker") != ""), -28).when(F.col("maker") != "", -2).when(F.col("p_maker") != "", 1).otherwise(0)
    same = U.same_package(F.col("package_key"), F.col("p_package"))
    package = F.when(same, 6).when(~same, -13).otherwise(0)
    sure = base + maker + package
    scored = met.withColumn("tier", tier).withColumn("confidence", settled(sure, F.col("offered")) if settle else sure)
    known = F.col("part_id").isNotNull()
    best = scored.groupBy(*own).agg(F.min_by(F.when(known, F.struct("part_id", "tier", "confidence")), F.when(known, F.struct("tier", "part_id"))).alias("b"), F.first("carried").alias("carried"))
    kind = F.when(F.col("b.tier") == 0, "exact_with_maker").when(F.col("b.tier") == 1, "exact").when(F.col("b.tier") == 2, "root").otherwise("none")
    return best.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], F.col("b.part_id").alias("part_id"), kind.alias("kind"), F.coalesce("b.confidence", F.lit(0)).alias("confidence"), *[F.col(f"carried.{c}").alias(c) for c in carry])


def summary(matches: DataFrame, review: int = C.REVIEW_CONFIDENCE) -> DataFrame:
    hit = F.col("kind") != "none"
    return matches.groupBy("bom_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"), F.count_if(hit & (F.col("confidence") < review)).alias("needs_review"),
        F.sum(F.when(hit, F.col("confidence"))).cast("long").alias("confidence_sum"),
    )


def _without_one(key: str) -> Column:
    """The text itself and every text that lacks one of its characters."""
    k = F.col(key)
    cuts = F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))
    return F.array_distinct(F.concat(F.array(k), cuts))


def fuzzy(lines: DataFrame, parts: DataFrame, least: float = C.FUZZY_SIMILARITY) -> DataFrame:
    """bom_id, source_row, part_id, similarity (hundredths): for lines (bom_id, source_row, mpn_key) the part with the most
    similar number, of those that share all but one character on each side; equal ones go to the smaller id.

    Distinct keys are compared, and only those that meet in a shortened form, so neither lines nor parts are paired up.
    Keys below four characters tell too little and are left out.
    """
    short = lambda df, key: df.select(key).distinct().where(F.length(key) >= 4).select(key, F.explode(_without_one(key)).alias("form"))
    given = lines.where("mpn_key <> ''")
    first = parts.where("mpn_key <> ''").groupBy(F.col("mpn_key").alias("p_key")).agg(F.min("part_id").alias("part_id"))
    pairs = short(given, "mpn_key").join(short(first, "p_key"), "form").select("mpn_key", "p_key").distinct()
    scored = pairs.withColumn("similarity", F.round(similar.ratio("mpn_key", "p_key") * 100).cast("int")).where(F.col("similarity") >= least * 100)
    best = scored.join(first, "p_key").groupBy("mpn_key").agg(F.min_by(F.struct("part_id", "similarity"), F.struct(-F.col("similarity"), "part_id")).alias("b"))
    return given.join(best, "mpn_key").select("bom_id", "source_row", "b.part_id", "b.similarity")
