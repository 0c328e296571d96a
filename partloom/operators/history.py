"""Prices and stock over time, and the state of parts along their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions.values import lookup


def trends(snapshots: DataFrame) -> DataFrame:
    """First and last price of each part and distributor, with the change in tenths of a percent and its direction."""
    at = F.struct("checked_at", "min_price_micro", "available_qty")
    got = snapshots.groupBy("part_id", "supp_id").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count(F.lit(1)).alias("points"))
    got = got.select("part_id", "supp_id", "points", F.col("a.min_price_micro").alias("first_micro"), F.col("z.min_price_micro").alias("last_micro"), F.col("z.available_qty").alias("last_qty"))
    change = F.floor(((F.col("last_micro") - F.col("first_micro")) * 2000 + F.col("first_micro")) / (F.col("first_micro") * 2)).cast("long")
    got = got.withColumn("change_permille", change)
    return got.withColumn("direction", F.when(F.col("change_permille") > 50, "up").when(F.col("change_permille") < -50, "down").otherwise("flat"))


def series(snapshots: DataFrame) -> DataFrame:
    """Stock and lowest price of each part and minute."""
    return snapshots.groupBy("part_id", F.date_trunc("minute", "checked_at").cast("timestamp_ntz").alias("minute")).agg(F.sum("available_qty").alias("stock"), F.min("min_price_micro").alias("min_micro"))


def dossier(snapshots: DataFrame) -> DataFrame:
    """What a part's whole log says: ever available, all quantities, lowest price, distributors, latest look."""
    return snapshots.groupBy("part_id").agg(
        F.max("available").alias("available"), F.sum("available_qty").alias("available_qty"), F.min("min_price_micro").alias("min_micro"), F.count_distinct("supp_id").alias("distributors"), F.max("checked_at").alias("latest")
    )


def stale(snapshots: DataFrame, now: str, days: int) -> DataFrame:
    """Parts whose newest snapshot is older than so many days before now."""
    return snapshots.groupBy("part_id").agg(F.max("checked_at").alias("latest")).where(F.col("latest") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def recent(snapshots: DataFrame, n: int) -> DataFrame:
    """The n parts looked at last."""
    return snapshots.groupBy("part_id").agg(F.max("checked_at").alias("latest")).orderBy(F.desc("latest"), "part_id").limit(n)


def arrivals_in_window(events: DataFrame, seconds: int = 60) -> DataFrame:
    """For each event how many of its user's fall in the seconds up to it."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy("t").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("t", t).select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("in_window"))


# The forward steps of a lifecycle and what events say.
STEPS = ("ACTIVE", "NRND", "EOL_ANNOUNCED", "LAST_TIME_BUY", "OBSOLETE")
EVENT_STATES = {"error": 2, "purchase": 3}


def lifecycle_fold(events: DataFrame) -> DataFrame:
    """The state of each user taken as a part: an event never takes a state back, so the fold is the furthest step."""
    step = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in EVENT_STATES.items() for v in kv]), F.col("event_type")), F.lit(0))
    got = events.groupBy("user_id").agg(F.max(step).alias("step"), F.count(F.lit(1)).alias("events"))
    return got.select("user_id", F.element_at(F.array(*[F.lit(s) for s in STEPS]), F.col("step") + 1).alias("state"), "events")


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Each user's events in sessions that a pause of gap_minutes ends."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    late = F.col("ts") >= F.lag("ts").over(w) + F.expr(f"interval {gap_minutes} minutes")
    got = events.withColumn("new", F.when(F.coalesce(late, F.lit(True)), 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return got.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"))


# What the given event types stand for.
EVENT_KINDS = {"click": "PCN", "view": "PDN", "signup": "SUCCESSOR", "error": "EOL_ANNOUNCED", "purchase": "LAST_TIME_BUY"}


def event_kind(event_type: Column) -> Column:
    return F.coalesce(lookup(EVENT_KINDS, event_type), event_type)


def may_follow(state: Column) -> Column:
    """The states that may come after one; any may after an unknown one."""
    known = F.create_map(*[x for s, after in C.LIFECYCLE_GRAPH.items() for x in (F.lit(s), F.array(*map(F.lit, after)))])
    return F.coalesce(F.try_element_at(known, state), F.try_element_at(known, F.lit("UNKNOWN")))


def advance(state: Column, kind: Column) -> Column:
    """The state after one event: a step forward, but for notices of changes, which leave it."""
    return F.when(kind.isin(*C.NOTICE_EVENTS), state).otherwise(F.coalesce(lookup(C.LIFECYCLE_NEXT, state), state))


def advanced(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, steps, notices: the state that all events (keys, kind) lead to from ACTIVE.

    Every event that isn't a notice goes one step forward whatever it says, so the fold is a count, without an order.
    """
    notice = F.col("kind").isin(*C.NOTICE_EVENTS)
    got = events.groupBy(*keys).agg(F.count_if(~notice).alias("steps"), F.count_if(notice).alias("notices"))
    state = F.element_at(F.array(*[F.lit(s) for s in STEPS]), F.least(F.col("steps"), F.lit(len(STEPS) - 1)).cast("int") + 1)
    return got.select(*keys, state.alias("state"), "steps", "notices")


def new_notices(known: DataFrame, told: DataFrame) -> DataFrame:
    """The distinct rows of told (part_id, event) that known doesn't have."""
    return told.distinct().join(known, ["part_id", "event"], "left_anti")
