"""When what is known of a part goes stale: its facts, or its newest snapshot, without anything newer in time.

Observations are part_id, kind (fact or snapshot), ts. A kind goes stale at its last observation plus its time to live; what
was never seen never goes stale (a part without snapshots counts as fresh).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from partloom import constants as C

_MARKS = "part_id long, kind string, stale_at timestamp"
_MICRO = 1_000_000


def _lives(kinds: dict[str, int]) -> dict[str, int]:
    return {k: s * _MICRO for k, s in kinds.items()}


def stale_marks(observations: DataFrame, until: str, kinds: dict[str, int] = C.TIMES_TO_LIVE) -> DataFrame:
    """part_id, kind, stale_at: each time at which a kind went stale before `until`, by the next observation of its part and kind."""
    life = F.coalesce(*[F.when(F.col("kind") == k, F.lit(s).cast("long")) for k, s in kinds.items()])
    ts = F.col("ts").cast("timestamp")
    following = F.lead(ts).over(W.partitionBy("part_id", "kind").orderBy("ts"))
    each = observations.where(F.col("kind").isin(*kinds) & F.col("ts").isNotNull() & F.col("part_id").isNotNull()).select("part_id", "kind", F.timestamp_micros(F.unix_micros(ts) + life * _MICRO).alias("stale_at"), following.alias("following"))
    return each.where("(following is null or following > stale_at)").where(F.col("stale_at") < F.lit(until).cast("timestamp")).select("part_id", "kind", "stale_at")


def needs_fetch(parts: DataFrame, observations: DataFrame, now: str, kinds: dict[str, int] = C.TIMES_TO_LIVE) -> DataFrame:
    """part_id, reason (forced, never verified, facts, snapshot) of the parts to look up again at `now`. parts: part_id, forced."""
    age = lambda kind: F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max(F.when(F.col("kind") == kind, F.col("ts").cast("timestamp"))))
    seen = observations.groupBy("part_id").agg(age("fact").alias("fact_age"), age("snapshot").alias("snapshot_age"))
    old = lambda c, kind: F.col(c) > kinds[kind] * _MICRO
    reason = F.when(F.col("forced"), "forced").when(F.col("fact_age").isNull(), "never verified").when(old("fact_age", "fact"), "facts").when(old("snapshot_age", "snapshot"), "snapshot")
    return parts.join(seen, "part_id", "left").select("part_id", reason.alias("reason")).where("reason is not null")


def watch(observations: DataFrame, late: str = "10 minutes", kinds: dict[str, int] = C.TIMES_TO_LIVE) -> DataFrame:
    """The marks of `stale_marks` on a stream, each when the watermark passes it.

    A part's state is its newest observation of each kind; a timer on event time rings at the earliest of what they go stale
    at. Observations that arrive late, but within the watermark, count before marks are made, as marks wait for it.
    """
    lives = _lives(kinds)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {k: list(v) for k, v in zip(lives, state.get, strict=True)} if state.exists else {k: [] for k in lives}
        for batch in batches:
            for kind, ts in zip(batch["kind"], batch["ts"], strict=True):
                held[kind].append(pd.Timestamp(ts).value // 1000)
        seen = state.getCurrentWatermarkMs() * 1000
        found = []
        for kind, life in lives.items():
            times = sorted(held[kind])
            # Times whose end the watermark has passed are decided; one that nothing follows in time is a mark.
            for i, t in enumerate(times):
                if t + life < seen and (i + 1 == len(times) or times[i + 1] > t + life):
                    found.append((key[0], kind, pd.Timestamp((t + life) * 1000)))
            held[kind] = [t for t in times if t + life >= seen]
        open_ = [t + lives[k] for k, times in held.items() for t in times]
        if open_:
            state.update(tuple(held.values()))
            state.setTimeoutTimestamp(max(min(open_) // 1000 + 1, seen // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["part_id", "kind", "stale_at"])

    given = observations.where(F.col("kind").isin(*kinds) & F.col("part_id").isNotNull()).select("part_id", "kind", "ts").withWatermark("ts", late)
    held = ", ".join(f"{k} array<long>" for k in kinds)
    return given.groupBy("part_id").applyInPandasWithState(run, _MARKS, held, "append", GroupStateTimeout.EventTimeTimeout)
