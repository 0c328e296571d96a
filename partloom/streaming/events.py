"""Event streams: windows with watermarks and running states.

Every function takes a streaming or a batch DataFrame of events (event_id, ts, user_id, event_type, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partloom.streaming.merging import keep_merged
from partloom.streaming.merging import newest as merged

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from the parquet files that arrive in a folder, with a zoned time that watermarks accept."""
    got = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return got.withColumn("ts", F.col("ts").cast("timestamp"))


def per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tumbling minutes: events and value of each type. Later events than the watermark are dropped."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents"))
    return got.select(F.col("window.start").alias("minute"), "event_type", "n", "value_cents")


def sliding_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """How many events each user has in the 60 seconds that end every 10 seconds."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds", "10 seconds"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("window.end").alias("until"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    got = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("session_window.start").alias("started"), "user_id", "n")


def once_each(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without those whose id came before within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def lifecycle_steps(events: DataFrame) -> DataFrame:
    """user_id, state, steps, notices: the lifecycle state that all events so far lead to, updated with every batch."""
    from partloom.operators.history import advanced, event_kind

    return advanced(events.select("user_id", event_kind(F.col("event_type")).alias("kind")), ["user_id"])


def lifecycle_states(events: DataFrame) -> DataFrame:
    """user_id, step: the furthest lifecycle step so far, updated with every batch."""
    from partloom.operators.history import EVENT_STATES

    step = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in EVENT_STATES.items() for v in kv]), F.col("event_type")), F.lit(0))
    return events.groupBy("user_id").agg(F.max(step).alias("step"), F.count(F.lit(1)).alias("events"))


def append_snapshots(events: DataFrame, log: str, latest: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Append every batch to a log, and keep the latest value of each user in a table of `parts` folders: see `merging.keep_merged`."""
    newest = lambda df: df.groupBy("user_id").agg(F.max_by(F.struct("value", "ts", "event_id"), F.struct("ts", "event_id")).alias("l")).select("user_id", "l.*")
    append = lambda batch, number: batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
    return keep_merged(events, latest, checkpoint, ("user_id",), newest, parts, append)


def latest_of(spark: SparkSession, latest: str) -> DataFrame:
    """The table that `append_snapshots` keeps."""
    return merged(spark, latest).select("user_id", "value", "ts", "part")
