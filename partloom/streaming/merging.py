"""Tables that a stream keeps up to date by key: each batch rewrites only the folders that its keys fall in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def newest(spark: SparkSession, table: str, before: int | None = None, parts: Sequence[int] | None = None) -> DataFrame | None:
    """The table's rows: of each folder (of those named) its newest version, or the newest older than `before`. None if it has none yet."""
    at, fs = _folder(spark, table)
    if not fs.exists(at):
        return None
    found = spark.read.option("basePath", table).parquet(table)
    found = found.where(F.col("part").isin(list(parts))) if parts is not None else found
    found = found.where(F.col("v") < before) if before is not None else found
    last = found.select("part", "v").distinct().groupBy("part").agg(F.max("v").alias("v"))  # two versions a folder at most
    return found.join(last, ["part", "v"]).drop("v")


def _expire(spark: SparkSession, table: str, parts: Sequence[int], number: int) -> None:
    """Delete the versions that neither readers nor a repeated batch need: all but this batch's and the one before."""
    for part in parts:
        at, fs = _folder(spark, f"{table}/part={part}")
        versions = sorted((int(s.getPath().getName().removeprefix("v=")) for s in fs.listStatus(at) if s.getPath().getName().startswith("v=")), reverse=True)
        for v in [v for v in versions if v < number][1:]:
            old, _ = _folder(spark, f"{table}/part={part}/v={v}")
            fs.delete(old, True)


def keep_merged(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame], parts: int = 64, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Merge what arrives into a table of `parts` folders by the keys' hash.

    merge gives one row a key, of new rows as well as of rows it has made before and new ones together. A batch reads and
    rewrites only the folders that its keys fall in; a repeated batch starts from the version before its own and so writes
    the same again; older versions go. also: what else to do with each batch, with its number.
    """
    placed = lambda df: df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        if also:
            also(batch, number)
        new = placed(merge(batch))
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most `parts`
        if touched:
            old = newest(spark, table, before=number, parts=touched)
            if old is not None:
                new = placed(merge(old.drop("part").unionByName(new.drop("part"))))
            new.withColumn("v", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "v").parquet(table)
            _expire(spark, table, touched, number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learn_headers(confirmed: DataFrame, table: str, checkpoint: str, parts: int = 16) -> StreamingQuery:
    """Count how often each header key (key, field of a stream of confirmed columns) was confirmed for each field."""
    counted = lambda df: df.groupBy("key", "field").agg(F.sum("hits").cast("int").alias("hits"))
    return keep_merged(confirmed.where("key <> '' and field <> ''").select("key", "field", F.lit(1).alias("hits")), table, checkpoint, ("key",), counted, parts)


def learned(spark: SparkSession, table: str) -> DataFrame:
    """key, field, hits: the field confirmed most for each key, by name at a tie; what `mapping.header_scores` asks for."""
    counts = newest(spark, table)
    if counts is None:
        return spark.createDataFrame([], "key string, field string, hits int")
    best = F.row_number().over(W.partitionBy("key").orderBy(F.desc("hits"), "field"))  # a key has as many rows as there are fields
    return counts.withColumn("place", best).where("place = 1").select("key", "field", "hits")
