import shutil

import pytest
from partloom.operators import history
from partloom.streaming import events as E
from partloom.streaming import merging, staleness
from pyspark.sql import functions as F


@pytest.fixture
def stream(spark, sf, tmp_path):
    shutil.copy(f"{sf}/events.parquet", tmp_path / "events.parquet")
    return E.read(spark, str(tmp_path))


def collected(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_minutes_equal_the_batch(spark, sf, stream):
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    got = collected(spark, E.per_minute(stream), "minutes", "complete").groupBy("event_type").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_lifecycle_equals_the_batch(spark, sf, stream):
    got = {r.user_id: history.STEPS[r.step] for r in collected(spark, E.lifecycle_states(stream), "states", "complete").collect()}
    assert got == {r.user_id: r.state for r in history.lifecycle_fold(spark.read.parquet(f"{sf}/events.parquet")).collect()}


def test_steps_equal_the_batch(spark, sf, stream):
    got = {r.user_id: (r.state, r.steps) for r in collected(spark, E.lifecycle_steps(stream), "steps", "complete").collect()}
    kinds = spark.read.parquet(f"{sf}/events.parquet").select("user_id", history.event_kind(F.col("event_type")).alias("kind"))
    assert got == {r.user_id: (r.state, r.steps) for r in history.advanced(kinds, ["user_id"]).collect()}


def test_steps_one_by_one(spark):
    kinds = ["SUCCESSOR", "PCN", "EOL_ANNOUNCED", "PDN", "X", "LAST_TIME_BUY", "SUCCESSOR"]
    state, seen = "ACTIVE", []
    for k in kinds:
        state = spark.range(1).select(history.advance(F.lit(state), F.lit(k)).alias("s")).first().s
        seen.append(state)
    assert seen == ["NRND", "NRND", "EOL_ANNOUNCED", "EOL_ANNOUNCED", "LAST_TIME_BUY", "OBSOLETE", "OBSOLETE"]
    assert spark.range(1).select(history.may_follow(F.lit("NRND")).alias("a"), F.size(history.may_follow(F.lit("?"))).alias("n")).first()[:] == (["EOL_ANNOUNCED", "ACTIVE", "UNKNOWN"], 6)


def test_latest_values_by_folder(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log, latest = str(tmp_path / "log"), str(tmp_path / "latest")
    E.append_snapshots(E.read(spark, str(tmp_path / "in")), log, latest, str(tmp_path / "state"), parts=5).awaitTermination(120)
    want = {r.user_id: r.ts for r in events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).collect()}
    assert {r.user_id: r.ts for r in E.latest_of(spark, latest).collect()} == want
    assert spark.read.parquet(log).count() == events.count()


def test_learned_headers_over_restarts(spark, tmp_path):
    """Three runs over files that arrive in between give what one batch gives; a folder keeps two versions at most."""
    given = [(f"h{i % 7}", ("mpn", "value", "notes")[(i * i + i // 5) % 3]) for i in range(120)] + [("", "mpn"), ("h1", "")]
    table, state, arrived = (str(tmp_path / n) for n in ("table", "state", "in"))
    for run in range(3):
        for part in range(2):
            spark.createDataFrame(given[run * 2 + part :: 6], "key string, field string").coalesce(1).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema("key string, field string").option("maxFilesPerTrigger", 1).parquet(arrived)
        assert merging.learn_headers(stream, table, state, parts=3).awaitTermination(120)
    counts = {}
    for k, f in given:
        if k and f:
            counts.setdefault(k, {}).setdefault(f, 0)
            counts[k][f] += 1
    assert {(r.key, r.field): r.hits for r in merging.newest(spark, table).collect()} == {(k, f): n for k, fs in counts.items() for f, n in fs.items()}
    best = {k: min(fs, key=lambda f: (-fs[f], f)) for k, fs in counts.items()}
    assert {r.key: (r.field, r.hits) for r in merging.learned(spark, table).collect()} == {k: (f, counts[k][f]) for k, f in best.items()}
    versions = [len([v for v in p.iterdir() if v.name.startswith("v=")]) for p in (tmp_path / "table").iterdir() if p.name.startswith("part=")]
    assert versions and max(versions) <= 2
    assert merging.learned(spark, str(tmp_path / "none")).count() == 0


def test_stale_marks_equal_the_batch(spark, sf, tmp_path):
    """Marks come when the watermark passes them; a last event moves it past all that the batch is asked for."""
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 25").orderBy("ts")
    kind = F.when(F.col("event_type").isin("view", "click"), "snapshot").otherwise("fact").alias("kind")
    seen = events.select(F.col("user_id").alias("part_id"), kind, F.col("ts").cast("timestamp").alias("ts"))
    arrived, state = str(tmp_path / "in"), str(tmp_path / "state")
    days = [("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2024-03-01")]
    for lo, hi in days:
        seen.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
        q = staleness.watch(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(200)
    until = seen.agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("stale_at") < F.lit(until)).collect())
    want = sorted(tuple(r) for r in staleness.stale_marks(seen, str(until)).collect())
    assert got == want and len(got) > 100
