"""Ticks, limits and incidents against a plain twin; the functions SQL text can use; planted recordings."""

import datetime as dt
import statistics

import pytest
from kinetrace.functions import registry
from kinetrace.operators import calibration, monitoring, redundancy
from kinetrace.streaming import monitor
from pyspark.sql import functions as F

START = 1_700_000_000 // 60


def snapshots(ticks):
    null = F.lit(None).cast("double")
    queued = F.when(F.col("tick") % 50 == 49, 60).otherwise(F.col("tick") % 3)
    return ticks.select(
        "tick", "now", F.lit(True).alias("catalog_reachable"), F.create_map(F.lit("queued"), queued.cast("long")).alias("queue_depth"), F.create_map(F.lit("jerky"), F.lit(1).cast("long"), F.lit("smooth"), F.lit(3).cast("long")).alias("verdict_rates"),
        *[null.alias(c) for c in ("queue_oldest_age_seconds", "movement_mean", "stall_mean", "memory_used_bytes", "memory_available_bytes", "max_episode_timestamp_gap_seconds")],
        (0.1 + 0.01 * (F.col("tick") % 4) + F.when(F.col("tick") % 50 == 49, 0.2).otherwise(0.0)).alias("quarantine_rate"), F.lit(0.1).alias("jerk_mean"), F.lit(300.0).alias("frame_count_median"), F.lit(10.0).alias("cpu_percent"), F.lit(1e12).alias("disk_free_bytes"),
        F.lit(None).cast("string").alias("timestamp_gap_scope"), F.lit(None).cast("string").alias("timestamp_gap_source"), F.lit(None).cast("timestamp").alias("metrics_mtime"),
        F.expr("cast(array() as array<struct<id:string,job_type:string,age_seconds:double,deadline_passed:boolean>>)").alias("running"),
    )


def test_a_stream_of_ticks(spark, tmp_path):
    first = START - START % 50 + 48  # a quiet tick, one with a feature off, two quiet ones; the second batch starts with the third
    before = [0.1 + 0.01 * (i % 4) for i in range(25)]
    known = [("quarantine_rate", "", before, 0.11, False, None), ("queue_depth_queued", "", [1.0], 1.0, False, None)]
    spark.createDataFrame(known, monitoring.STATE).write.parquet(str(tmp_path / "out/state/batch=-1"))
    rows = [("workers_heartbeat_age_seconds", 0.0, {}, dt.datetime.fromtimestamp((first + i) * 60 + 30, dt.UTC)) for i in range(4)]
    schema = "name string, value double, labels map<string,string>, ts timestamp"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    monitor.run_ticks(stream, snapshots, str(tmp_path / "out"))
    signals = spark.read.parquet(str(tmp_path / "out/signals")).orderBy("tick", "seq").collect()
    assert [(r.label, r.tick, r.action, r.severity) for r in signals] == [("QUARANTINE_RATE_HIGH", first + 1, "open", "high")]
    state = monitor._latest(spark, str(tmp_path / "out/state"), monitoring.STATE, 99)
    rate = before + [0.1 + 0.01 * ((first + i) % 4) for i in (0, 2, 3)]  # the tick that fired is not learned
    got = {r.feature: r for r in state.collect()}
    assert got["quarantine_rate"].samples == pytest.approx(rate) and not got["quarantine_rate"].breached
    center = 0.11
    for x in rate[25:]:
        center += 0.2 * (x - center)
    assert got["quarantine_rate"].center == pytest.approx(center) and len(got["queue_depth_queued"].samples) == 5
    limits = {r.feature: r for r in monitoring.limits_of(state).collect()}
    median = statistics.median(rate)
    assert limits["quarantine_rate"].median == pytest.approx(median)
    assert limits["quarantine_rate"].sigma == pytest.approx(max(1.4826 * statistics.median([abs(x - median) for x in rate]), 0.05 * median))
    incidents = monitor._latest(spark, str(tmp_path / "out/incidents"), monitor.INCIDENTS, 99).collect()
    assert [(r.label, r.occurrence_count, r.status) for r in incidents] == [("QUARANTINE_RATE_HIGH", 1, "open")]


def test_holds_and_expiry(spark):
    rows = [("a", "", [1.0] * 50, 1.0, False, None), ("b", "", [1.0], 1.0, True, 100.0)]
    state = spark.createDataFrame(rows, monitoring.STATE)
    seen = spark.createDataFrame([("a", "", 9.0), ("b", "", 9.0), ("c", "x", 5.0)], "feature string, scope string, value double")
    held = spark.createDataFrame([("b",), ("zz",)], "feature string")
    got = {r.feature: r for r in monitoring.observe(state, seen, held, 200.0).collect()}
    assert got["a"].samples == [1.0] * 49 + [9.0] and got["a"].center == pytest.approx(2.6)
    assert (got["b"].samples, got["b"].breached, got["b"].held_since) == ([1.0], True, 100.0)
    assert (got["c"].samples, got["c"].center, got["c"].breached) == ([5.0], 5.0, False) and "zz" not in got
    late = {r.feature: r.breached for r in monitoring.expire(state, 3700.0).collect()}
    assert late == {"a": False, "b": False} and monitoring.expire(state, 3699.0).where("breached").count() == 1


def test_incidents_fold(spark):
    t = [dt.datetime(2026, 1, 1, i, tzinfo=dt.UTC) for i in range(5)]
    old = spark.createDataFrame([("f", "L", "critical", "notify", "s", "was", "open", 3, t[0], t[1]), ("g", "L", "high", "queue", "s", "x", "resolved", 1, t[0], t[0])], monitor.INCIDENTS)
    new = spark.createDataFrame([("f", "L", "high", "notify", "s", "now", t[3], 0), ("g", "L", "high", "queue", "s", "again", t[3], 1), ("g", "L", "high", "queue", "s", "later", t[4], 1)], "fingerprint string, label string, severity string, notify_class string, scope string, detail string, now timestamp, seq int")
    got = sorted((r.fingerprint, r.severity, r.summary, r.status, r.occurrence_count) for r in monitoring.fold_incidents(old, new).collect())
    assert got == [("f", "critical", "now", "open", 4), ("g", "high", "later", "open", 2), ("g", "high", "x", "resolved", 1)]
    i = spark.createDataFrame([(1, "open"), (2, "open"), (3, "open")], "incident_id int, status string")
    events = spark.createDataFrame([(1, "acknowledged", t[1]), (1, "acknowledged", t[2]), (2, "resolved", t[1]), (2, "acknowledged", t[2])], "incident_id int, status string, at timestamp")
    got = {r.incident_id: (r.status, r.acknowledged_at is not None) for r in monitoring.incident_states(i, events).collect()}
    assert got == {1: ("acknowledged", True), 2: ("resolved", False), 3: ("open", False)}


def test_functions_by_name(spark):
    assert {"token_vector", "flat_numbers", "nearest_rank"} <= set(registry.register(spark))
    r = spark.sql("SELECT inner_product(token_vector('a b'), token_vector('b a')) AS same, nearest_rank(array(3D, 1D, 2D), 0.5D) AS p50, upper_median(array(4D, 1D, 2D, 3D)) AS m, blank_to('  ', 'x') AS b, blake2b64('q') AS h").first()
    assert (round(r.same, 9), r.p50, r.m, r.b, len(r.h)) == (1.0, 2.0, 3.0, "x", 16)
    rows = spark.sql("SELECT * FROM flat_numbers('{\"a\": [1, {\"b\": 2.5}], \"c\": \"x\"}')").collect()
    assert {(r.dimension, r.value) for r in rows} == {("a[0]", 1.0), ("a[1].b", 2.5)}


def test_planted_recordings(spark):
    frames = calibration.planted(spark, 4, 3, 2)
    assert frames.select("episode").distinct().count() == 20 and frames.count() == 20 * 90
    dims = [f"position_{j}" for j in range(4)]
    report = redundancy.redundancy(redundancy.fingerprints(frames, "episode", ["frame"], dims, "t"))
    s = calibration.report_scores(report, frames).first()
    assert s.recall > 0.2 and s.precision > 0.8
    perfect = frames.select("episode", F.col("truth").alias("representative")).distinct()
    assert tuple(calibration.report_scores(perfect, frames).first()) == (1.0, 1.0, 1.0)
    q = spark.createDataFrame([("a", "smooth", 2.0, 0.1, 0.0)], "episode_id string, verdict string, movement_score double, jerk_score double, stall_ratio double")
    e = spark.createDataFrame([("a", 10, 5.0)], "id string, frame_count int, fps double")
    assert calibration.motion_table(q, e).first().movement_per_second == 10.0
