"""Monitoring queries: hours of the event table as ticks, its event types as metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrace.operators import monitoring
from kinetrace.plans.queries import _t, query

#: What each event type stands for, with its labels: metric name, and a label from the event's key k.
_RECORDS = """r AS (SELECT event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS tick, ts, value, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events),
n AS (SELECT tick, (max(tick) OVER () - tick) AS back FROM (SELECT DISTINCT tick FROM r)),
a AS (SELECT tick, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'view' AND k % 2 = 0) AS succeeded, count(*) FILTER (event_type = 'purchase') AS ingested, max(ts) FILTER (event_type = 'signup') AS beat,
 quantile_disc(value, 0.95) FILTER (event_type = 'click') AS api_p95, count(*) FILTER (event_type = 'view') AS views, max(ts) AS newest, avg(value) AS mean, count(*) AS events, count(DISTINCT user_id) AS users FROM r GROUP BY tick)"""
#: The features that detectors read, with the catalog snapshot and host sample that the hour's counts stand for.
_FEATURES = _RECORDS + """, f AS (SELECT tick, tick % 37 <> 5 AS reachable, (failures % 4)::DOUBLE AS queued, (users % 3)::DOUBLE AS running, ingested::DOUBLE AS ingested, ingested / 3600.0::DOUBLE AS per_second,
 CASE WHEN failures + succeeded > 0 THEN failures / (failures + succeeded) ELSE 0.0 END AS failure_rate, CASE WHEN beat IS NULL THEN NULL ELSE greatest(0.0, (tick + 1) * 3600.0 - epoch_us(beat) / 1e6) END AS beat_age, api_p95,
 CASE WHEN tick % 37 <> 5 THEN failures / events END AS quarantine, mean / 1000 AS jerk, CASE WHEN tick % 37 <> 5 THEN events * 10.0::DOUBLE END AS frames, 100.0 * users / 30 AS cpu, (1 + users % 5) * 1073741824.0 AS disk, (failures * 1.5)::DOUBLE AS gap,
 greatest(0.0, (tick + 1) * 3600.0 - epoch_us(newest) / 1e6) AS lag FROM a)"""
_LIMIT_ROWS = {"quarantine_rate": (0.1, 0.02, 0.1, 30), "jerk_mean": (0.04, 0.005, 0.04, 30), "frame_count_median": (140.0, 10.0, 290.0, 30), "queue_depth_queued": (0.5, 0.4, 0.5, 30), "episodes_per_second": (0.001, 0.0001, 0.001, 30), "api_request_p95_seconds": (300.0, 20.0, 300.0, 30), "stall_mean": (0.1, 0.1, 0.1, 5)}


def features(spark, sf_dir):
    """The feature windows of the hours of the event table."""
    e = _t(spark, sf_dir, "events").withColumn("tick", F.floor(F.unix_seconds("ts") / 3600)).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind, k = F.col("event_type"), F.col("k")
    name = F.when(kind == "error", "jobs_failures_total").when(kind == "view", "jobs_run_time_seconds").when(kind == "purchase", "episodes_ingested_total").when(kind == "signup", "workers_heartbeat_age_seconds").otherwise("api_request_duration_seconds")
    labels = F.when(kind == "error", F.create_map(F.lit("reason_code"), F.concat(F.lit("R"), (k % 5).cast("string")))).when(kind == "view", F.create_map(F.lit("state"), F.when(k % 2 == 0, "succeeded").otherwise("failed"), F.lit("job_type"), F.concat(F.lit("t"), (k % 3).cast("string")))).otherwise(F.expr("cast(map() as map<string,string>)"))
    records = e.select("tick", name.alias("name"), "value", labels.alias("labels"), "ts")
    a = e.groupBy("tick").agg(F.count_if(kind == "error").alias("failures"), F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.avg("value").alias("mean"))
    null = F.lit(None).cast("double")
    running = F.transform(F.sequence(F.lit(1), F.lit(1)), lambda i: F.struct(F.concat(F.lit("j"), F.col("tick").cast("string")).alias("id"), F.lit("ingest").alias("job_type"), (F.col("users") * 60.0).alias("age_seconds"), (F.col("users") % 2 == 0).alias("deadline_passed")))
    snapshots = a.select(
        "tick", F.timestamp_seconds((F.col("tick") + 1) * 3600).alias("now"), (F.col("tick") % 37 != 5).alias("catalog_reachable"),
        F.create_map(F.lit("queued"), F.col("failures") % 4, F.lit("running"), F.col("users") % 3).alias("queue_depth"), F.expr("cast(map() as map<string,bigint>)").alias("verdict_rates"), null.alias("queue_oldest_age_seconds"),
        (F.col("failures") / F.col("events")).alias("quarantine_rate"), null.alias("movement_mean"), (F.col("mean") / 1000).alias("jerk_mean"), null.alias("stall_mean"), (F.col("events") * 10.0).alias("frame_count_median"),
        (100.0 * F.col("users") / 30).alias("cpu_percent"), null.alias("memory_used_bytes"), null.alias("memory_available_bytes"), ((1 + F.col("users") % 5) * 1073741824.0).alias("disk_free_bytes"),
        (F.col("failures") * 1.5).alias("max_episode_timestamp_gap_seconds"), F.concat(F.lit("e"), F.col("tick").cast("string")).alias("timestamp_gap_scope"), F.lit("s").alias("timestamp_gap_source"), F.lit(None).cast("timestamp").alias("metrics_mtime"), running.alias("running"),
    )
    return monitoring.feature_windows(records, snapshots, 3600.0)


def baselines(spark, sf_dir):
    """The same limits for each tick."""
    ticks = _t(spark, sf_dir, "events").select(F.floor(F.unix_seconds("ts") / 3600).alias("tick")).distinct()
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit("").alias("scope"), F.lit(m).alias("median"), F.lit(s).alias("sigma"), F.lit(c).alias("center"), F.lit(n).alias("observations")) for f, (m, s, c, n) in _LIMIT_ROWS.items()])
    return ticks.select("tick", F.inline(rows))


@query(
    f"""WITH {_FEATURES} SELECT tick, queued AS queue_depth_queued, running AS queue_depth_running, round(failure_rate, 9) AS job_failure_rate, ingested AS episodes_ingested, round(per_second, 9) AS episodes_per_second, round(beat_age, 3) AS heartbeat_age_seconds,
    api_p95 AS api_request_p95_seconds, round(quarantine, 9) AS quarantine_rate, frames AS frame_count_median, round(lag, 3) AS sink_lag_seconds,
    round((CASE WHEN quarantine IS NULL THEN 0 ELSE 1 END + 1 + CASE WHEN frames IS NULL THEN 0 ELSE 1 END + CASE WHEN beat_age IS NULL THEN 0 ELSE 1 END + CASE WHEN api_p95 IS NULL THEN 0 ELSE 1 END + 2) / 13.0::DOUBLE, 9) AS sensor_availability FROM f"""
)
def feature_windows(spark, sf_dir):
    f = features(spark, sf_dir)
    whole = ("queue_depth_queued", "queue_depth_running", "episodes_ingested", "api_request_p95_seconds", "frame_count_median")
    return f.select("tick", *whole, *[F.round(c, 9).alias(c) for c in ("job_failure_rate", "episodes_per_second", "quarantine_rate", "sensor_availability")], *[F.round(c, 3).alias(c) for c in ("heartbeat_age_seconds", "sink_lag_seconds")])


def _z(feature: str, column: str) -> str:
    m, s, _, _ = _LIMIT_ROWS[feature]
    return f"({column} - {m}) / {s}"


_SHIFTS = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in (f"{_z('queue_depth_queued', 'queued')} > 4", f"{_z('episodes_per_second', 'per_second')} < -4", f"coalesce({_z('api_request_p95_seconds', 'api_p95')} > 4, false)"))
#: One oracle a detector: the hours, and scopes, in which it fires.
_RULES = {
    "database_unreachable": "SELECT tick, 'catalog' AS scope FROM f WHERE NOT reachable",
    "worker_lost": "SELECT tick, 'worker' AS scope FROM f WHERE reachable AND (beat_age IS NULL OR beat_age > 180)",
    "run_stalled": "SELECT a.tick, 'j' || a.tick AS scope FROM a JOIN f USING (tick) WHERE users * 60.0 >= 900 AND (users % 2 = 0 OR a.ingested = 0)",
    "disk_pressure": "SELECT tick, 'host' AS scope FROM f WHERE disk < 2147483648.0",
    "clock_drift": "SELECT tick, 'e' || tick AS scope FROM f WHERE gap >= 5",
    "quarantine_rate_high": f"SELECT tick, 'curation' AS scope FROM f WHERE quarantine > 0.35 OR {_z('quarantine_rate', 'quarantine')} > 4",
    "quality_shift": f"SELECT tick, 'jerk_mean' AS scope FROM f WHERE {_z('jerk_mean', 'jerk')} > 4",
    "frame_count_collapse": "SELECT tick, 'frame_count_median' AS scope FROM f WHERE frames / 290.0 < 0.5",
    "repeated_read_failure": "SELECT tick, 'R' || (k % 5) AS scope FROM r WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 3",
    "resource_degraded": "SELECT tick, 'host' AS scope FROM f WHERE cpu > 90",
    "metric_shift": f"SELECT tick, 'platform' AS scope FROM f WHERE {_SHIFTS} >= 2",
}


def _detector(rule: str):
    def run(spark, sf_dir):
        return monitoring.detect(features(spark, sf_dir), baselines(spark, sf_dir), only=rule).select("tick", "scope")

    run.__name__ = f"detector_{rule}"
    return run


for _rule, _sql in _RULES.items():
    query(f"WITH {_FEATURES} {_sql}")(_detector(_rule))


@query(f"WITH {_FEATURES}, s AS ({' UNION ALL '.join(f'SELECT tick, {label!r} AS label FROM ({sql})' for label, sql in zip([x.upper() for x in _RULES], _RULES.values(), strict=True))}) SELECT label, count(*) AS n FROM s GROUP BY label")
def signal_counts(spark, sf_dir):
    """All detectors in one pass."""
    return monitoring.detect(features(spark, sf_dir), baselines(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {_FEATURES} SELECT tick, NOT reachable OR lag > 600 AS blind FROM f")
def blindness(spark, sf_dir):
    return monitoring.blind(features(spark, sf_dir))


def _incidents(spark, sf_dir):
    s = monitoring.detect(features(spark, sf_dir), baselines(spark, sf_dir)).withColumn("fingerprint", F.concat_ws("|", "label", "scope"))
    before = spark.createDataFrame([], "fingerprint string, label string, severity string, notify_class string, scope string, summary string, status string, occurrence_count long, first_seen timestamp, last_seen timestamp")
    return monitoring.fold_incidents(before, s)


_FOLDED = " UNION ALL ".join(f"SELECT tick, {x.upper()!r} AS label, scope FROM ({sql})" for x, sql in _RULES.items())


@query(f"WITH {_FEATURES}, s AS ({_FOLDED}) SELECT label || '|' || scope AS fingerprint, count(*) AS occurrence_count, (min(tick) + 1) * 3600 AS first_seen, (max(tick) + 1) * 3600 AS last_seen FROM s GROUP BY label, scope")
def incident_fold(spark, sf_dir):
    return _incidents(spark, sf_dir).select("fingerprint", "occurrence_count", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"))


@query(
    f"""WITH {_FEATURES}, s AS (SELECT DISTINCT label, scope FROM ({_FOLDED})), i AS (SELECT label, label IN ('RUN_STALLED', 'WORKER_LOST', 'DISK_PRESSURE', 'DATABASE_UNREACHABLE', 'CLOCK_DRIFT') AS notify FROM s)
    SELECT 'label' AS facet, label AS key, count(*) AS n FROM i GROUP BY label UNION ALL SELECT 'status', 'open', count(*) FROM i UNION ALL SELECT 'notify_open', '', count(*) FROM i WHERE notify"""
)
def incident_summary(spark, sf_dir):
    return monitoring.incident_summary(_incidents(spark, sf_dir)).where("facet <> 'severity'")


@query()
def incident_digest(spark, sf_dir):
    return monitoring.digest(_incidents(spark, sf_dir))


@query(f"WITH {_FEATURES}, l AS ({_FOLDED}), x AS (SELECT tick, CASE WHEN disk < 2147483648.0 THEN 'DISK_PRESSURE' WHEN tick % 3 = 0 THEN 'METRIC_SHIFT' ELSE '' END AS expected FROM f) SELECT expected, count(*) AS windows, count(*) FILTER (expected <> '' AND EXISTS (SELECT 1 FROM l WHERE l.tick = x.tick AND l.label = x.expected)) AS detected FROM x GROUP BY expected")
def chaos_replay(spark, sf_dir):
    f = features(spark, sf_dir)
    windows = f.select("tick", F.when(F.col("disk_free_bytes") < 2147483648.0, "DISK_PRESSURE").when(F.col("tick") % 3 == 0, "METRIC_SHIFT").otherwise("").alias("expected"), F.col("now").alias("detectable_at"), F.col("now").alias("evaluated_at"))
    scored = monitoring.replay(windows, monitoring.detect(f, baselines(spark, sf_dir)))
    return scored.groupBy("expected").agg(F.count("*").alias("windows"), F.count_if("detected").alias("detected"))


@query(
    """WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_discount) AS d, max(l_tax) * 10 AS t, sum(l_quantity) AS m FROM lineitem GROUP BY 1), o AS (SELECT *, o_orderstatus AS state FROM orders)
    SELECT (SELECT count(*) FROM o WHERE o_orderkey % 4 = 0) AS queued, (SELECT epoch_us(TIMESTAMP '2000-01-01') - epoch_us(min(o_orderdate)) FROM o WHERE o_orderkey % 4 = 0) / 1000000.0::DOUBLE AS oldest_queued_age_seconds,
    round((SELECT count(*) FILTER (state = 'P') / count(*) FROM o), 9) AS quarantine_rate, round((SELECT avg(d) FROM l), 9) AS jerk_mean, (SELECT median(n) FROM l) AS frame_count_median, 50 AS running"""
)
def monitoring_snapshot(spark, sf_dir):
    from kinetrace.plans.catalog import _episode_tables, _jobs

    e, q = _episode_tables(spark, sf_dir)
    e = e.withColumns({"created_at": F.col("created_at").cast("timestamp"), "source_hash": F.lit("s"), "max_gap_seconds": F.lit(None).cast("double")})
    s = monitoring.snapshot(_jobs(spark, sf_dir), e, q, F.lit("2000-01-01").cast("timestamp"))
    return s.select(F.col("queue_depth")["queued"].alias("queued"), "oldest_queued_age_seconds", F.round("quarantine_rate", 9).alias("quarantine_rate"), F.round("jerk_mean", 9).alias("jerk_mean"), "frame_count_median", F.size("running").alias("running"))
