"""Monitoring ticks: feature windows, detectors, incidents and reports, one row a tick in and out.

A tick is one evaluation window. All features of a tick come from one aggregation of its records, joined with the
tick's catalog snapshot and host sample; all detectors are columns over that row. A null feature is an absent sensor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.operators.telemetry import ABSOLUTE_FLOOR, ALPHA, MAD_SCALE, RELATIVE_FLOOR, SEVERITIES, WARM, WINDOW, identity, triage
from kinetrace.session import cut

#: The features in order, and those whose presence counts as sensor availability.
FEATURES = (
    "queue_depth_queued",
    "queue_depth_running",
    "queue_depth_failed",
    "queue_oldest_age_seconds",
    "job_failure_rate",
    "job_retry_count",
    "job_cancel_count",
    "job_timeout_count",
    "episodes_ingested",
    "artifacts_bytes_written",
    "episodes_per_second",
    "quarantine_rate",
    "verdict_jerky_rate",
    "movement_mean",
    "jerk_mean",
    "stall_mean",
    "frame_count_median",
    "heartbeat_age_seconds",
    "catalog_query_p95_seconds",
    "api_request_p95_seconds",
    "api_error_rate",
    "cpu_percent",
    "memory_used_ratio",
    "disk_free_bytes",
    "sink_lag_seconds",
    "sensor_availability",
)
SENSORS = (
    "queue_oldest_age_seconds",
    "quarantine_rate",
    "verdict_jerky_rate",
    "movement_mean",
    "jerk_mean",
    "stall_mean",
    "frame_count_median",
    "heartbeat_age_seconds",
    "catalog_query_p95_seconds",
    "api_request_p95_seconds",
    "cpu_percent",
    "memory_used_ratio",
    "disk_free_bytes",
)
#: Thresholds of the detectors.
LIMITS = {
    "heartbeat_stale_seconds": 180.0,
    "stall_seconds": 900.0,
    "disk_free_floor_bytes": 2.0 * 1024**3,
    "clock_gap_seconds": 5.0,
    "quarantine_absolute_max": 0.35,
    "quarantine_z": 4.0,
    "quality_z": 4.0,
    "frame_collapse_ratio": 0.5,
    "repeated_failure_count": 3.0,
    "cpu_high_percent": 90.0,
    "memory_high_ratio": 0.92,
    "metric_shift_z": 4.0,
    "metric_shift_min_features": 2,
}
#: Features that may shift together, and the direction that counts.
WATCHED = {
    "queue_oldest_age_seconds": "high",
    "queue_depth_queued": "high",
    "episodes_per_second": "low",
    "catalog_query_p95_seconds": "high",
    "api_request_p95_seconds": "high",
    "api_error_rate": "high",
    "job_retry_count": "high",
    "job_timeout_count": "high",
}
#: Labels that notify whatever their severity, and the lag after which the monitor is blind.
NOTIFY = ("CONTRACT_BREACH", "RUN_STALLED", "WORKER_LOST", "DISK_PRESSURE", "DATABASE_UNREACHABLE", "CLOCK_DRIFT")
BLIND_SECONDS, HOLD_SECONDS = 600.0, 3600.0
SIGNAL = "struct<label:string,severity:string,scope:string,detail:string,evidence:map<string,double>,notify_class:string>"
BASELINE = "map<string,struct<median:double,sigma:double,center:double,observations:int>>"


def _count(name: str, *, label: tuple[str, str] | None = None) -> Column:
    here = F.col("name") == name
    return F.count_if(here if label is None else here & (F.col("labels")[label[0]] == label[1]))


def _p95(name: str) -> Column:
    return F.expr(f"percentile_disc(0.95) within group (order by if(name = '{name}', value, null))")


def feature_windows(records: DataFrame, snapshots: DataFrame, seconds: float = 60.0) -> DataFrame:
    """One row a tick: the features, failure_count and run_time_p95_seconds by scope, and the snapshot's references.

    records: tick, name, value, labels, ts. snapshots: tick, now, catalog_reachable, queue_depth and verdict_rates (maps of
    counts), the other values that FEATURES names, host values (cpu_percent, memory_used_bytes, memory_available_bytes,
    disk_free_bytes), max_episode_timestamp_gap_seconds with its scope and source, metrics_mtime and running.
    """
    seen = F.max(F.when(F.col("name") == "workers_heartbeat_age_seconds", F.col("ts"))).alias("heartbeat_ts")
    status = F.coalesce(F.col("labels")["status_class"], F.lit(""))
    window = records.groupBy("tick").agg(
        _count("jobs_failures_total").alias("failures"),
        _count("jobs_run_time_seconds", label=("state", "succeeded")).alias("succeeded"),
        _count("jobs_retries_total").cast("double").alias("job_retry_count"),
        _count("jobs_cancellations_total").cast("double").alias("job_cancel_count"),
        _count("jobs_timeouts_total").cast("double").alias("job_timeout_count"),
        _count("episodes_ingested_total").cast("double").alias("episodes_ingested"),
        F.sum(F.when(F.col("name") == "artifacts_written_bytes_total", F.col("value"))).alias("artifacts_bytes_written"),
        seen,
        _p95("catalog_query_duration_seconds").alias("catalog_query_p95_seconds"),
        _p95("api_request_duration_seconds").alias("api_request_p95_seconds"),
        _count("api_requests_total").alias("requests"),
        F.count_if((F.col("name") == "api_requests_total") & F.substring(status, 1, 1).isin("4", "5")).alias("errored"),
        F.max("ts").alias("newest"),
    )
    reason = records.where("name = 'jobs_failures_total'").groupBy("tick", F.coalesce(F.col("labels")["reason_code"], F.lit("unknown")).alias("k")).agg(F.count("*").cast("double").alias("v"))
    ran = records.where("name = 'jobs_run_time_seconds' and labels['state'] = 'succeeded'").groupBy("tick", F.coalesce(F.col("labels")["job_type"], F.lit("unknown")).alias("k"))
    ran = ran.agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("v"))
    by_scope = [x.groupBy("tick").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(n)) for x, n in ((reason, "failure_count"), (ran, "run_time_p95_seconds"))]
    t = snapshots.join(window, "tick", "left").join(by_scope[0], "tick", "left").join(by_scope[1], "tick", "left")
    zero = ["failures", "succeeded", "job_retry_count", "job_cancel_count", "job_timeout_count", "episodes_ingested", "artifacts_bytes_written", "requests", "errored"]
    t = t.fillna(0, zero).fillna(0.0, zero)

    def age(at: str) -> Column:
        return F.greatest(F.lit(0.0), (F.unix_micros("now") - F.unix_micros(at)) / 1e6)

    verdicts = F.aggregate(F.map_values("verdict_rates"), F.lit(0).cast("long"), lambda a, x: a + x)
    reachable = F.col("catalog_reachable")
    made = {
        **{f"queue_depth_{s}": F.coalesce(F.col("queue_depth")[s], F.lit(0)).cast("double") for s in ("queued", "running", "failed")},
        "job_failure_rate": F.coalesce(F.try_divide("failures", F.col("failures") + F.col("succeeded")), F.lit(0.0)),
        "episodes_per_second": F.col("episodes_ingested") / seconds if seconds > 0 else F.lit(0.0),
        "quarantine_rate": F.when(reachable, F.col("quarantine_rate")),
        "frame_count_median": F.when(reachable, F.col("frame_count_median")),
        "verdict_jerky_rate": F.when(reachable & (verdicts > 0), F.coalesce(F.col("verdict_rates")["jerky"], F.lit(0)) / verdicts),
        "heartbeat_age_seconds": age("heartbeat_ts"),
        "api_error_rate": F.try_divide("errored", "requests"),
        "memory_used_ratio": F.when(F.col("memory_used_bytes") + F.col("memory_available_bytes") > 0, F.col("memory_used_bytes") / (F.col("memory_used_bytes") + F.col("memory_available_bytes"))),
        "sink_lag_seconds": F.coalesce(F.when(F.col("newest").isNotNull(), age("newest")), F.when(F.col("metrics_mtime").isNotNull(), age("metrics_mtime"))),
    }
    made["heartbeat_age_seconds"] = F.when(F.col("heartbeat_ts").isNotNull(), made["heartbeat_age_seconds"])
    t = t.withColumns(made)
    present = [F.col(s).isNotNull().cast("int") for s in SENSORS]
    t = t.withColumn("sensor_availability", sum(present[1:], present[0]) / len(SENSORS))
    gap = ["max_episode_timestamp_gap_seconds", "timestamp_gap_scope", "timestamp_gap_source"]
    return t.select("tick", "now", "catalog_reachable", *[F.col(f).cast("double").alias(f) for f in FEATURES], *gap, "failure_count", "run_time_p95_seconds", "running")


def observations(features: DataFrame) -> DataFrame:
    """(tick, now, feature, scope, value): what a tick adds to the baselines; absent sensors add nothing."""
    single = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit("").alias("scope"), F.col(f).alias("value")) for f in FEATURES])
    scoped = F.transform(F.map_entries(F.coalesce("run_time_p95_seconds", F.expr("cast(map() as map<string,double>)"))), lambda e: F.struct(F.lit("run_time_p95_seconds").alias("feature"), e["key"].alias("scope"), e["value"].alias("value")))
    return features.select("tick", "now", F.inline(F.concat(single, scoped))).where("value is not null")


def _signal(when: Column, label: str, severity: str, scope: Column | str, detail: Column, **evidence: Column | float) -> Column:
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("double"))]
    notify = "notify" if label in NOTIFY else "queue"
    made = F.struct(
        F.lit(label).alias("label"), F.lit(severity).alias("severity"), (F.lit(scope) if isinstance(scope, str) else scope).alias("scope"),
        detail.alias("detail"), F.create_map(*pairs).alias("evidence"), F.lit(notify).alias("notify_class"),
    )
    return F.when(F.coalesce(when, F.lit(False)), made.cast(SIGNAL))


class _Baseline:
    """One feature's limits, from the map column `baselines`."""

    def __init__(self, feature: str):
        entry = F.col("baselines")[feature]
        self.value, self.median, self.sigma, self.center, self.n = F.col(feature), entry["median"], entry["sigma"], entry["center"], entry["observations"]
        self.warm = F.coalesce(self.n >= WARM, F.lit(False))
        self.z = F.when(self.warm, (self.value - self.median) / self.sigma).otherwise(0.0)
        self.ratio = F.when(self.center == 0, F.when(self.value > 0, float("inf")).otherwise(1.0)).otherwise(self.value / self.center)


def detectors(limits: dict | None = None) -> dict[str, Column]:
    """label rule -> array of signals, over feature_windows with `baselines` (see BASELINE); in the order of the registry."""
    c = {**LIMITS, **(limits or {})}
    col, fmt = F.col, F.format_string
    work = (col("queue_depth_queued") > 0) | (col("queue_depth_running") > 0) | (col("episodes_ingested") > 0) | (F.coalesce(F.size("running"), F.lit(0)) > 0)
    age, free, gap = col("heartbeat_age_seconds"), col("disk_free_bytes"), col("max_episode_timestamp_gap_seconds")
    lost = work & col("catalog_reachable") & (age.isNull() | (age > c["heartbeat_stale_seconds"]))
    lost_text = F.when(age.isNull(), "no worker heartbeat observed while work is outstanding").otherwise(fmt("no worker heartbeat for %.0fs while work is outstanding", age))
    rate, q = col("quarantine_rate"), _Baseline("quarantine_rate")
    absolute = rate > c["quarantine_absolute_max"]
    quality = [(f, _Baseline(f)) for f in ("verdict_jerky_rate", "jerk_mean", "stall_mean")]
    shift = [_signal(b.warm & (b.z > c["quality_z"]), "QUALITY_SHIFT", "high", f, fmt("%s at %.3f is %.1f robust sigmas above the usual %.3f", F.lit(f), b.value, b.z, b.median),
                     value=b.value, baseline_median=b.median, baseline_sigma=b.sigma, robust_z=b.z, threshold_sigma=c["quality_z"], observations=b.n) for f, b in quality]
    frames = _Baseline("frame_count_median")
    cpu, memory = col("cpu_percent"), col("memory_used_ratio")
    hot, full = F.coalesce(cpu > c["cpu_high_percent"], F.lit(False)), F.coalesce(memory > c["memory_high_ratio"], F.lit(False))
    pressed = F.concat_ws(", ", F.when(hot, fmt("cpu %.0f%%", cpu)), F.when(full, fmt("memory %.0f%%", memory * 100)))
    moved = []
    for f, way in WATCHED.items():
        b = _Baseline(f)
        beyond = b.z > c["metric_shift_z"] if way == "high" else b.z < -c["metric_shift_z"]
        moved.append(F.when(b.warm & b.value.isNotNull() & beyond, F.struct((-F.abs(b.z)).alias("o"), F.lit(f).alias("feature"), b.value.alias("value"), b.z.alias("z"))))
    shifted = F.array_sort(F.array_compact(F.array(*moved)))
    enough = F.size(shifted) >= c["metric_shift_min_features"]
    names = F.array_join(F.transform(shifted, lambda x: fmt("%s=%.4g (%+.1f sigmas)", x["feature"], x["value"], x["z"])), ", ")
    one = {
        "database_unreachable": _signal(~col("catalog_reachable"), "DATABASE_UNREACHABLE", "critical", "catalog", F.lit("the catalog probe failed; monitoring is running blind"), reachable=0.0),
        "worker_lost": _signal(lost, "WORKER_LOST", "critical", "worker", lost_text, heartbeat_age_seconds=age, threshold_seconds=c["heartbeat_stale_seconds"], queue_depth_queued=col("queue_depth_queued"), queue_depth_running=col("queue_depth_running")),
        "disk_pressure": _signal(free < c["disk_free_floor_bytes"], "DISK_PRESSURE", "critical", "host", fmt("%.1f GiB free, below the floor; artifact publishing will fail", free / 1024**3), disk_free_bytes=free, threshold_bytes=c["disk_free_floor_bytes"]),
        "clock_drift": _signal(gap >= c["clock_gap_seconds"], "CLOCK_DRIFT", "critical", F.coalesce("timestamp_gap_scope", F.lit("unknown")), fmt("largest gap inside an episode is %.1fs; its streams are not aligned", gap), max_gap_seconds=gap, threshold_seconds=c["clock_gap_seconds"]),
        "quarantine_rate_high": _signal(absolute | (q.warm & (q.z > c["quarantine_z"])), "QUARANTINE_RATE_HIGH", "high", "curation", fmt("%.0f%% of evaluated episodes are quarantined (%s bound)", rate * 100, F.when(absolute, "absolute").otherwise("baseline")),
                                        quarantine_rate=rate, absolute_max=c["quarantine_absolute_max"], warm=q.warm.cast("int"), baseline_median=F.when(~absolute, q.median), robust_z=F.when(~absolute, q.z)),
        "quality_shift": F.coalesce(*shift),
        "frame_count_collapse": _signal(frames.warm & (frames.ratio < c["frame_collapse_ratio"]), "FRAME_COUNT_COLLAPSE", "high", "frame_count_median", fmt("median episode length is %.0f frames, %.0f%% of the usual %.0f", frames.value, frames.ratio * 100, frames.center),
                                        value=frames.value, baseline_center=frames.center, ratio_to_center=frames.ratio, threshold_ratio=c["frame_collapse_ratio"], observations=frames.n),
        "resource_degraded": _signal(hot | full, "RESOURCE_DEGRADED", "medium", "host", F.concat(F.lit("host under pressure: "), pressed), cpu_percent=cpu, memory_used_ratio=memory, cpu_threshold=c["cpu_high_percent"], memory_threshold=c["memory_high_ratio"]),
        "metric_shift": _signal(enough, "METRIC_SHIFT", "medium", "platform", F.concat(F.size(shifted).cast("string"), F.lit(" signals moved together: "), names), shifted=F.size(shifted), min_features=c["metric_shift_min_features"], threshold_sigma=c["metric_shift_z"]),
    }
    by_feature = F.map_from_entries(F.transform(shifted, lambda x: F.struct(F.concat(F.lit("z:"), x["feature"]), x["z"])))
    one["metric_shift"] = F.when(one["metric_shift"].isNotNull(), one["metric_shift"].withField("evidence", F.map_concat(one["metric_shift"]["evidence"], by_feature)))
    late = F.filter("running", lambda j: (j["age_seconds"] >= c["stall_seconds"]) & (F.coalesce(j["deadline_passed"], F.lit(False)) | (F.col("episodes_ingested") <= 0)))
    many = {
        "run_stalled": F.transform(late, lambda j: _signal(F.lit(True), "RUN_STALLED", "critical", F.coalesce(j["id"], F.lit("unknown")), fmt("run has been going %.0fs", j["age_seconds"]), age_seconds=j["age_seconds"], stall_threshold_seconds=c["stall_seconds"], deadline_passed=j["deadline_passed"].cast("int"), episodes_in_window=col("episodes_ingested"))),
        "repeated_read_failure": F.transform(F.filter(F.array_sort(F.map_entries("failure_count")), lambda e: e["value"] >= c["repeated_failure_count"]),
                                             lambda e: _signal(F.lit(True), "REPEATED_READ_FAILURE", "high", e["key"], fmt("%.0f failures with reason %s in one window", e["value"], e["key"]), failure_count=e["value"], threshold=c["repeated_failure_count"])),
    }
    order = ("database_unreachable", "worker_lost", "run_stalled", "disk_pressure", "clock_drift", "quarantine_rate_high", "quality_shift", "frame_count_collapse", "repeated_read_failure", "resource_degraded", "metric_shift")
    empty = F.expr(f"cast(array() as array<{SIGNAL}>)")
    return {n: F.coalesce(many[n], empty) if n in many else F.array_compact(F.array(one[n])) for n in order}


def detect(features: DataFrame, baselines: DataFrame, only: str | None = None, limits: dict | None = None) -> DataFrame:
    """(tick, now, seq, label, severity, scope, detail, evidence, notify_class): the signals of each tick, in registry order.

    baselines: tick, feature, scope, median, sigma, center, observations; rows with a scope serve no detector.
    """
    entry = F.struct("feature", F.struct("median", "sigma", "center", "observations"))
    known = baselines.where("scope = ''").groupBy("tick").agg(F.map_from_entries(F.collect_list(entry)).cast(BASELINE).alias("baselines"))
    rules = detectors(limits)
    found = F.concat(*(rules.values() if only is None else [rules[only]]))
    t = features.join(known, "tick", "left").withColumn("baselines", F.coalesce("baselines", F.expr(f"cast(map() as {BASELINE})")))
    return t.select("tick", "now", F.posexplode(found).alias("seq", "s")).select("tick", "now", "seq", "s.*")


def blind(features: DataFrame) -> DataFrame:
    """(tick, blind): the catalog is down, the metric log has no age, or it lags too far."""
    return features.select("tick", (~F.col("catalog_reachable") | F.col("sink_lag_seconds").isNull() | (F.col("sink_lag_seconds") > BLIND_SECONDS)).alias("blind"))


def held_features(signals: DataFrame) -> DataFrame:
    """(feature): the limits that a tick's opened or bumped signals (label, scope, evidence, action) freeze."""
    shifted = F.transform(F.filter(F.map_keys("evidence"), lambda k: k.startswith("z:")), lambda k: F.substring_index(k, ":", -1))
    named = (
        F.when(F.col("label") == "QUALITY_SHIFT", F.array("scope"))
        .when(F.col("label") == "FRAME_COUNT_COLLAPSE", F.array(F.lit("frame_count_median")))
        .when(F.col("label") == "QUARANTINE_RATE_HIGH", F.array(F.lit("quarantine_rate")))
        .when(F.col("label") == "RESOURCE_DEGRADED", F.array(F.lit("cpu_percent"), F.lit("memory_used_ratio")))
        .when(F.col("label") == "METRIC_SHIFT", shifted)
    )
    return signals.where("action in ('open', 'bump')").select(F.explode(named).alias("feature")).distinct()


#: The state of the limits: one row a feature and scope, with its last values and the EWMA centre.
STATE = "feature string, scope string, samples array<double>, center double, breached boolean, held_since double"


def limits_of(state: DataFrame) -> DataFrame:
    """(feature, scope, median, sigma, center, observations) of the state's rows."""
    median = "if(size({0}) % 2 = 1, element_at({0}, cast(size({0}) div 2 + 1 as int)), (element_at({0}, cast(size({0}) div 2 as int)) + element_at({0}, cast(size({0}) div 2 + 1 as int))) / 2)"
    s = state.withColumn("_s", F.array_sort("samples")).withColumn("median", F.expr(f"if(size(_s) = 0, center, {median.format('_s')})"))
    s = s.withColumn("_d", F.expr("array_sort(transform(samples, x -> abs(x - median)))"))
    mad = F.expr(f"if(size(_d) < 2, 0D, {median.format('_d')})")
    sigma = F.greatest(MAD_SCALE * mad, RELATIVE_FLOOR * F.abs("median"), F.lit(ABSOLUTE_FLOOR))
    return s.select("feature", "scope", "median", sigma.alias("sigma"), "center", F.size("samples").alias("observations"))


def observe(state: DataFrame, seen: DataFrame, held: DataFrame, now: float) -> DataFrame:
    """The state after a tick: held limits are frozen (since `now`, or before), all others released, and then each takes in its value.

    seen: feature, scope, value. held: feature. A limit that is not known is never held.
    """
    j = state.join(seen.select("feature", "scope", "value"), ["feature", "scope"], "full").join(held.select("feature", F.lit(True).alias("_held")), "feature", "left")
    freeze = F.col("samples").isNotNull() & F.coalesce("_held", F.lit(False)) & (F.col("scope") == "")
    takes = ~freeze & F.col("value").isNotNull()
    old = F.coalesce("samples", F.expr("cast(array() as array<double>)"))
    grown = F.concat(old, F.array("value"))
    samples = F.when(takes, F.slice(grown, F.greatest(F.lit(1), F.size(grown) - WINDOW + 1), F.lit(WINDOW))).otherwise(old)
    center = F.when(takes & (F.size(old) == 0), F.col("value")).when(takes, F.col("center") + ALPHA * (F.col("value") - F.col("center"))).otherwise(F.coalesce("center", F.lit(0.0)))
    since = F.when(freeze, F.coalesce("held_since", F.lit(now)))
    return j.select("feature", "scope", samples.alias("samples"), center.alias("center"), freeze.alias("breached"), since.alias("held_since"))


def expire(state: DataFrame, now: float, seconds: float = HOLD_SECONDS) -> DataFrame:
    """The state with the holds of an hour or more released."""
    over = F.col("breached") & F.coalesce(F.lit(now) - F.col("held_since") >= seconds, F.lit(False))
    return state.withColumns({"breached": F.col("breached") & ~over, "held_since": F.when(~over, F.col("held_since"))})


def tick(features: DataFrame, state: DataFrame, incidents: DataFrame, now: float, floor: str = "medium") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals with their actions, state, incidents) after one tick's feature row.

    All inputs are small (the limits are some dozens of rows); what a tick decides is cut, so that plans stay short.
    """
    state = cut(expire(state, now))
    tick_of = features.select("tick")
    known = limits_of(state).join(F.broadcast(tick_of.withColumn("_", F.lit(True))), F.col("_")).drop("_")
    found = detect(features, known).withColumns({"window": F.col("tick"), "ts": F.col("now"), "has_evidence": F.size("evidence") > 0, "fingerprint": identity("label", "scope", F.lit(""))})
    acted = cut(triage(found, incidents.select("fingerprint", "status", "last_seen"), floor))
    accepted = acted.where("action in ('open', 'bump')")
    after = cut(fold_incidents(incidents, accepted))
    return acted, cut(observe(state, observations(features), held_features(acted), now)), after


def fold_incidents(incidents: DataFrame, accepted: DataFrame) -> DataFrame:
    """Incidents after a tick's accepted signals: an unresolved one of the same fingerprint is bumped, others are opened.

    incidents and the result: fingerprint, label, severity, notify_class, scope, summary, status, occurrence_count, first_seen,
    last_seen. accepted: fingerprint, label, severity, notify_class, scope, detail, now, seq. A critical one stays critical.
    """
    new = accepted.groupBy("fingerprint").agg(
        *[F.max_by(c, F.struct("now", "seq")).alias(f"new_{c}") for c in ("label", "severity", "notify_class", "scope", "detail")],
        F.min("now").alias("new_first"), F.max("now").alias("new_last"), F.count("*").alias("new_n"), F.max(F.col("severity") == "critical").alias("new_critical"),
    )
    resolved, live = incidents.where("status = 'resolved'"), incidents.where("status <> 'resolved'")
    j = live.join(new, "fingerprint", "full")
    severity = F.when(F.coalesce(F.col("severity") == "critical", F.lit(False)) | F.coalesce("new_critical", F.lit(False)), "critical").otherwise(F.coalesce("new_severity", "severity"))
    merged = j.select(
        "fingerprint", F.coalesce("label", "new_label").alias("label"), severity.alias("severity"), F.coalesce("notify_class", "new_notify_class").alias("notify_class"), F.coalesce("scope", "new_scope").alias("scope"),
        F.coalesce("new_detail", "summary").alias("summary"), F.coalesce("status", F.lit("open")).alias("status"), (F.coalesce("occurrence_count", F.lit(0)) + F.coalesce("new_n", F.lit(0))).cast("long").alias("occurrence_count"),
        F.coalesce("first_seen", "new_first").alias("first_seen"), F.coalesce("new_last", "last_seen").alias("last_seen"),
    )
    return merged.unionByName(resolved.select(merged.columns))


def incident_states(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """incidents with acknowledged_at, resolved_at and status after events (incident_id, status, at); the first stamp of each kind holds.

    Nothing that follows a resolution counts.
    """
    ends = events.where("status = 'resolved'").groupBy("incident_id").agg(F.min("at").alias("resolved_at"))
    seen = events.join(ends, "incident_id", "left").where("status = 'acknowledged' and (resolved_at is null or at < resolved_at)").groupBy("incident_id").agg(F.min("at").alias("acknowledged_at"))
    out = incidents.join(seen, "incident_id", "left").join(ends, "incident_id", "left")
    return out.withColumn("status", F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise(F.col("status")))


def incident_summary(incidents: DataFrame) -> DataFrame:
    """(facet, key, n): incidents by status; unresolved ones by severity and label, and those that notify."""
    live = F.col("status") != "resolved"
    facets = F.array(
        F.struct(F.lit("status").alias("facet"), F.col("status").alias("key")),
        F.when(live, F.struct(F.lit("severity").alias("facet"), F.col("severity").alias("key"))),
        F.when(live, F.struct(F.lit("label").alias("facet"), F.col("label").alias("key"))),
        F.when(live & (F.col("notify_class") == "notify"), F.struct(F.lit("notify_open").alias("facet"), F.lit("").alias("key"))),
    )
    return incidents.select(F.inline(F.array_compact(facets))).groupBy("facet", "key").agg(F.count("*").alias("n"))


def digest(incidents: DataFrame, limit: int = 20) -> DataFrame:
    """The open incidents in the order of a report: those that notify, then by severity, then the oldest; with one line each."""
    rank = F.array_position(F.array(*map(F.lit, reversed(SEVERITIES))), F.col("severity"))
    line = F.format_string("[%s] %s %s: %s (x%d)", F.upper("severity"), F.col("label"), F.col("scope"), F.col("summary"), F.col("occurrence_count"))
    live = incidents.where("status <> 'resolved'").orderBy((F.col("notify_class") != "notify").cast("int"), rank, F.col("first_seen").asc_nulls_last(), "fingerprint").limit(limit)
    return live.select("fingerprint", "label", "severity", "notify_class", line.alias("line"))


def replay(windows: DataFrame, signals: DataFrame) -> DataFrame:
    """Scores labelled fault windows (tick, expected, detectable_at, evaluated_at): fired labels, detected, latency, out_of_order.

    An empty expectation is a clean window, in which any label is a false alarm.
    """
    fired = signals.groupBy("tick").agg(F.array_sort(F.collect_set("label")).alias("fired"))
    t = windows.join(fired, "tick", "left").withColumn("fired", F.coalesce("fired", F.expr("cast(array() as array<string>)")))
    hit = (F.col("expected") != "") & F.array_contains("fired", F.col("expected"))
    late = F.when(hit, (F.unix_micros("evaluated_at") - F.unix_micros("detectable_at")) / 1e6)
    before = F.lag("detectable_at").over(Window.orderBy("tick"))
    return t.select("tick", "expected", "fired", hit.alias("detected"), late.alias("latency_seconds"), ((F.col("expected") == "") & (F.size("fired") > 0)).alias("false_alarm"), F.coalesce(F.col("detectable_at") < before, F.lit(False)).alias("out_of_order"))


def snapshot(jobs: DataFrame, episodes: DataFrame, quality: DataFrame, now: Column, newest: int = 200) -> DataFrame:
    """One row: queue_depth, oldest_queued_age_seconds, running (50 oldest), quarantine_rate, verdict_rates, means, median frames, widest gap.

    jobs: id, type, state, created_at, started_at, deadline_at. episodes: id, state, frame_count, created_at, source_hash,
    max_gap_seconds. quality: episode_id, verdict, movement_score, jerk_score, stall_ratio. Each part is one small
    aggregate; the parts meet as rows of one key.
    """
    def counts(df: DataFrame, by: str, name: str) -> DataFrame:
        return df.groupBy(by).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(name))

    def since(c: Column) -> Column:
        return (F.unix_micros(now) - F.unix_micros(c)) / 1e6

    begun = F.coalesce("started_at", "created_at")
    live = jobs.where("state in ('running', 'cancel_requested', 'retrying')").orderBy(begun, "id").limit(50)
    job = F.struct(begun.alias("at"), F.col("id"), F.col("type").alias("job_type"), since(begun).alias("age_seconds"), F.coalesce(F.col("deadline_at") < now, F.lit(False)).alias("deadline_passed"))
    measures = quality.select("episode_id", "movement_score", "jerk_score", "stall_ratio")
    scored = measures.join(episodes.select(F.col("id").alias("episode_id"), "frame_count"), "episode_id").where("frame_count is not null")
    recent = episodes.orderBy(F.col("created_at").desc(), "id").limit(newest).where("max_gap_seconds is not null")
    widest = F.struct(F.col("max_gap_seconds"), F.unix_micros("created_at"), "id")
    parts = [
        counts(jobs, "state", "queue_depth"),
        jobs.where("state = 'queued'").agg(since(F.min("created_at")).alias("oldest_queued_age_seconds")),
        live.select(job.alias("j")).agg(F.transform(F.array_sort(F.collect_list("j")), lambda j: j.dropFields("at")).alias("running")),
        episodes.agg(F.try_divide(F.count_if(F.col("state") == "quarantined"), F.count("*")).alias("quarantine_rate")),
        counts(quality, "verdict", "verdict_rates"),
        scored.agg(F.avg("movement_score").alias("movement_mean"), F.avg("jerk_score").alias("jerk_mean"), F.avg("stall_ratio").alias("stall_mean"), F.expr("percentile_cont(0.5) within group (order by frame_count)").alias("frame_count_median")),
        recent.agg(F.max("max_gap_seconds").alias("max_episode_timestamp_gap_seconds"), F.max_by("id", widest).alias("timestamp_gap_scope"), F.max_by("source_hash", widest).alias("timestamp_gap_source")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")  # one row each
    return out.drop("_one")
