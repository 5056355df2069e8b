"""Telemetry records, control limits and triage: (name, value, unit, labels, ts) rows in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the monitoring contract.
WINDOW, WARM, ALPHA, MAD_SCALE, RELATIVE_FLOOR, ABSOLUTE_FLOOR = 50, 20, 0.2, 1.4826, 0.05, 1e-9
BUDGET, COOLDOWN_SECONDS = 10, 1800
SEVERITIES = ("info", "low", "medium", "high", "critical")


def label_key(labels: str | Column) -> Column:
    """A map's entries as k=v, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


def metric_summary(records: DataFrame, key: str = "label_key", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Count, extremes, mean, sum and nearest-rank percentiles of each name and label set."""
    p = {n: F.expr(f"percentile_disc({q}) within group (order by value)").alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
    return records.groupBy("name", key).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.sum("value").alias("total"), *p.values(), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("value", F.struct(*order)).alias("last_value")
    )


def metric_series(records: DataFrame, seconds: int) -> DataFrame:
    """Mean and count of each name in buckets of whole seconds since the epoch."""
    if seconds <= 0:
        raise ValueError("a bucket has one second or more")
    bucket = (F.floor(F.unix_seconds("ts") / seconds) * seconds).cast("long")
    return records.groupBy("name", bucket.alias("bucket")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def control_limits(records: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Per name: the last 50 values' median and MAD sigma, the EWMA centre of all values, and the warm flag.

    The EWMA is the closed form of its recurrence, a weighted sum over all rows by their rank from the newest; only the last
    50 rows of a name are ever collected.
    """
    back = Window.partitionBy("name").orderBy(*[F.col(c).desc() for c in order])
    r = records.withColumn("back", F.row_number().over(back)).withColumn("n", F.count("*").over(Window.partitionBy("name")))
    weight = F.when(F.col("back") == F.col("n"), 1.0).otherwise(ALPHA) * F.pow(F.lit(1 - ALPHA), F.col("back") - 1)
    s = r.groupBy("name").agg(F.array_sort(F.collect_list(F.when(F.col("back") <= WINDOW, F.col("value")))).alias("sample"), F.sum(F.col("value") * weight).alias("ewma"))
    median = "if(size({0}) % 2 = 1, element_at({0}, cast(size({0}) div 2 + 1 as int)), (element_at({0}, cast(size({0}) div 2 as int)) + element_at({0}, cast(size({0}) div 2 + 1 as int))) / 2)"
    s = s.withColumn("median", F.expr(median.format("sample")))
    s = s.withColumn("off", F.expr("array_sort(transform(sample, x -> abs(x - median)))"))
    s = s.withColumn("mad", F.expr(f"if(size(sample) < 2, 0D, {median.format('off')})"))
    sigma = F.greatest(MAD_SCALE * F.col("mad"), RELATIVE_FLOOR * F.abs("median"), F.lit(ABSOLUTE_FLOOR))
    return s.select("name", F.size("sample").alias("observations"), "median", "mad", sigma.alias("sigma"), "ewma", (F.size("sample") >= WARM).alias("warm"))


def robust_z(value: Column, median: Column, sigma: Column, warm: Column) -> Column:
    """Deviation in robust sigmas; 0 while cold."""
    return F.when(warm, (value - median) / sigma).otherwise(0.0)


def identity(label: str, scope: str, signature: str) -> Column:
    """The fingerprint by which repeated signals are one incident."""
    return F.substring(F.sha2(F.concat_ws("|", label, scope, signature).cast("binary"), 256), 1, 16)


def triage(signals: DataFrame, incidents: DataFrame, floor: str = "medium", budget: int = BUDGET, cooldown: int = COOLDOWN_SECONDS) -> DataFrame:
    """Adds `action` to ordered signals (window, seq, fingerprint, severity, has_evidence, ts).

    incidents: fingerprint, status, last_seen. The first rule that applies decides: no evidence, severity
    floor, bump of an open incident, cooldown, budget of the window, open. Signals that pass all others
    take the budget in their order.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    known = incidents.select("fingerprint", F.col("status").alias("_status"), F.col("last_seen").alias("_seen"))
    s = signals.join(known, "fingerprint", "left")
    early = (
        F.when(~F.col("has_evidence"), "suppress_no_evidence")
        .when(rank < SEVERITIES.index(floor) + 1, "suppress_severity")
        .when(F.col("_status").isNotNull() & (F.col("_status") != "resolved"), "bump")
        .when(F.col("_seen").isNotNull() & (F.unix_micros("ts") - F.unix_micros("_seen") < cooldown * 1_000_000), "suppress_cooldown")
    )
    s = s.withColumn("_early", early)
    before = Window.partitionBy("window").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    used = F.count_if(F.col("_early").isNull()).over(before)
    return s.withColumn("action", F.coalesce("_early", F.when(used > budget, "suppress_budget").otherwise("open"))).drop("_early", "_status", "_seen")


def contract_outcome(produced: Column, valid: Column, settled: Column, expected: Column, fraction: Column, late: Column, overran: Column) -> Column:
    """short, degraded, missed, pending or met, in that order of precedence."""
    valid = F.least(valid, produced)
    return (
        F.when(settled & expected.isNotNull() & (valid < expected), "short")
        .when(settled & fraction.isNotNull() & (produced > 0) & (valid < fraction * produced), "degraded")
        .when(~settled & F.coalesce(late, F.lit(False)), "missed")
        .when(~settled, "pending")
        .when(F.coalesce(overran, F.lit(False)), "missed")
        .otherwise("met")
    )
