"""Registered queries over the driver's tables, and the DuckDB SQL of each that has one.

The driver has no recordings, so each operator runs on the table that has its shape: users' events and
suppliers' lines as episodes, orders as the catalog, events as telemetry, part names as task strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.functions import tasks
from kinetrace.operators import catalog, curation, evaluation, quality, redundancy, telemetry, validation, vocabulary
from kinetrace.session import prepare, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    # Stamps without a zone are UTC, as the session is.
    zoneless = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"} if name in ("events", "lineitem") else {}
    return df.withColumns(zoneless) if zoneless else df


def query(sql: str | None = None):
    """Register a function as a query, with its DuckDB SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def oracle(name: str, sql: str) -> None:
    """The DuckDB SQL of a query that is registered below."""
    SQL[name] = sql


# --- motion quality -----------------------------------------------------------------------------------

_QUALITY_SQL = """
WITH f AS ({frames}),
r AS (SELECT ep, dim, max(v) - min(v) AS span, count(DISTINCT v) AS u FROM f GROUP BY ep, dim),
d AS (SELECT f.ep, f.dim, f.i, abs(v - lag(v) OVER (PARTITION BY f.ep, f.dim ORDER BY f.i)) AS a,
             t - lag(t) OVER (PARTITION BY f.ep, f.dim ORDER BY f.i) AS dt, CASE WHEN span = 0 THEN 1 ELSE span END AS s FROM f JOIN r USING (ep, dim)),
g AS (SELECT ep, dim, quantile_disc(a / s, 0.95) >= 0.001 AS active, stddev_pop(a / s) AS sd, avg(a / s) AS m FROM d WHERE a IS NOT NULL GROUP BY ep, dim),
j AS (SELECT g.ep, g.dim, sd, row_number() OVER (PARTITION BY g.ep ORDER BY sd, g.dim) AS n, count(*) OVER (PARTITION BY g.ep) AS c
      FROM g JOIN r USING (ep, dim) WHERE active AND u > 4),
v AS (SELECT ep, max(sd) FILTER (n = c // 2 + 1) AS mid, max(sd) FILTER (n = c) AS top, max(dim) FILTER (n = c) AS worst_dim, max(c) AS judged FROM j GROUP BY ep),
x AS (SELECT ep, i, sqrt(sum(a * a)) AS l2, bool_and(a < 0.001 * s) AS still, max(dt) AS dt FROM d WHERE a IS NOT NULL GROUP BY ep, i),
k AS (SELECT ep, list_sort(list(dt))[count(*) // 2 + 1] AS med FROM x GROUP BY ep),
e AS (SELECT x.ep, count(*) + 1 AS frame_count, avg(l2) AS movement, avg(CASE WHEN still THEN 1.0 ELSE 0.0 END) AS stall, max(dt) AS widest,
             CASE WHEN max(med) <= 0 THEN CASE WHEN max(dt) > 0 THEN 1.0 ELSE 0.0 END ELSE avg(CASE WHEN dt > 5 * med THEN 1.0 ELSE 0.0 END) END AS ratio
      FROM x JOIN k USING (ep) GROUP BY x.ep),
q AS (SELECT ep, avg(m) AS jerk FROM g WHERE active GROUP BY ep)
SELECT e.ep, CAST(frame_count AS BIGINT) AS frame_count, round(movement + 1e-9, 6) AS movement_score, round(coalesce(jerk, 0), 9) AS jerk_score, round(stall, 9) AS stall_ratio,
       CASE WHEN mid >= 0.1 THEN 'jerky' WHEN mid >= 0.02 THEN 'moderate' WHEN mid IS NULL THEN 'unknown' ELSE 'smooth' END AS verdict,
       CASE WHEN top >= 0.1 THEN 'jerky' WHEN top >= 0.02 THEN 'moderate' WHEN top IS NULL THEN 'unknown' ELSE 'smooth' END AS worst_verdict,
       worst_dim, CAST(coalesce(judged, 0) AS INTEGER) AS judged_dims, round(widest + 1e-9, 6) AS max_gap_seconds, round(ratio, 9) AS gap_ratio,
       CASE WHEN ratio > 0 THEN 'gapped' ELSE 'ok' END AS integrity
FROM e LEFT JOIN q USING (ep) LEFT JOIN v USING (ep)"""
_EVENT_FRAMES = "SELECT user_id AS ep, 'value' AS dim, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) / 1000000.0::DOUBLE AS t, value AS v FROM events"
_LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice, l_partkey"
_LINE_FRAMES = f"""SELECT ep, i, t, unnest(['l_discount', 'l_quantity', 'l_tax']) AS dim, unnest([l_discount, l_quantity, l_tax]) AS v FROM
 (SELECT l_suppkey AS ep, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_ORDER}) AS i, epoch_us(l_shipdate) / 1000000.0::DOUBLE AS t, * FROM lineitem)"""


def _shown_quality(q: DataFrame) -> DataFrame:
    r = {"movement_score": 6, "jerk_score": 9, "stall_ratio": 9, "max_gap_seconds": 6, "gap_ratio": 9}
    return q.select("ep", "frame_count", *[F.round(F.col(c) + (1e-9 if n == 6 else 0.0), n).alias(c) for c, n in r.items()], "verdict", "worst_verdict", "worst_dim", "judged_dims", "integrity")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("ep"), "event_id", (F.unix_micros("ts") / 1e6).alias("t"), "value")


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").withColumn("ep", F.col("l_suppkey")).withColumn("t", F.unix_micros("l_shipdate") / 1e6)


@query(_QUALITY_SQL.replace("{frames}", _EVENT_FRAMES))
def episode_quality(spark, sf_dir):
    return _shown_quality(quality.episode_quality(event_frames(spark, sf_dir), "ep", ["t", "event_id"], ["value"], "t"))


@query(_QUALITY_SQL.replace("{frames}", _LINE_FRAMES))
def episode_quality_multi(spark, sf_dir):
    dims = ["l_quantity", "l_discount", "l_tax"]
    return _shown_quality(quality.episode_quality(line_frames(spark, sf_dir), "ep", _LINE_ORDER.split(", "), dims, "t"))


@query("SELECT verdict, integrity, CAST(count(*) AS BIGINT) AS n FROM (" + _QUALITY_SQL.replace("{frames}", _EVENT_FRAMES) + ") GROUP BY verdict, integrity")
def verdict_counts(spark, sf_dir):
    return episode_quality(spark, sf_dir).groupBy("verdict", "integrity").agg(F.count("*").alias("n"))


@query(
    f"""WITH f AS ({_EVENT_FRAMES}), d AS (SELECT *, abs(v - lag(v) OVER w) AS a, t - lag(t) OVER w AS dt, max(v) OVER p - min(v) OVER p AS s FROM f WINDOW w AS (PARTITION BY ep ORDER BY i), p AS (PARTITION BY ep)),
    m AS (SELECT ep, 5 * list_sort(list(dt))[count(*) // 2 + 1] AS lim FROM d WHERE dt IS NOT NULL GROUP BY ep),
    r AS (SELECT d.ep, dt, lim, a / s AS score, sum(CASE WHEN dt > lim THEN 1 ELSE 0 END) OVER (PARTITION BY d.ep ORDER BY i) AS run FROM d JOIN m USING (ep) WHERE dt IS NOT NULL)
    SELECT ep, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n, round(avg(score), 9) AS mean_score FROM r WHERE dt <= lim GROUP BY ep, run"""
)
def motion_trace_runs(spark, sf_dir):
    runs = quality.motion_runs(event_frames(spark, sf_dir), "ep", ["t", "event_id"], ["value"], "t")
    return runs.groupBy("ep", "run").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"))


@query()
def episode_fingerprints(spark, sf_dir):
    return redundancy.fingerprints(event_frames(spark, sf_dir), "ep", ["t", "event_id"], ["value"], "t")


@query()
def redundancy_report(spark, sf_dir):
    return redundancy.redundancy(episode_fingerprints(spark, sf_dir))


# --- telemetry ----------------------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("name", F.col("event_type"))
    return e.withColumn("labels", F.create_map(F.lit("decade"), ((F.get_json_object("props", "$.k").cast("int") / 10).cast("int")).cast("string"))).withColumn("label_key", telemetry.label_key("labels"))


_RECORDS = "SELECT *, event_type AS name, 'decade=' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS VARCHAR) AS label_key FROM events"


@query(
    f"""SELECT name, label_key, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, quantile_disc(value, 0.5) AS p50,
    quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_max(value, event_id) AS last_value FROM ({_RECORDS}) GROUP BY name, label_key"""
)
def metric_summary(spark, sf_dir):
    s = telemetry.metric_summary(records(spark, sf_dir))
    return s.select("name", "label_key", "n", "low", "high", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"), "p50", "p95", "p99", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "last_value")


@query("SELECT event_type AS name, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def metric_series(spark, sf_dir):
    return telemetry.metric_series(records(spark, sf_dir), 3600).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type AS name, epoch_us(time_bucket(INTERVAL 60 SECOND, ts)) AS start_us, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def metric_series_tumbling(spark, sf_dir):
    w = records(spark, sf_dir).groupBy("name", F.window("ts", "60 seconds").alias("w")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    return w.select("name", F.unix_micros("w.start").alias("start_us"), "mean", "n")


oracle("window_records", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL '1' DAY FROM events) GROUP BY event_type")
oracle("json_label_projection", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")


@query("SELECT event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def newest_record(spark, sf_dir):
    return catalog.newest_per_key(_t(spark, sf_dir, "events"), "event_type", F.struct("ts", -F.col("event_id")), "event_id", "value")


@query("SELECT event_type, CAST(greatest(0, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) AS BIGINT) AS age_us FROM events GROUP BY event_type")
def heartbeat_age(spark, sf_dir):
    return catalog.ages(_t(spark, sf_dir, "events"), "event_type", "ts")


@query(
    """SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS error_rate, quantile_disc(value, 0.95) AS p95,
    quantile_disc(value, 0.95) FILTER (event_type = 'click') AS click_p95, count(DISTINCT user_id) AS users FROM events GROUP BY 1"""
)
def feature_vector(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("hour", F.floor(F.unix_seconds("ts") / 3600))
    return e.groupBy("hour").agg(
        F.count("*").alias("n"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 9).alias("error_rate"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"),
        F.expr("percentile_disc(0.95) within group (order by if(event_type = 'click', value, null))").alias("click_p95"), F.countDistinct("user_id").alias("users"),
    )


_LIMITS = """WITH r AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS b, count(*) OVER (PARTITION BY event_type) AS c FROM events),
m AS (SELECT name, median(value) AS med, count(*) AS obs FROM r WHERE b <= 50 GROUP BY name),
d AS (SELECT r.name, median(abs(value - med)) AS mad FROM r JOIN m USING (name) WHERE b <= 50 GROUP BY r.name),
w AS (SELECT name, sum(value * CASE WHEN b = c THEN pow(0.8, b - 1) ELSE 0.2 * pow(0.8, b - 1) END) AS ewma FROM r WHERE b <= 400 GROUP BY name)
SELECT name, CAST(obs AS INTEGER) AS observations, round(med, 6) AS median, round(mad, 6) AS mad, round(greatest(1.4826 * mad, 0.05 * abs(med), 1e-9), 6) AS sigma, round(ewma, 6) AS ewma, obs >= 20 AS warm
FROM m JOIN d USING (name) JOIN w USING (name)"""


@query(_LIMITS)
def control_limits(spark, sf_dir):
    c = telemetry.control_limits(records(spark, sf_dir))
    return c.select("name", "observations", *[F.round(x, 6).alias(x) for x in ("median", "mad", "sigma", "ewma")], "warm")


@query(f"WITH l AS ({_LIMITS}), v AS (SELECT event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT name, value, round((value - median) / sigma, 4) AS z, abs((value - median) / sigma) > 4 AS shifted FROM l JOIN v USING (name)")
def robust_z(spark, sf_dir):
    newest = newest_record(spark, sf_dir).withColumnRenamed("event_type", "name")
    z = telemetry.robust_z(F.col("value"), F.col("median"), F.col("sigma"), F.col("warm"))
    return control_limits(spark, sf_dir).join(newest, "name").select("name", "value", F.round(z, 4).alias("z"), (F.abs(z) > 4).alias("shifted"))


@query(
    """WITH s AS (SELECT event_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, substr(sha256(event_type || '|' || user_id || '|v'), 1, 16) AS fp, value > 20 AS ev, value > 100 AS sev, user_id % 10 = 3 AS op FROM events WHERE event_type = 'error'),
    t AS (SELECT *, CASE WHEN NOT ev THEN 'suppress_no_evidence' WHEN NOT sev THEN 'suppress_severity' WHEN op THEN 'bump' END AS early FROM s)
    SELECT event_id, fp AS fingerprint, coalesce(early, CASE WHEN sum(CASE WHEN early IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY event_id) > 10 THEN 'suppress_budget' ELSE 'open' END) AS action FROM t"""
)
def triage_budget(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("event_type = 'error'")
    s = e.select(
        "event_id", F.col("event_id").alias("seq"), F.floor(F.unix_seconds("ts") / 86400).alias("window"), "user_id", "ts", telemetry.identity("event_type", F.col("user_id").cast("string"), F.lit("v")).alias("fingerprint"),
        (F.col("value") > 20).alias("has_evidence"), F.when(F.col("value") > 100, "high").otherwise("low").alias("severity"),
    )
    known = s.where("user_id % 10 = 3").select("fingerprint").distinct().select("fingerprint", F.lit("open").alias("status"), F.lit(None).cast("timestamp").alias("last_seen"))
    return telemetry.triage(s, known).select("event_id", "fingerprint", "action")


@query(
    """WITH j AS (SELECT o_custkey, count(*) AS produced, count(*) FILTER (o_orderstatus = 'F') AS valid FROM orders GROUP BY 1)
    SELECT o_custkey, CAST(produced AS BIGINT) AS produced, CAST(valid AS BIGINT) AS valid, CASE WHEN valid < 2 THEN 'short' WHEN valid < 0.4 * produced THEN 'degraded' WHEN produced > 15 THEN 'missed' ELSE 'met' END AS outcome FROM j"""
)
def contract_outcomes(spark, sf_dir):
    j = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("produced"), F.count_if(F.col("o_orderstatus") == "F").alias("valid"))
    out = telemetry.contract_outcome(F.col("produced"), F.col("valid"), F.lit(True), F.lit(2), F.lit(0.4), F.lit(False), F.col("produced") > 15)
    return j.select("o_custkey", "produced", "valid", out.alias("outcome"))


# --- catalog ------------------------------------------------------------------------------------------

oracle("state_counts", "SELECT s.st AS state, count(o.o_orderkey) AS n FROM (SELECT 'F' AS st UNION ALL SELECT 'O' UNION ALL SELECT 'P' UNION ALL SELECT 'X') s LEFT JOIN orders o ON o.o_orderstatus = s.st GROUP BY s.st")
oracle("length_zscore", "WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd FROM l) SELECT l_orderkey, n, round(CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (n - m) / sd END, 6) AS z FROM l CROSS JOIN s")
oracle("top_outliers", "WITH p AS (SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS r FROM orders) SELECT o_orderstatus, o_orderkey, o_totalprice, r FROM p WHERE r <= 5")
SQL["top_outliers"] = SQL["top_outliers"].replace(" r FROM p", " CAST(r AS INTEGER) AS r FROM p")
oracle("median_lengths", "SELECT o_orderstatus, median(o_totalprice) AS med, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS cont, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY o_orderstatus")
oracle("episodes_page", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 50")
oracle("unscored_episodes", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
oracle("scored_episodes", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
oracle("job_report", "SELECT c.c_custkey, count(o.o_orderkey) AS n, count(*) FILTER (WHERE o.o_orderstatus = 'F') AS done, round(avg(o.o_totalprice), 6) AS mean_price, max(o.o_totalprice) AS top_price FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
oracle("content_hash_dedup", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS keep_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
oracle("entry_listing", "SELECT source, count(*) AS tasks, count(DISTINCT lang) AS langs, sum(n_chars) AS chars FROM documents GROUP BY source")
SQL["entry_listing"] = SQL["entry_listing"].replace("sum(n_chars)", "CAST(sum(n_chars) AS BIGINT)")
oracle("vocabulary_health", "SELECT d.source, count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS unmapped, count(*) FILTER (WHERE l.quality = 0) AS dismissed, count(*) FILTER (WHERE l.quality = 1) AS mapped FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source")
oracle("orphans", "SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
oracle("failing_orders", "SELECT o.o_orderkey, count(*) AS n FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND NOT l.l_quantity < 40 GROUP BY o.o_orderkey")
oracle("job_transitions", "WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) SELECT coalesce(was, 'none') AS was, role, count(*) AS n, count(*) FILTER (WHERE was IS NOT NULL AND (was = role OR role = 'system')) AS illegal FROM t GROUP BY coalesce(was, 'none'), role")
oracle("impure_clusters", "WITH p AS (SELECT source AS cluster, lang AS label, count(*) AS n FROM documents GROUP BY source, lang) SELECT cluster, count(*) AS labels, round(max(n) / CAST(sum(n) AS DOUBLE), 9) AS share FROM p GROUP BY cluster HAVING count(*) > 1")
oracle("lineage_forward", "SELECT r.r_name, n.n_name, count(DISTINCT c.c_custkey) AS customers, count(o.o_orderkey) AS orders FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_name, n.n_name")
_CLOSURE = """WITH RECURSIVE e AS (SELECT concat('r', r_regionkey) AS a, concat('n', n_nationkey) AS b FROM {region} JOIN {nation} ON n_regionkey = r_regionkey
 UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM {customer} UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey) FROM {orders}),
 w AS (SELECT 'r0' AS node, 0 AS depth UNION ALL SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 5) SELECT depth, count(*) AS n FROM w GROUP BY depth"""
oracle("lineage_closure", _CLOSURE.replace("{", "").replace("}", ""))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' OR (o_orderdate = TIMESTAMP '1997-01-01' AND o_orderkey < 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def episodes_keyset(spark, sf_dir):
    cursor = F.lit("1997-01-01").cast("timestamp_ntz"), F.lit(1000)
    return curation.page(_t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate")), [("o_orderdate", True), ("o_orderkey", True)], 50, cursor)


_HIST = """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), s AS (SELECT min(n) AS lo, max(n) AS hi FROM l),
w AS (SELECT lo, CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / 10.0::DOUBLE END AS wd FROM s), b AS (SELECT least(CAST(floor((n - lo) / wd) AS BIGINT), 9) AS bin, count(*) AS n FROM l, w GROUP BY 1)
SELECT r.bin, CAST(coalesce(b.n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN b USING (bin)"""


@query(_HIST)
def length_histogram(spark, sf_dir):
    lengths = catalog.counts(_t(spark, sf_dir, "lineitem"), "l_orderkey")
    return catalog.histogram(lengths, "n").select("bin", "n")


@query("SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY l_returnflag")
def quality_heat_matrix(spark, sf_dir):
    return catalog.matrix(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", F.round(F.avg("l_quantity"), 6), ["F", "O"])


@query(
    """WITH m AS (SELECT *, o_orderstatus = 'F' AND o_totalprice > 150000 AS k FROM orders) SELECT CASE WHEN k THEN 'kept' ELSE 'dropped' END AS side, count(*) AS n, median(o_totalprice) AS price FROM m WHERE k IS NOT NULL GROUP BY 1"""
)
def slice_impact(spark, sf_dir):
    rule = {"all": [{"field": "o_orderstatus", "op": "eq", "value": "F"}, {"field": "o_totalprice", "op": "gt", "value": 150000}]}
    return curation.slice_impact(_t(spark, sf_dir, "orders"), curation.predicate(rule, {"o_orderstatus", "o_totalprice"}), {"price": F.col("o_totalprice")})


@query("SELECT CASE WHEN o_orderstatus IS DISTINCT FROM 'F' THEN 'state' WHEN o_totalprice <= 150000 THEN 'price' ELSE 'unscored' END AS reason, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 150000) GROUP BY 1")
def drop_reasons(spark, sf_dir):
    checks = [("state", F.col("o_orderstatus").eqNullSafe("F")), ("price", F.col("o_totalprice") > 150000)]
    return catalog.drop_reasons(_t(spark, sf_dir, "orders"), checks)


def _episodes(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("frame_count"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.avg("l_quantity").alias("mean"), F.max("l_discount").alias("disc"))
    o = _t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    channel = F.struct(F.lit("quantity").alias("name"), F.col("lo").alias("min"), F.col("hi").alias("max"), F.col("mean"), F.lit(0.0).alias("std"))
    return o.select("o_orderkey", F.coalesce("frame_count", F.lit(0)).alias("frame_count"), (F.col("o_totalprice") / 1000).alias("duration_seconds"), F.when(F.col("o_orderstatus") != "P", F.coalesce("hi", F.lit(0.0))).alias("fps"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("task"), F.when(F.col("lo").isNull(), F.array().cast("array<struct<name:string,min:double,max:double,mean:double,std:double>>")).otherwise(F.array(channel)).alias("channels"))


PROFILE = validation.Profile("orders", required=("quantity",), min_frames=2, max_frames=6, min_duration=50.0, max_duration=400.0, min_fps=20.0)
_VALID = """WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
e AS (SELECT o_orderkey, coalesce(n, 0) AS n, o_totalprice / 1000 AS d, CASE WHEN o_orderstatus <> 'P' THEN coalesce(hi, 0) END AS fps, o_orderpriority, hi FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
v AS (SELECT o_orderkey, list_sort(list_filter([CASE WHEN d < 50 THEN 'DURATION_TOO_SHORT' END, CASE WHEN d > 400 THEN 'DURATION_TOO_LONG' END, CASE WHEN n < 2 THEN 'TOO_FEW_FRAMES' END, CASE WHEN n > 6 THEN 'TOO_MANY_FRAMES' END,
 CASE WHEN n = 0 THEN 'EMPTY_EPISODE' END, CASE WHEN fps < 20 THEN 'FRAME_RATE_OUT_OF_BOUNDS' END, CASE WHEN fps IS NULL THEN 'FRAME_RATE_UNDECLARED' END, CASE WHEN hi IS NULL THEN 'REQUIRED_CHANNEL_MISSING' END,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'UNDECLARED_TASK' END], lambda x: x IS NOT NULL)) AS codes FROM e)"""


@query(_VALID + " SELECT o_orderkey, array_to_string(codes, ',') AS codes, len(codes) = 0 AS passed FROM v")
def validation_rules(spark, sf_dir):
    v = validation.validate(_episodes(spark, sf_dir), PROFILE)
    return v.select("o_orderkey", F.array_join("reason_codes", ",").alias("codes"), "passed")


@query(_VALID + " SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM v) GROUP BY code")
def reason_code_histogram(spark, sf_dir):
    return catalog.exploded_counts(validation.validate(_episodes(spark, sf_dir), PROFILE), "reason_codes")


@query(_VALID + " SELECT count(*) AS evaluated, count(*) FILTER (len(codes) > 0) AS quarantined, count(*) FILTER (len(codes) = 0) AS valid FROM v")
def failure_summary(spark, sf_dir):
    v = validation.validate(_episodes(spark, sf_dir), PROFILE)
    return v.agg(F.count("*").alias("evaluated"), F.count_if(~F.col("passed")).alias("quarantined"), F.count_if("passed").alias("valid"))


_COVERAGE = """WITH c AS (SELECT o_orderstatus, o_orderpriority, n_name, c_mktsegment = 'BUILDING' AND o_totalprice > 495000 AS b FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
u AS (SELECT 'status' AS axis, o_orderstatus AS value, b FROM c UNION ALL SELECT 'priority', o_orderpriority, b FROM c UNION ALL SELECT 'nation', n_name, b FROM c),
g AS (SELECT axis, value, count(*) FILTER (b) AS build_count, count(*) AS catalog_count FROM u GROUP BY axis, value),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY axis ORDER BY build_count DESC, value) AS INTEGER) AS build_rank, CAST(row_number() OVER (PARTITION BY axis ORDER BY value) AS INTEGER) AS value_rank,
 count(*) FILTER (build_count = 0) OVER p AS gap_total, count(*) FILTER (build_count > 0) OVER p AS build_distinct, count(*) OVER p AS catalog_distinct, CAST(sum(build_count) OVER p AS BIGINT) AS build_total,
 CAST(sum(catalog_count) OVER p AS BIGINT) AS catalog_total FROM g WINDOW p AS (PARTITION BY axis)) SELECT * FROM w WHERE build_rank <= 50 OR (build_count = 0 AND value_rank <= 50)"""


def _catalog(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    o = _t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("n_name").alias("nation"), ((F.col("c_mktsegment") == "BUILDING") & (F.col("o_totalprice") > 495000)).alias("inside"))


@query(_COVERAGE)
def build_coverage(spark, sf_dir):
    return curation.coverage(_catalog(spark, sf_dir), "inside", ["status", "priority", "nation"])


@query(f"SELECT axis, value, catalog_count FROM ({_COVERAGE}) WHERE build_count = 0")
def coverage_gaps(spark, sf_dir):
    return build_coverage(spark, sf_dir).where("build_count = 0").select("axis", "value", "catalog_count")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY o_custkey")
def artifact_members(spark, sf_dir):
    found = catalog.members(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return found.select("o_custkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT l_suppkey AS channel, count(*) AS n, CAST(0 AS BIGINT) AS nonfinite, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY l_suppkey")
def channel_statistics(spark, sf_dir):
    s = catalog.value_statistics(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity").withColumnRenamed("l_suppkey", "channel")
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, event_id FROM events) SELECT user_id, CAST(max(gap) AS BIGINT) AS gap_us, arg_max(event_id, gap) AS event_id FROM g GROUP BY user_id")
def max_timestamp_gap(spark, sf_dir):
    g = catalog.widest_gap(_t(spark, sf_dir, "events"), "user_id", F.unix_micros("ts"), ["event_id"], "event_id")
    return g.withColumnRenamed("gap", "gap_us")


# --- task strings and clusters ------------------------------------------------------------------------


def _words(names: list[str]) -> str:
    return "[" + ",".join(f"'{n}'" for n in names) + "]"


_ONE, _TWO = [v for v in tasks.VERBS if " " not in v], [v for v in tasks.VERBS if " " in v]
_CORE = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
v AS (SELECT *, CASE WHEN list_contains({_words(_TWO)}, array_to_string(w[1:2], ' ')) THEN array_to_string(w[1:2], ' ') WHEN list_contains({_words(_ONE)}, w[1]) THEN w[1] ELSE '' END AS verb FROM w)
SELECT doc_id, verb, md5(array_to_string(list_filter(w[CASE WHEN verb = '' THEN 1 WHEN contains(verb, ' ') THEN 3 ELSE 2 END:], lambda x: NOT list_contains({_words(list(tasks.STOPWORDS + tasks.COLOURS))}, x)), ' ')) AS core FROM v"""


@query(_CORE)
def task_core_extract(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("w", tasks.tokens("text")).withColumn("verb", tasks.leading_verb(F.col("w")))
    return d.select("doc_id", "verb", F.md5(tasks.core(F.col("w"), F.col("verb"))).alias("core"))


_PART_CORE = f"SELECT p_partkey, p_name, array_to_string(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: NOT list_contains({_words(list(tasks.STOPWORDS + tasks.COLOURS))}, x)), ' ') AS core FROM part"


def _part_cores(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("w", tasks.tokens("p_name"))
    return p.select("p_partkey", "p_name", tasks.core(F.col("w"), F.lit("")).alias("core"))


@query(f"SELECT core, count(*) AS parts, count(DISTINCT p_name) AS names FROM ({_PART_CORE}) GROUP BY core")
def distinct_cores(spark, sf_dir):
    return _part_cores(spark, sf_dir).groupBy("core").agg(F.count("*").alias("parts"), F.countDistinct("p_name").alias("names"))


@query(
    f"""WITH p AS ({_PART_CORE}), e AS (SELECT core, count(DISTINCT p_name) AS k, min(p_name) AS entry FROM p WHERE p_partkey % 7 = 0 GROUP BY core), u AS (SELECT core, count(*) AS n FROM p WHERE p_partkey % 7 <> 0 GROUP BY core)
    SELECT u.core, n, CASE WHEN k IS NULL THEN 'new_entry' ELSE 'attach' END AS kind, entry FROM u LEFT JOIN e ON e.core = u.core WHERE k IS NULL OR k = 1"""
)
def candidate_rank(spark, sf_dir):
    p = _part_cores(spark, sf_dir)
    entries = p.where("p_partkey % 7 = 0").select(F.col("p_name").alias("id"), F.col("p_name").alias("label"), "core").distinct()
    free = p.where("p_partkey % 7 <> 0").select(F.col("p_name").alias("task_string"), "core", F.lit(1).alias("episodes"))
    return vocabulary.candidates(free, entries).select("core", F.col("episodes").alias("n"), "kind", F.col("label").alias("entry"))


@query()
def task_clusters(spark, sf_dir):
    """Online clustering of the distinct task cores in order of first part, in one ordered group of distinct strings."""
    import pandas as pd

    def run(pdf):
        c = tasks.Centroids()
        found = [c.add(tasks.token_vector(x)) for x in pdf.sort_values("p_partkey")["core"]]
        return pd.DataFrame({"core": pdf.sort_values("p_partkey")["core"], "cluster": [f[0] for f in found], "distance": [f[1] for f in found]})

    first = _part_cores(spark, sf_dir).groupBy("core").agg(F.min("p_partkey").alias("p_partkey"))
    return first.groupBy().applyInPandas(run, "core string, cluster long, distance double")


@query(
    """WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), t AS (SELECT item_id, len(w) AS n, unnest(w) AS x FROM w),
    p AS (SELECT a.item_id AS a, b.item_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.item_id < b.item_id GROUP BY ALL) SELECT a, b, round(k / (na + nb - k), 9) AS jaccard FROM p WHERE k / (na + nb - k) > 0.05"""
)
def jaccard_pairs(spark, sf_dir):
    w = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), tasks.tokens("text").alias("words"))
    return evaluation.jaccard_pairs(w, 0.05).where("jaccard > 0.05").withColumn("jaccard", F.round("jaccard", 9))


_EVAL = """WITH e AS (SELECT vec_id, label, list_position(embedding, list_max(embedding)) - 1 AS cluster FROM embeddings),
c AS (SELECT label, cluster, count(*) AS n FROM e GROUP BY 1, 2), a AS (SELECT label, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT cluster, sum(n) AS n FROM c GROUP BY 1)"""


def _clusters(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("cluster"))


@query(_EVAL + """, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM a) AS p, (SELECT sum(n * (n - 1) / 2) FROM b) AS q, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
SELECT round((i - p * q / t) / ((p + q) / 2 - p * q / t), 6) AS ari, round(i / q, 6) AS pair_precision, round(i / p, 6) AS pair_recall, round(2 * i / (p + q), 6) AS pair_f1 FROM s""")
def adjusted_rand(spark, sf_dir):
    return evaluation.rand_scores(_clusters(spark, sf_dir), "label", "cluster").select(*[F.round(c, 6).alias(c) for c in ("ari", "pair_precision", "pair_recall", "pair_f1")])


@query(_EVAL + """ SELECT round(sum(c.n * (2 * (c.n / b.n) * (c.n / a.n) / (c.n / b.n + c.n / a.n))) / sum(c.n), 6) AS b_cubed FROM c JOIN a USING (label) JOIN b USING (cluster)""")
def b_cubed(spark, sf_dir):
    return evaluation.b_cubed(_clusters(spark, sf_dir), "label", "cluster").select(F.round("b_cubed", 6).alias("b_cubed"))


@query(_EVAL + " SELECT label, count(*) AS clusters, CAST(max(n) AS BIGINT) AS largest, count(*) = 1 AS intact FROM c GROUP BY label")
def fragmentation(spark, sf_dir):
    return evaluation.fragmentation(_clusters(spark, sf_dir), "label", "cluster").drop("modal_share")


@query(_EVAL + " SELECT cluster, label, round(n / sum(n) OVER (PARTITION BY cluster), 9) AS share FROM c")
def cluster_attribute_share(spark, sf_dir):
    return evaluation.attribute_shares(_clusters(spark, sf_dir), "cluster", "label").withColumn("share", F.round("share", 9))


@query(
    """WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, i, sum(x) AS x FROM u GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
    q AS (SELECT label, sum(x * x) AS x FROM u GROUP BY 1), w AS (SELECT label, sum(x * x) AS x FROM s GROUP BY 1) SELECT label, n, round((w.x - q.x) / (n * (n - 1)), 5) AS within FROM n JOIN q USING (label) JOIN w USING (label)"""
)
def axis_distance(spark, sf_dir):
    return catalog.distance_profile(_t(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id").withColumn("within", F.round("within", 5))


@query(SQL["metric_series_tumbling"])
def metric_series_stream(spark, sf_dir):
    """The windows of a stream over the files that are there, in update of one complete result."""
    from kinetrace.streaming.metrics import run_available, windows

    like = _t(spark, sf_dir, "events")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(raw).parquet(f"{sf_dir}/events.parque[t]")
    stream = stream.select(F.col("event_type").alias("name"), F.col("ts").cast(like.schema["ts"].dataType).alias("ts"), "value")
    to = shared_folder(spark, "metric-stream")
    run_available(windows(stream), f"{to}/rows", f"{to}/state", "complete")
    return spark.read.parquet(f"{to}/rows").select("name", F.unix_micros("start").alias("start_us"), F.round("mean", 6).alias("mean"), "n")
