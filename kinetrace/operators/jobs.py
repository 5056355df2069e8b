"""Analytics over job rows: submission, claims, transitions, reapers, settlement and failure texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may follow each state, the states that are not final, and the seconds after which a worker is dead.
TRANSITIONS = {
    "queued": ("running", "canceled", "timed_out"),
    "running": ("succeeded", "failed", "retrying", "timed_out", "cancel_requested"),
    "cancel_requested": ("canceled", "succeeded"),
    "retrying": ("queued", "failed"),
    "succeeded": (),
    "failed": (),
    "canceled": (),
    "timed_out": (),
}
ACTIVE = ("queued", "running", "cancel_requested", "retrying")
ORPHANED_SECONDS = 900
#: Reason codes by kind of error, and the kinds that are not tried again.
REASONS = {
    "export_build_unknown": "EXPORT_BUILD_UNKNOWN",
    "export": "EXPORT_FAILED",
    "payload": "INGEST_PARSE_FAILED",
    "reader": "INGEST_PARSE_FAILED",
    "job_type": "INGEST_FORMAT_UNKNOWN",
    "profile": "VALIDATION_PROFILE_INVALID",
    "data": "CATALOG_WRITE_REJECTED",
    "file_missing": "IO_ARTIFACT_MISSING",
    "disk_full": "IO_DISK_FULL",
    "write": "IO_WRITE_FAILED",
    "key": "INGEST_PARSE_FAILED",
}
TERMINAL = ("reader", "payload", "job_type", "conflict", "profile", "export_build_unknown", "export", "data")
LONGEST_MESSAGE = 400


def submitted(requests: DataFrame) -> DataFrame:
    """(idempotency_key, job, outcome): per request, the first of its key is created, equal ones replay it, others conflict.

    requests: idempotency_key, request_hash, seq; requests without a key are always created.
    """
    w = Window.partitionBy("idempotency_key").orderBy("seq")
    first = F.struct(F.first("seq").over(w).alias("seq"), F.first("request_hash").over(w).alias("hash"))
    r = requests.withColumn("_f", first)
    outcome = F.when(F.col("idempotency_key").isNull() | (F.col("seq") == F.col("_f.seq")), "created").when(F.col("request_hash") == F.col("_f.hash"), "replayed").otherwise("conflict")
    return r.select("idempotency_key", "seq", F.when(F.col("idempotency_key").isNull(), F.col("seq")).otherwise(F.col("_f.seq")).alias("job"), outcome.alias("outcome"))


def claimed(jobs: DataFrame, workers: int) -> DataFrame:
    """The next queued jobs in order of submission, one a worker, with the worker's number and one attempt more."""
    first = jobs.where("state = 'queued'").orderBy("created_at", "id").limit(workers)
    return first.withColumn("worker", F.row_number().over(Window.orderBy("created_at", "id"))).withColumns({"state": F.lit("running"), "attempts": F.col("attempts") + 1})


def transition_report(history: DataFrame, key: str, order: str, state: str, allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(was, state, n, illegal): the steps of each key's history, and whether a step is allowed; the first one has no state before."""
    allowed = TRANSITIONS if allowed is None else allowed
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    t = history.select(F.lag(state).over(Window.partitionBy(key).orderBy(order)).alias("was"), F.col(state).alias("state"))
    legal = F.col("was").isNull() | F.concat_ws(">", "was", "state").isin(pairs)
    return t.groupBy(F.coalesce("was", F.lit("none")).alias("was"), "state").agg(F.count("*").alias("n"), F.count_if(~legal).alias("illegal"))


def reaped(jobs: DataFrame, now: Column) -> DataFrame:
    """The jobs after both reapers: timed out past their deadline; of dead workers queued again or failed, by attempts left."""
    overdue = F.col("state").isin(*ACTIVE) & F.coalesce(F.col("deadline_at") < now, F.lit(False))
    dead = (F.col("state") == "running") & F.coalesce(F.unix_micros("started_at") < F.unix_micros(now) - ORPHANED_SECONDS * 1_000_000, F.lit(False))
    left = F.col("attempts") < F.col("max_attempts")
    state = F.when(overdue, "timed_out").when(dead & left, "queued").when(dead, "failed").otherwise(F.col("state"))
    error = F.when(overdue, "DeadlineExceeded").when(dead, "WorkerLost")
    return jobs.withColumns({"new_state": state, "error_type": error, "started_at": F.when(dead & left & ~overdue, F.lit(None).cast("timestamp")).otherwise(F.col("started_at"))})


def settled(failures: DataFrame) -> DataFrame:
    """Adds `settles`: canceled on request, queued again while attempts are left and the error is not terminal, else failed."""
    again = ~F.col("error_kind").isin(*TERMINAL) & (F.coalesce("attempts", F.lit(0)) < F.coalesce("max_attempts", F.lit(1)))
    return failures.withColumn("settles", F.when(F.coalesce("cancel_requested", F.lit(False)), "canceled").when(again, "queued").otherwise("failed"))


def reason_code(kind: Column) -> Column:
    """The reason code of a kind of error."""
    known = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit("INTERNAL_ERROR"))


def error_message(text: Column) -> Column:
    """One line of an error's text, without credentials, of at most 400 characters."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    line = F.regexp_replace(line, r"://[^/\s:@]+:[^/\s@]+@", "://***:***@")
    line = F.regexp_replace(line, r"(?i)\b(password|passwd|secret|token|api[_-]?key)\s*=\s*\S+", "$1=***")
    short = F.when(F.length(line) > LONGEST_MESSAGE, F.concat(F.rtrim(F.substring(line, 1, LONGEST_MESSAGE - 1)), F.lit("…"))).otherwise(line)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("job handler failed"))
