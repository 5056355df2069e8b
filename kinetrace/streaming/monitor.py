"""The monitor as a stream: each micro-batch closes ticks, and each tick goes through detection, triage and the limits.

State and incidents are folders named by batch. A batch reads the newest folder below its own number and replaces its own, so that
one that runs again gives the same rows once. One streaming query is the one writer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.operators import monitoring
from kinetrace.session import cut

INCIDENTS = "fingerprint string, label string, severity string, notify_class string, scope string, summary string, status string, occurrence_count long, first_seen timestamp, last_seen timestamp"


def _latest(spark: SparkSession, folder: str, schema: str, below: int) -> DataFrame:
    try:
        every = spark.read.schema(f"{schema}, batch long").parquet(folder).where(F.col("batch") < below)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    newest = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == newest).drop("batch") if newest is not None else spark.createDataFrame([], schema)


def run_ticks(records: DataFrame, snapshots: Callable[[DataFrame], DataFrame], root: str, seconds: int = 60) -> None:
    """Evaluates a stream of metric records (name, value, labels, ts), window by window, as far as it is there.

    snapshots gets the ticks of a batch (tick, now) and gives their snapshot rows. A batch's ticks are few, and follow one another
    in order, as each depends on the limits after the one before.
    """

    def put(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        state, incidents = _latest(spark, f"{root}/state", monitoring.STATE, number), _latest(spark, f"{root}/incidents", INCIDENTS, number)
        rows = df.withColumn("tick", F.floor(F.unix_seconds("ts") / seconds))
        ticks = rows.select("tick").distinct().withColumn("now", F.timestamp_seconds((F.col("tick") + 1) * seconds))
        features = cut(monitoring.feature_windows(rows, snapshots(ticks), float(seconds)))
        signals = []
        for t in sorted(r.tick for r in features.select("tick").collect()):
            acted, state, incidents = monitoring.tick(features.where(F.col("tick") == t), state, incidents, float((t + 1) * seconds))
            signals.append(acted)
        for found in signals[:1]:
            for more in signals[1:]:
                found = found.unionByName(more)
            found.write.mode("overwrite").parquet(f"{root}/signals/batch={number}")
        state.write.mode("overwrite").parquet(f"{root}/state/batch={number}")
        incidents.write.mode("overwrite").parquet(f"{root}/incidents/batch={number}")

    records.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
