"""Metric streams: watermarked windows, and control limits that a breach holds still."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinetrace.operators.telemetry import ABSOLUTE_FLOOR, ALPHA, MAD_SCALE, RELATIVE_FLOOR, WARM, WINDOW

LIMIT, HOLD_SECONDS = 4.0, 3600


def windows(records: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Count, mean and extremes of each name in tumbling windows; rows later than `late` are dropped by the watermark."""
    timed = records.withWatermark("ts", late).groupBy("name", F.window("ts", f"{seconds} seconds"))
    out = timed.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select("name", F.col("window.start").alias("start"), "n", "mean", "low", "high")


def limits(sample: list[float]) -> tuple[float, float]:
    """Median and robust sigma of a sample, with its floors."""
    s = pd.Series(sample, dtype=float)
    median = float(s.median())
    mad = float((s - median).abs().median()) if len(s) > 1 else 0.0
    return median, max(MAD_SCALE * mad, RELATIVE_FLOOR * abs(median), ABSOLUTE_FLOOR)


def _observe(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sample, ewma, held = state.get if state.exists else ([], None, None)
    sample, out = list(sample), []
    rows = pd.concat(list(parts)).sort_values(["ts", "value"])
    for ts, value in zip(rows["ts"], rows["value"].astype(float), strict=True):
        now = ts.timestamp()
        if held is not None and now - held >= HOLD_SECONDS:
            held = None
            sample, ewma = [], None
        median, sigma = limits(sample) if sample else (value, ABSOLUTE_FLOOR)
        z = (value - median) / sigma if len(sample) >= WARM else 0.0
        if abs(z) > LIMIT:
            held = now if held is None else held
        else:
            held = None
            sample = [*sample, value][-WINDOW:]
            ewma = value if ewma is None else ewma + ALPHA * (value - ewma)
        out.append((key[0], ts, value, z, ewma, held is not None))
    state.update((sample, ewma, held))
    yield pd.DataFrame(out, columns=["name", "ts", "value", "z", "ewma", "held"])


def control_stream(records: DataFrame) -> DataFrame:
    """Each record's deviation from the limits its name had before it.

    State is 50 values a name. A breach is not learned and holds the limits; a value within them releases the
    hold, and a hold of an hour expires with its limits, which are then learned anew.
    """
    return records.select("name", "ts", F.col("value").cast("double").alias("value")).groupBy("name").applyInPandasWithState(
        _observe, "name string, ts timestamp, value double, z double, ewma double, held boolean", "sample array<double>, ewma double, held double", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, to: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there. Each batch replaces its own folder, so that a batch run again is written once."""

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(to if mode == "complete" else f"{to}/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
