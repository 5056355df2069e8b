"""Planted recordings whose groups are known, and how far the redundancy report finds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 0.05


def planted(spark: SparkSession, behaviours: int, copies: int, decoys: int, frames: int = 90, dims: int = 4, jitter: float = 0.02, seed: int = 7) -> DataFrame:
    """(episode, truth, kind, frame, t, position_0..): takes of behaviours, and decoys that move alike but out of step.

    A take repeats its behaviour with its own amplitude and speed. All numbers come from hashes of names, so that any task
    makes the same ones.
    """
    def draw(*names) -> F.Column:
        """Between -1 and 1."""
        return F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(2_000_001)) / 1e6 - 1

    b = spark.range(behaviours).select(F.col("id").alias("b"))
    e = b.select("b", F.explode(F.sequence(F.lit(0), F.lit(copies + decoys - 1))).alias("k"))
    e = e.withColumn("decoy", F.col("k") >= copies).withColumn("episode", F.format_string("b%d-%s%d", "b", F.when(F.col("decoy"), "d").otherwise("c"), F.when(F.col("decoy"), F.col("k") - copies).otherwise(F.col("k"))))
    take = ~F.col("decoy") & (F.col("k") > 0)
    e = e.withColumns({"amplitude": F.when(take, 1 + jitter * draw("episode", F.lit("a"))).otherwise(1.0), "speed": F.when(take, 1 + jitter * draw("episode", F.lit("s"))).otherwise(1.0)})
    f = e.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    at = F.least((F.col("frame") * F.col("speed")).cast("int"), F.lit(frames - 1))
    period = F.when(F.col("decoy"), 6.0 + F.col("b") % 7 * 2.5).otherwise(4.0 + F.col("b") * 0.75)
    columns = []
    for j in range(dims):
        weight = F.when(F.col("decoy"), 0.4 + (F.col("b") + j) % 5 * 0.15).otherwise(0.35 + 0.08 * F.col("b") + 0.05 * j)
        phase = F.when(F.col("decoy"), 3.141592653589793 * draw("episode", F.lit(f"p{j}"))).otherwise(0.0)
        columns.append((weight * F.col("amplitude") * F.sin(6.283185307179586 * at / (period + j * 0.5) + phase)).alias(f"position_{j}"))
    truth = F.when(F.col("decoy"), F.col("episode")).otherwise(F.format_string("b%d", "b"))
    return f.select("episode", truth.alias("truth"), F.when(F.col("decoy"), "decoy").otherwise("recording").alias("kind"), "frame", (F.col("frame") * STEP).alias("t"), *columns)


def report_scores(report: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 over the pairs that a redundancy report puts together; from counts of groups, without pairs.

    truth: episode, truth.
    """
    def pairs(n: F.Column) -> F.Column:
        return F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))

    j = truth.select("episode", "truth").distinct().join(report.select("episode", "representative"), "episode", "left")
    cells = j.where("representative is not null").groupBy("truth", "representative").agg(F.count("*").alias("n"))
    found = [cells.agg(pairs(F.col("n")).alias("tp")), cells.groupBy("representative").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("together")), j.groupBy("truth").agg(F.count("*").alias("n")).agg(pairs(F.col("n")).alias("true"))]
    one = found[0].withColumn("_", F.lit(1))
    for x in found[1:]:
        one = one.join(x.withColumn("_", F.lit(1)), "_")
    return one.select(F.coalesce(F.try_divide("tp", "together"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "true"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), F.col("together") + F.col("true")), F.lit(0.0)).alias("f1"))


def motion_table(quality: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode_id, verdict, frame_count, movement a frame and a second, jerk, stall): a listing's readouts, in both units.

    episodes: id, frame_count, fps; without a rate there is no value a second.
    """
    j = quality.select("episode_id", "verdict", "movement_score", "jerk_score", "stall_ratio").join(episodes.select(F.col("id").alias("episode_id"), "frame_count", "fps"), "episode_id")
    return j.withColumn("movement_per_second", F.col("movement_score") * F.col("fps"))
