"""Motion quality of episodes: one row per frame in, one row per episode out, in one shuffle by episode."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the quality contract.
ACTIVE, DISCRETE, GAP_FACTOR, JERKY, MODERATE = 0.001, 4, 5, 0.1, 0.02


def band(sigma: Column) -> Column:
    return F.when(sigma >= JERKY, "jerky").when(sigma >= MODERATE, "moderate").otherwise("smooth")


def upper_median(array: Column) -> Column:
    """The element at n // 2 of a sorted array; null for an empty one."""
    return F.try_element_at(array, (F.floor(F.size(array) / 2) + 1).cast("int"))


def norm2(parts: list[Column]) -> Column:
    """The Euclidean norm, scaled by the largest part so that it does not overflow."""
    top = F.greatest(*map(F.abs, parts)) if len(parts) > 1 else F.abs(parts[0])
    return F.when(top == 0, 0.0).otherwise(top * F.sqrt(reduce(lambda a, b: a + b, ((p / top) * (p / top) for p in parts))))


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def transitions(frames: DataFrame, episode: str, order: list[str], dims: list[str], clock: str | None) -> DataFrame:
    """Adds d_<dim>, r_<dim> (range, 1 where it is 0), dt, med (the upper median of dt) and bad (non-finite values) to each frame.

    One shuffle by episode and one sort; what holds for a whole episode is one more window over the same rows.
    """
    ordered, whole = Window.partitionBy(episode).orderBy(*order), Window.partitionBy(episode)
    out = frames.withColumns({f"d_{d}": F.col(d) - F.lag(d).over(ordered) for d in dims} | {"dt": F.col(clock) - F.lag(clock).over(ordered) if clock else F.lit(None).cast("double")})
    # Of n values the (n // 2)-th from below is the middle one from above.
    median = F.expr(f"percentile_disc(0.5) within group (order by dt desc) over (partition by `{episode}`)") if clock else F.lit(None).cast("double")
    spans = {f"r_{d}": F.coalesce(F.nullif(F.max(d).over(whole) - F.min(d).over(whole), F.lit(0.0)), F.lit(1.0)) for d in dims}
    bad = reduce(lambda a, b: a + b, [F.when(_finite(d), 0).otherwise(1) for d in dims])
    return out.withColumns({**spans, "med": median, "bad": bad})


def _active(norm: Column, n: Column) -> Column:
    """Whether the nearest-rank 95th percentile reaches ACTIVE: fewer values than its rank lie below."""
    return F.count_if(norm < ACTIVE) < F.ceil(0.95 * n)


def episode_quality(frames: DataFrame, episode: str, order: list[str], dims: list[str], clock: str | None = None, widest: str | None = None) -> DataFrame:
    """Scores, verdicts and clock integrity of each episode, with its dimensions as an array of structs.

    Any non-finite value voids the episode: all scores are 0 and the verdict is unknown. Without a clock, or
    with a non-finite one, integrity is unknown; a clock that runs back is gapped and has no largest gap. `widest` names a
    column with an episode's exact widest gap, where its frames are a sample; it takes the place of the one measured.
    Aggregates hold counts, sums and a few values an episode, whatever its length.
    """
    dims = sorted(dims)
    t = transitions(frames, episode, order, dims, clock)
    still = reduce(lambda a, b: a & b, (F.abs(f"d_{d}") < ACTIVE * F.col(f"r_{d}") for d in dims))
    dt = F.col("dt")
    aggs = [
        F.count("*").alias("frame_count"),
        F.sum("bad").alias("nonfinite"),
        F.avg(norm2([F.col(f"d_{d}") for d in dims])).alias("movement"),
        F.avg(still.cast("double")).alias("stall"),
        F.max("med").alias("med"),
        F.min("dt").alias("least"),
        F.max("dt").alias("most"),
        F.count("dt").alias("steps"),
        F.count_if(dt > GAP_FACTOR * F.col("med")).alias("over"),
        F.max(dt != 0).alias("some"),
        (F.count_if(~_finite(clock)) if clock else F.lit(0)).alias("bad_clock"),
        (F.max(widest) if widest else F.lit(None).cast("double")).alias("given"),
    ]
    for d in dims:
        norm = F.abs(f"d_{d}") / F.col(f"r_{d}")
        # A histogram of five bins has fewer only where there are fewer values.
        aggs += [F.size(F.histogram_numeric(d, F.lit(DISCRETE + 1))).alias(f"u_{d}"), _active(norm, F.count(norm)).alias(f"a_{d}"), F.stddev_pop(norm).alias(f"s_{d}"), F.avg(norm).alias(f"m_{d}")]
    g = t.groupBy(episode).agg(*aggs)
    structs = [
        F.struct(
            F.lit(d).alias("name"),
            F.col(f"a_{d}").alias("active"),
            (F.col(f"u_{d}") <= DISCRETE).alias("discrete"),
            F.lit(bool(re.search("grip", d.rsplit(".", 1)[-1], re.I))).alias("gripper"),
            F.col(f"s_{d}").alias("norm_delta_std"),
            F.col(f"m_{d}").alias("mean_abs_delta_norm"),
        )
        for d in dims
    ]
    ok = (F.col("nonfinite") == 0) & (F.col("frame_count") >= 2)
    g = g.withColumn("dims", F.when(ok, F.array(*structs)).otherwise(F.array().cast("array<struct<name:string,active:boolean,discrete:boolean,gripper:boolean,norm_delta_std:double,mean_abs_delta_norm:double>>")))
    g = g.withColumn("judged", F.expr("array_sort(transform(filter(dims, x -> x.active and not x.discrete and not x.gripper), x -> named_struct('s', x.norm_delta_std, 'n', x.name)))"))
    active = "transform(filter(dims, x -> x.active), x -> x.mean_abs_delta_norm)"
    g = g.withColumn("jerk", F.expr(f"coalesce(try_divide(aggregate({active}, 0D, (a, x) -> a + x), size({active})), 0D)"))
    timed = F.lit(clock is not None) & (F.col("frame_count") >= 2) & (F.col("bad_clock") == 0) & (F.col("nonfinite") == 0)
    back = timed & (F.col("least") < 0)
    flat = F.col("med") <= 0
    ratio = F.when(~timed | back, 0.0).when(flat, F.col("some").cast("double")).otherwise(F.col("over") / F.col("steps"))
    wide = F.col("given") > GAP_FACTOR * F.col("med")
    gapped = F.when(~timed, False).when(back, True).when(flat, F.col("some")).otherwise((F.col("over") > 0) | F.coalesce(wide, F.lit(False)))
    most = F.when(timed & ~back, F.coalesce("given", "most"))
    sigma = upper_median(F.col("judged"))["s"]
    worst = F.try_element_at("judged", F.lit(-1))
    seen = F.size("judged") > 0
    return g.select(
        episode,
        "frame_count",
        "nonfinite",
        F.when(ok, F.col("movement")).otherwise(0.0).alias("movement_score"),
        F.when(ok, F.col("jerk")).otherwise(0.0).alias("jerk_score"),
        F.when(ok, F.col("stall")).otherwise(0.0).alias("stall_ratio"),
        F.when(seen, band(sigma)).otherwise("unknown").alias("verdict"),
        F.when(seen, band(worst["s"])).otherwise("unknown").alias("worst_verdict"),
        worst["n"].alias("worst_dim"),
        F.size("judged").alias("judged_dims"),
        most.alias("max_gap_seconds"),
        ratio.alias("gap_ratio"),
        F.when(~ok, "unknown").when(gapped, "gapped").when(most.isNotNull(), "ok").otherwise("unknown").alias("integrity"),
        "dims",
    )


def motion_runs(frames: DataFrame, episode: str, order: list[str], dims: list[str], clock: str) -> DataFrame:
    """Per transition that is no gap: run number and the mean normalised change over the active dimensions.

    All is windows over one shuffle by episode; nothing is joined back.
    """
    t = transitions(frames, episode, order, dims, clock)
    whole = Window.partitionBy(episode)
    norm = {d: F.abs(f"d_{d}") / F.col(f"r_{d}") for d in dims}
    t = t.withColumns({f"a_{d}": F.count_if(norm[d] < ACTIVE).over(whole) < F.ceil(0.95 * F.count(norm[d]).over(whole)) for d in dims} | {"t0": F.min(clock).over(whole), "low": F.min("dt").over(whole)})
    live = reduce(lambda a, b: a + b, (F.col(f"a_{d}").cast("int") for d in dims))
    some = F.when(live > 0, live).otherwise(len(dims))
    score = reduce(lambda a, b: a + b, (F.when(F.col(f"a_{d}") | (live == 0), norm[d]).otherwise(0.0) for d in dims)) / some
    limit = GAP_FACTOR * F.col("med")
    cut = F.sum((F.col("dt") > limit).cast("int")).over(Window.partitionBy(episode).orderBy(*order))
    kept = t.withColumn("run", cut).where((F.col("med") > 0) & (F.col("low") >= 0) & (F.col("dt") <= limit))
    return kept.select(episode, "run", (F.col(clock) - F.col("t0")).alias("t"), score.alias("score"))
