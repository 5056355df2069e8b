"""Catalog analytics: counts, summaries, listings, lineage and the joins behind them, over any tables of the right columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.session import cut

#: Bins of a length histogram, outliers a measure, task strings of a listing, stall ratio of a flag.
BINS, OUTLIERS, TASKS, STALLED = 10, 5, 5000, 0.5


def _one(*parts: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(F.broadcast(b), "_one"), keyed).drop("_one")


# --- counts and summaries ---------------------------------------------------------------------------


def counts(df: DataFrame, by: str, known: list | None = None, name: str = "n") -> DataFrame:
    """(by, n): rows of each value; known values that have none count 0."""
    found = df.groupBy(by).agg(F.count("*").alias(name))
    if known is None:
        return found
    every = df.sparkSession.createDataFrame([(k,) for k in known], df.select(by).schema)
    return every.join(found, by, "left").select(by, F.coalesce(name, F.lit(0)).alias(name))


def summary(df: DataFrame, by: list[str], where: dict[str, Column] | None = None, distinct: dict[str, str] | None = None, measures: dict[str, Column] | None = None) -> DataFrame:
    """One row a group: n, counts under conditions, counts of distinct values, and any further aggregates, in one pass."""
    parts = [F.count("*").alias("n")]
    parts += [F.count_if(c).alias(k) for k, c in (where or {}).items()]
    parts += [F.count_distinct(c).alias(k) for k, c in (distinct or {}).items()]
    parts += [c.alias(k) for k, c in (measures or {}).items()]
    return df.groupBy(*by).agg(*parts)


def newest_per_key(df: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """The columns of each key's row with the largest order (a struct breaks ties)."""
    return df.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])


def ages(df: DataFrame, key: str, at: str, now: Column | None = None) -> DataFrame:
    """(key, age_us): microseconds since each key's newest row, 0 for one in the future; `now` defaults to the newest row of all."""
    newest = df.groupBy(key).agg(F.max(at).alias("at"))
    if now is None:
        newest, now = newest.join(F.broadcast(df.agg(F.max(at).alias("now")).withColumn("_", F.lit(True))), F.col("_")), F.col("now")
    return newest.select(key, F.greatest(F.lit(0).cast("long"), F.unix_micros(now) - F.unix_micros("at")).alias("age_us"))


def exploded_counts(df: DataFrame, array: str, name: str = "code") -> DataFrame:
    """(code, n): how often each element of an array column occurs."""
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, n): equal bins from the least to the largest value, with those that are empty; edges cut to whole numbers.

    Two passes over the column; one row of bounds goes to all tasks.
    """
    bounds = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).where("lo is not null")
    bounds = bounds.withColumn("width", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("hi") - F.col("lo")) / bins)).withColumn("_", F.lit(True))
    placed = df.where(F.col(column).isNotNull()).join(F.broadcast(bounds), F.col("_")).groupBy(F.least(F.floor((F.col(column) - F.col("lo")) / F.col("width")), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    edges = bounds.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), "lo", "width")
    edges = edges.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).cast("long").alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).cast("long").alias("high"))
    return edges.join(placed, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def length_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, std (of the sample; 0 for fewer than two), least and largest."""
    return df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std"), F.min(column).alias("low"), F.max(column).alias("high"))


def zscores(df: DataFrame, column: str, population: DataFrame | None = None, name: str = "z") -> DataFrame:
    """Adds the deviation of a column in standard deviations of a population (the rows themselves, or another table's column); 0 where it has none."""
    p = (df if population is None else population).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s")).withColumn("_", F.lit(True))
    z = F.when(F.coalesce("_s", F.lit(0.0)) == 0, 0.0).otherwise((F.col(column) - F.col("_m")) / F.col("_s"))
    return df.join(F.broadcast(p), F.col("_")).withColumn(name, z).drop("_m", "_s", "_")


def outliers(df: DataFrame, by: list[str], value: Column, tie: str, k: int = OUTLIERS) -> DataFrame:
    """The k rows of each group with the largest values, with their rank r; Spark keeps k rows a task and group."""
    w = Window.partitionBy(*by).orderBy(value.desc_nulls_last(), tie)
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def matrix(df: DataFrame, row: str, column: str, value: Column, columns: list) -> DataFrame:
    """One row a group with a column for each given value; null where it has none."""
    return df.groupBy(row).pivot(column, columns).agg(value)


def quality_summary(quality: DataFrame, episodes: DataFrame) -> dict[str, DataFrame]:
    """The report's tables: verdicts, integrity, length, histogram, sigmas (episode, dim, sigma) and outliers by jerk, stall and length.

    quality: episode_id, verdict, integrity, jerk_score, stall_ratio, dims. episodes: id, frame_count. Scored episodes are the population.
    """
    q = quality.select("episode_id", "jerk_score", "stall_ratio").join(episodes.select(F.col("id").alias("episode_id"), "frame_count"), "episode_id", "left")
    z = zscores(q, "frame_count")
    measures = {"jerk": F.col("jerk_score"), "stall": F.col("stall_ratio"), "length": F.abs("z")}
    long = reduce(DataFrame.unionByName, [z.select("episode_id", F.lit(k).alias("measure"), c.alias("value")) for k, c in measures.items()])
    return {
        "verdicts": counts(quality, "verdict"),
        "integrity": counts(quality, "integrity"),
        "length": length_summary(q, "frame_count"),
        "histogram": histogram(q, "frame_count"),
        "sigmas": quality.select("episode_id", F.explode("dims").alias("d")).select("episode_id", F.col("d.name").alias("dim"), F.col("d.norm_delta_std").alias("sigma")),
        "outliers": outliers(long, ["measure"], F.col("value"), "episode_id"),
    }


def job_report(produced: DataFrame, episodes: DataFrame, quality: DataFrame, validation: DataFrame) -> DataFrame:
    """One row a job: episodes by state and verdict, flags, mean scores of the scored ones, lengths and passed validations.

    produced: job_id, episode_id. validation: episode_id, passed (its latest run).
    """
    j = produced.join(episodes.select(F.col("id").alias("episode_id"), "state", "frame_count"), "episode_id", "left")
    j = j.join(quality.select("episode_id", "verdict", "movement_score", "jerk_score", "stall_ratio"), "episode_id", "left").join(validation.select("episode_id", "passed"), "episode_id", "left")
    return summary(
        j, ["job_id"],
        {**{s: F.col("state") == s for s in ("ingested", "valid", "quarantined")}, **{v: F.col("verdict") == v for v in ("smooth", "moderate", "jerky", "unknown")}, "stalled": F.col("stall_ratio") >= STALLED, "evaluated": F.col("passed").isNotNull(), "passed": F.col("passed")},
        measures={**{f"mean_{m}": F.avg(m) for m in ("movement_score", "jerk_score", "stall_ratio")}, "mean_frames": F.avg("frame_count"), "low_frames": F.min("frame_count"), "high_frames": F.max("frame_count")},
    )


def failure_summary(results: DataFrame, episodes: DataFrame) -> dict[str, DataFrame]:
    """totals (quarantined, evaluated), codes, and failures by profile and format.

    results: episode_id, profile_name, passed, reason_codes. episodes: id, state, format.
    """
    totals = _one(episodes.agg(F.count_if(F.col("state") == "quarantined").alias("quarantined")), results.agg(F.count_distinct("episode_id").alias("evaluated")))
    failed = results.where("not passed")
    formats = failed.join(episodes.select(F.col("id").alias("episode_id"), "format"), "episode_id")
    return {"totals": totals, "codes": exploded_counts(failed, "reason_codes"), "by_profile": counts(failed, "profile_name"), "by_format": counts(formats, "format")}


def drop_reasons(df: DataFrame, checks: list[tuple[str, Column]], rest: str = "unscored") -> DataFrame:
    """(reason, n) of the rows that fail: the first check that is not true names the reason. Rows on which the whole is null are in neither."""
    match = reduce(lambda a, b: a & b, [c for _, c in checks])
    why = reduce(lambda a, x: a.when(~F.coalesce(x[1], F.lit(True)), x[0]), checks[1:], F.when(~F.coalesce(checks[0][1], F.lit(False)), checks[0][0]))
    return df.where(~match).groupBy(why.otherwise(rest).alias("reason")).agg(F.count("*").alias("n"))


def task_strings(episodes: DataFrame, limit: int = TASKS) -> DataFrame:
    """(task, episodes) of the strings that are not blank, most episodes first."""
    n = episodes.where("trim(coalesce(task, '')) <> ''").groupBy("task").agg(F.count("*").alias("episodes"))
    return n.orderBy(F.col("episodes").desc(), "task").limit(limit)


def value_statistics(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, nonfinite, low, high, mean, std): statistics of the finite values of each channel, std of the population, in one pass."""
    v = F.col(value)
    fine = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(fine.isNull()).alias("nonfinite"), F.min(fine).alias("low"), F.max(fine).alias("high"), F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("std"))


def published_or_computed(published: DataFrame, computed: DataFrame, by: str) -> DataFrame:
    """Statistics that a dataset publishes, and computed ones for the channels (or fields) that it leaves out."""
    names = [c for c in computed.columns if c != by]
    p = published.select(by, *[F.col(c).alias(f"_{c}") for c in names if c in published.columns])
    return computed.join(p, by, "full").select(by, *[F.coalesce(f"_{c}", c).alias(c) if c in published.columns else F.col(c) for c in names])


def members(df: DataFrame, key: str, id_: str) -> DataFrame:
    """(key, ids): the sorted identifiers of each key's rows."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(id_)).alias("ids"))


def widest_gap(df: DataFrame, key: str, at: Column, order: list[str], id_: str) -> DataFrame:
    """(key, gap, id): the largest step between successive stamps and the row at its end, the first of equals; null stamps are skipped."""
    t = df.withColumn("_at", at).where("_at is not null")
    t = t.withColumn("_gap", F.col("_at") - F.lag("_at").over(Window.partitionBy(key).orderBy("_at", *order)))
    return t.groupBy(key).agg(F.max("_gap").alias("gap"), F.max_by(id_, F.struct(F.col("_gap"), -F.col("_at"))).alias(id_))


def contract_counts(contracts: DataFrame, produced: DataFrame, episodes: DataFrame) -> DataFrame:
    """Adds produced and valid: the episodes that each contract's job made, and those in state valid."""
    n = produced.join(episodes.select(F.col("id").alias("episode_id"), "state"), "episode_id").groupBy("job_id").agg(F.count("*").alias("produced"), F.count_if(F.col("state") == "valid").alias("valid"))
    return contracts.join(n, "job_id", "left").fillna(0, ["produced", "valid"])


# --- listings and filters ------------------------------------------------------------------------------


def json_fields(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds fields of a JSON column: name -> (path, type); null where the path is missing or has another type."""
    return df.withColumns({n: F.get_json_object(column, path).try_cast(kind) for n, (path, kind) in fields.items()})


def with_element(df: DataFrame, array: str, value) -> DataFrame:
    """The rows whose array holds a value."""
    return df.where(F.coalesce(F.array_contains(array, value), F.lit(False)))


def since(df: DataFrame, at: str, seconds: int | None = None, start: Column | None = None) -> DataFrame:
    """The rows from a time on; `seconds` counts back from the newest row. Rows without a stamp go."""
    if start is not None:
        return df.where(F.col(at) >= start)
    newest = df.agg(F.max(at).alias("_newest")).withColumn("_", F.lit(True))
    return df.join(F.broadcast(newest), F.col("_")).where(F.unix_micros(at) >= F.unix_micros("_newest") - seconds * 1_000_000).drop("_newest", "_")


def capped(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, bool]:
    """The first rows, and whether there were more."""
    found = cut(df.orderBy(*order).limit(limit + 1))
    return found.orderBy(*order).limit(limit), found.count() > limit


def without(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """The rows that another table has no row for."""
    return df.join(other.select(*on).distinct(), on, "left_anti")


def within(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """The rows that another table has a row for."""
    return df.join(other.select(*on), on, "left_semi")


def content_duplicates(df: DataFrame, content: str, id_: str) -> DataFrame:
    """(content_hash, n, keep_id) of contents that occur more than once."""
    return df.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min(id_).alias("keep_id")).where("n > 1")


# --- lineage ---------------------------------------------------------------------------------------------


def produced_by(edges: DataFrame, job_type: str = "job", kind: str = "episode") -> DataFrame:
    """(job_id, episode_id) of the edges that say what made what."""
    hit = (F.col("from_type") == kind) & (F.col("to_type") == job_type) & (F.col("relation") == "produced_by")
    return edges.where(hit).select(F.col("to_ref").alias("job_id"), F.col("from_ref").alias("episode_id"))


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(kind, ref, depth): all nodes that the start nodes (kind, ref) lead to, each once with its least depth.

    edges: from_type, from_ref, to_type, to_ref, with typed references. One join a level, of the last level's nodes with
    the edges; nodes seen before are left out, so that cycles end. Beyond max_depth an error says that more is there.
    """
    frontier = cut(start.select("kind", "ref").distinct().withColumn("depth", F.lit(0)))
    levels, seen, depth = [frontier], frontier, 0
    while True:
        step = frontier.join(edges, (F.col("kind") == F.col("from_type")) & (F.col("ref") == F.col("from_ref")))
        step = step.select(F.col("to_type").alias("kind"), F.col("to_ref").alias("ref")).distinct()
        frontier = cut(step.join(seen.select("kind", "ref"), ["kind", "ref"], "left_anti").withColumn("depth", F.lit(depth + 1)))
        if frontier.isEmpty():
            return seen
        depth += 1
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"there are nodes beyond depth {max_depth}")
        levels.append(frontier)
        seen = reduce(DataFrame.unionByName, levels)


def orphan_blobs(blobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The blobs whose hash no artifact names."""
    return blobs.join(artifacts.select("hash").distinct(), "hash", "left_anti")


def coverage_cells(catalog: DataFrame, in_build: str, axes: list[str]) -> DataFrame:
    """Counts in the build and the catalog of every combination of the axes, and of all their subsets (null: any value)."""
    named = catalog.select(F.col(in_build).alias("inside"), *[F.coalesce(F.nullif(F.trim(F.col(a).cast("string")), F.lit("")), F.lit("(none)")).alias(a) for a in axes])
    return named.cube(*axes).agg(F.count_if("inside").alias("build_count"), F.count("*").alias("catalog_count"))


def distance_profile(df: DataFrame, by: str, vector: str, id_: str) -> DataFrame:
    """(by, n, within): the mean inner product of the pairs of each group, from sums of coordinates: no pair is made."""
    u = df.select(id_, by, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    s = u.groupBy(by, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    g = s.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("w"), F.sum("q").alias("q"))
    return g.select(by, "n", F.try_divide(F.col("w") - F.col("q"), F.col("n") * (F.col("n") - 1)).alias("within"))
