"""Telemetry logs, synthetic episodes and keyed upserts of catalog tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "name string, value double, unit string, labels map<string,string>, timestamp string, source string, correlation_id string"
#: Labels that name single things and may not be on a metric.
SINGULAR = ("job_id", "episode_id", "correlation_id")


def metric_records(spark: SparkSession, path: str) -> DataFrame:
    """The metric lines of a JSON log. Blank, corrupt and other lines are skipped; stamps without a zone are UTC."""
    found = spark.read.text(path).select(F.from_json("value", RECORD).alias("r")).where("r.name is not null and r.value is not null")
    return found.select("r.*").withColumn("ts", F.try_to_timestamp("timestamp"))


def newest(records: DataFrame, n: int) -> DataFrame:
    """The newest n records; Spark keeps n rows a task, so no full sort takes place."""
    return records.orderBy(F.col("ts").desc()).limit(n)


def refused(name: Column, labels: Column) -> Column:
    """Whether a metric may not be written: its name has capitals, or a label names a single thing."""
    return (name != F.lower(name)) | reduce(lambda a, b: a | b, [F.coalesce(F.map_contains_key(labels, k), F.lit(False)) for k in SINGULAR])


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table and the new rows of keys it lacks, of each the first by `order`; known rows stay as they are."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return table.unionByName(first.join(table.select(*keys).distinct(), keys, "left_anti").select(*table.columns))


def replace_latest(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table with the newest row of each key; on equal order the new row holds."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*table.columns)


def validation_states(runs: DataFrame, order: str = "seq") -> DataFrame:
    """(episode_id, state): valid or quarantined by each episode's latest run."""
    return runs.groupBy("episode_id").agg(F.when(F.max_by("passed", order), "valid").otherwise("quarantined").alias("state"))


def profile_conflicts(profiles: DataFrame) -> DataFrame:
    """(name, version) that were registered with different hashes."""
    return profiles.groupBy("name", "version").agg(F.count_distinct("profile_hash").alias("hashes")).where("hashes > 1").select("name", "version")


def episode_problems(episodes: DataFrame) -> DataFrame:
    """Adds `problem` to synthetic episodes (timestamps, observations, actions); null where one is sound."""
    even = "forall({0}, x -> x is not null and size(x) = size({0}[0]))"
    problem = (
        F.when(F.expr("coalesce(size(timestamps), 0) < 1"), "empty")
        .when(F.expr("not (size(timestamps) <=> size(observations) and size(timestamps) <=> size(actions))"), "lengths differ")
        .when(F.expr(f"not ({even.format('observations')} and {even.format('actions')})"), "widths differ")
        .when(F.expr("exists(sequence(1, size(timestamps)), i -> i < size(timestamps) and timestamps[i] < timestamps[i - 1])"), "time runs back")
    )
    return episodes.withColumn("problem", problem)


def episode_frames(episodes: DataFrame, *keep: str) -> DataFrame:
    """One row for each frame of synthetic episodes: the kept columns, frame, timestamp, observation and action."""
    zipped = episodes.select(*keep, F.posexplode(F.arrays_zip("timestamps", "observations", "actions")).alias("frame", "f"))
    return zipped.select(*keep, "frame", F.col("f.timestamps").alias("timestamp"), F.col("f.observations").alias("observation"), F.col("f.actions").alias("action"))


def register_validations(results: DataFrame, new: DataFrame, episodes: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(results with one row an episode and profile, episodes with the state that their latest run says)."""
    kept = replace_latest(results, new, ["episode_id", "profile_hash"], order)
    states = validation_states(kept, order).withColumnRenamed("state", "_state")
    told = episodes.join(states, episodes["id"] == states["episode_id"], "left").withColumn("state", F.coalesce("_state", "state")).select(*episodes.columns)
    return kept, told


def register_profiles(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """The profiles with new ones; a name and version that has another hash is an error."""
    both = profiles.unionByName(new.select(profiles.columns)).dropDuplicates(["name", "version", "profile_hash"])
    clash = profile_conflicts(both).limit(1).collect()
    if clash:
        raise ValueError(f"profile {clash[0].name} {clash[0].version} is registered with another hash")
    return both


def upsert_arrays(table: DataFrame, arrays: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """A batch that comes as parallel arrays, one row of arrays a batch, put into a table by key."""
    rows = arrays.select(F.explode(F.arrays_zip(*columns)).alias("x")).select("x.*")
    return replace_latest(table, rows.select(*table.columns), keys, order)


def harvest_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(task): the distinct task strings of the Parquet, JSON-lines and CSV files at a path; numbers and strings of up to 3 characters go."""
    found = []
    for kind, glob, names in (("parquet", "*.parquet", ("__index_level_0__", "task")), ("json", "*.jsonl", ("task",)), ("csv", "*.csv", ("task",))):
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        try:
            df = reader.csv(path, header=True) if kind == "csv" else reader.json(path) if kind == "json" else reader.parquet(path)
        except AnalysisException:
            continue
        column = next((n for n in names if n in df.columns), None)
        if column:
            found.append(df.select(F.trim(F.col(f"`{column}`").cast("string")).alias("task")))
    if not found:
        return spark.createDataFrame([], "task string")
    every = reduce(DataFrame.unionByName, found)
    return every.where((F.length("task") > 3) & ~F.col("task").rlike("^[0-9]+$")).distinct()


def introspect(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """(table, ordinal, column, type, nullable, is_key, n_rows) of tables, from their schemas and one count each."""
    rows = []
    for name, df in tables.items():
        n = df.count()
        rows += [(name, i, f.name, f.dataType.simpleString(), f.nullable, f.name in (keys or {}).get(name, []), n) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table string, ordinal int, column string, type string, nullable boolean, is_key boolean, n_rows long")


def benchmark_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, commit, p50, p95, samples) of benchmark results kept as JSON documents, one a file; unreadable ones are left out."""
    shape = "name string, benchmark string, commit string, git_commit string, summary struct<p50:double,p95:double,count:long>, samples array<double>"
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", shape).alias("r"))
    sorted_ = F.array_sort("r.samples")

    def rank(q: float) -> Column:
        return F.try_element_at(sorted_, F.greatest(F.lit(1), F.ceil(F.size("r.samples") * q)).cast("int"))

    return docs.where("r is not null and (r.summary is not null or size(r.samples) > 0)").select(
        "file", F.coalesce("r.name", "r.benchmark").alias("name"), F.coalesce("r.commit", "r.git_commit").alias("commit"),
        F.coalesce("r.summary.p50", rank(0.5)).alias("p50"), F.coalesce("r.summary.p95", rank(0.95)).alias("p95"), F.coalesce("r.summary.count", F.size("r.samples")).cast("long").alias("samples"),
    )
