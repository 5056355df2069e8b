"""Proposals: task strings grouped by their cores, and the numbers that say how far to trust the groups.

Strings come in as distinct task strings with episode counts. Cores are found with native expressions; the online
clustering of the distinct cores depends on their order and is one task, bounded by the number of clusters times the number of
distinct cores. Everything after it is aggregates and joins again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from kinetrace.functions import tasks

RADIUS, MARGIN = 0.30, 0.05


@F.pandas_udf(StringType())
def proposal_key(core: pd.Series) -> pd.Series:
    """The key of a proposal, from its primary core."""
    return core.map(lambda c: hashlib.blake2b(c.encode(), digest_size=8).hexdigest())


@F.pandas_udf(ArrayType(DoubleType()))
def token_vectors(core: pd.Series) -> pd.Series:
    return core.map(lambda c: tasks.token_vector(c).tolist())


def extracted(strings: DataFrame, ignore_verb: bool = True, ignore_colour: bool = True, ignore_site: bool = False) -> DataFrame:
    """Adds verb, colours, core and usable to (task, episodes)."""
    s = strings.withColumn("_w", tasks.tokens("task")).withColumn("verb", tasks.leading_verb(F.col("_w")))
    s = s.withColumn("colours", F.filter("_w", lambda w: w.isin(list(tasks.COLOURS))))
    s = s.withColumn("core", tasks.core(F.col("_w"), F.col("verb"), ignore_verb, ignore_colour, ignore_site))
    return s.withColumn("usable", F.col("core") != "").drop("_w")


def clustered_cores(found: DataFrame, radius: float = RADIUS, rule: str = "mean", most: int = 512) -> DataFrame:
    """(core, cluster, distance, centroid): the distinct cores after one observation for each task string, in order of the strings."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, at = tasks.Centroids(radius, most, rule), {}
        for core in pdf.sort_values("task")["core"]:
            at[core] = model.add(tasks.token_vector(core))[0]
        rows = [(c, k, 1 - tasks.cosine(model.points[k], tasks.token_vector(c)), model.points[k].tolist()) for c, k in at.items()]
        return pd.DataFrame(rows, columns=["core", "cluster", "distance", "centroid"])

    return found.where("usable").select("task", "core").groupBy().applyInPandas(run, "core string, cluster long, distance double, centroid array<double>")


def proposals(found: DataFrame, cores: DataFrame, radius: float = RADIUS) -> dict[str, DataFrame]:
    """proposals (cluster, key, core, merged_cores, size, episodes, is_merge, centroid, radius) and members (key, task, core, episodes, verb, colours, distance).

    The core with the most episodes names a proposal; of equals the first one.
    """
    members = found.where("usable").join(cores.select("core", "cluster", "distance"), "core")
    weight = members.groupBy("cluster", "core").agg(F.sum("episodes").alias("w"), F.min("task").alias("first"))
    best = weight.groupBy("cluster").agg(F.min_by("core", F.struct(-F.col("w"), F.col("first"))).alias("core"), F.array_sort(F.collect_list("core")).alias("merged_cores"))
    size = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("episodes").alias("episodes"))
    centroid = cores.groupBy("cluster").agg(F.first("centroid").alias("centroid"))
    p = best.join(size, "cluster").join(centroid, "cluster").withColumn("key", proposal_key("core")).withColumns({"is_merge": F.size("merged_cores") > 1, "radius": F.lit(radius)})
    return {"proposals": p, "members": members.join(p.select("cluster", "key"), "cluster").drop("cluster", "usable")}


def health(found: DataFrame, made: DataFrame) -> DataFrame:
    """One row: tasks, episodes, clusters, singletons, merges, dominance, distinct cores, and the shares with a verb and of one token."""
    usable = F.col("usable")
    tokens = F.size(F.split("core", " "))
    a = found.agg(
        F.count("*").alias("tasks"), F.coalesce(F.sum("episodes"), F.lit(0)).alias("episodes"), F.count_distinct(F.when(usable, F.col("core"))).alias("distinct_cores"),
        F.coalesce(F.avg((F.col("verb") != "").cast("double")), F.lit(0.0)).alias("verb_rate"), F.coalesce(F.avg(F.when(usable, (tokens == 1).cast("double"))), F.lit(0.0)).alias("single_token_rate"),
    )
    b = made.agg(F.count("*").alias("clusters"), F.count_if(F.col("size") == 1).alias("singletons"), F.count_if("is_merge").alias("merges"), F.coalesce(F.try_divide(F.max("size"), F.sum("size")), F.lit(0.0)).alias("dominance"))
    return a.withColumn("_", F.lit(1)).join(b.withColumn("_", F.lit(1)), "_").drop("_")


def review_candidates(members: DataFrame, made: DataFrame, decided: DataFrame, margin: float = MARGIN, limit: int = 50) -> DataFrame:
    """(task, core, key, proposal_core, episodes, distance, reason): members alone in their proposal, or near its border, undecided yet.

    decided: task. Those without neighbours come first, then the farthest.
    """
    p = made.select("key", F.col("core").alias("proposal_core"), "size", "radius", "centroid")
    m = members.select("task", "core", "key", "episodes").join(decided.select("task"), "task", "left_anti").join(p, "key").withColumn("_v", token_vectors("core"))
    dot = F.aggregate(F.zip_with("centroid", "_v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x))
    m = m.withColumn("distance", F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(dot, norm), F.lit(0.0))))
    reason = F.when(F.col("size") == 1, "no supporting neighbors").when(F.col("distance") >= F.greatest(F.lit(0.0), F.col("radius") - margin), "near cluster boundary")
    m = m.withColumn("reason", reason).where("reason is not null")
    return m.orderBy((F.col("size") != 1).cast("int"), F.col("distance").desc(), "task").select("task", "core", "key", "proposal_core", "episodes", "distance", "reason").limit(limit)


def layout(made: DataFrame, most: int = 200) -> DataFrame:
    """(key, x, y, explained): the largest proposals' centroids in the plane; one task of at most `most` points."""
    from kinetrace.functions.layout import plane

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "core"], ascending=[False, True])
        at, explained = plane(np.stack(pdf["centroid"].map(np.asarray)))
        return pd.DataFrame({"key": pdf["key"], "x": at[:, 0], "y": at[:, 1], "explained": explained})

    return made.orderBy(F.col("size").desc(), "core").limit(most).select("key", "core", "size", "centroid").groupBy().applyInPandas(run, "key string, x double, y double, explained double")
