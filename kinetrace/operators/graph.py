"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that each node of an edge is connected with.

    Each round joins every edge with the smallest neighbour of its end, so a hub costs one row for each
    of its edges, and nothing is collected. A round's edges are written to the shared checkpoint folder.
    Self loops keep their node; null ends are dropped. An empty table gives an empty one. Edges that have not settled
    after `rounds` rounds raise an error; rounds grow with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null")
    e = cut(e.distinct())
    loops = e.where("u = v").select("u")
    e = e.where("u <> v")
    last, settled = None, False
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            settled = True
            break
        last = now
    if not settled:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return ends.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
