"""Behavioural fingerprints of episodes and their near-duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from kinetrace.functions.motion import distance, shape, thin
from kinetrace.operators.quality import episode_quality, motion_runs

#: Order of verdicts, likeness threshold, most episodes of one report.
RANKS = {"smooth": 0, "moderate": 1, "jerky": 2}
THRESHOLD, MOST = 0.04, 500


@F.pandas_udf(ArrayType(DoubleType()))
def shape_of(points: pd.Series) -> pd.Series:
    """Arrays of (run, t, score) as thinned, resampled shapes."""

    def one(rows):
        if rows is None or not len(rows):
            return []
        run, t, v = (np.array([r[k] for r in rows]) for k in ("run", "t", "score"))
        order = np.lexsort((t, run))
        run, t, v = run[order], t[order], v[order]
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        sizes = np.diff(np.append(starts, len(run))).tolist()
        keep = np.concatenate([starts[i] + at for i, at in thin(sizes).items()])
        return shape(t[keep], v[keep]).tolist()

    return points.map(one)


def fingerprints(frames: DataFrame, episode: str, order: list[str], dims: list[str], clock: str) -> DataFrame:
    """episode, verdict, judged_dims, stall_ratio, gap_ratio, shape and dynamics (name -> std, mean)."""
    q = episode_quality(frames, episode, order, dims, clock)
    points = motion_runs(frames, episode, order, dims, clock).groupBy(episode).agg(F.collect_list(F.struct("run", "t", "score")).alias("points"))
    moving = "map_from_entries(transform(filter(dims, x -> x.active and not x.discrete), x -> struct(x.name, struct(x.norm_delta_std as std, x.mean_abs_delta_norm as mean))))"
    out = q.join(points, episode, "left").withColumn("shape", shape_of("points")).withColumn("dynamics", F.expr(moving))
    return out.select(F.col(episode).cast("string").alias("episode"), "verdict", "judged_dims", "stall_ratio", "gap_ratio", "shape", "dynamics")


def redundancy(prints: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """episode, representative, distance, reason and truncated, for each of the first `most` episodes in order of rank.

    In order of rank each episode joins the nearest representative within the threshold or becomes one. The
    order decides, so one task compares; its input is bounded by `most`, which is the report's contract, and `truncated`
    says on each row whether there were more episodes than that.
    """

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            rows.append({"id": r.episode, "stall": r.stall_ratio, "gap": r.gap_ratio, "shape": list(r.shape), "dynamics": {k: (v["std"], v["mean"]) for k, v in dict(r.dynamics).items()}, "rank": (RANKS.get(r.verdict, 3), r.stall_ratio, -r.judged_dims, r.episode)})
        kept, out = [], []
        for row in sorted(rows, key=lambda r: r["rank"]):
            if not row["shape"] and not row["dynamics"]:
                out.append((row["id"], None, None, "incomparable"))
                continue
            found = [(d[0], i, d[1]) for i, k in enumerate(kept) if (d := distance(row, k)) and d[0] <= threshold]
            if found:
                score, i, why = min(found)
                out.append((row["id"], kept[i]["id"], score, why))
            else:
                kept.append(row)
                out.append((row["id"], row["id"], 0.0, "representative"))
        return pd.DataFrame(out, columns=["episode", "representative", "distance", "reason"])

    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("verdict")), F.lit(3))
    first = prints.orderBy(rank, "stall_ratio", F.col("judged_dims").desc(), "episode").limit(most)
    more = prints.limit(most + 1).agg((F.count("*") > most).alias("truncated")).withColumn("_", F.lit(1))
    found = first.groupBy().applyInPandas(lead, "episode string, representative string, distance double, reason string")
    return found.withColumn("_", F.lit(1)).join(F.broadcast(more), "_").drop("_")


def redundancy_groups(report: DataFrame) -> DataFrame:
    """(representative, members, n, farthest): the groups of more than one episode, largest first in a listing."""
    near = report.where("representative is not null")
    g = near.groupBy("representative").agg(F.array_sort(F.collect_list("episode")).alias("members"), F.count("*").alias("n"), F.max("distance").alias("farthest"))
    return g.where("n > 1")
