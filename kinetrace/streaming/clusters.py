"""Live clustering sessions: points are assigned as they come, and the centroids stay in the stream's state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinetrace.functions.tasks import Centroids

OUT = "session string, id string, position long, cluster long, distance double, into_frozen boolean"
STATE = "points array<array<double>>, sizes array<int>, counts array<int>, frozen array<int>"


def live_clusters(points: DataFrame, radius: float = 0.3, most: int = 512, confirm_at: int | None = None, confirm_top: int = 0) -> DataFrame:
    """The cluster of each point of a stream (session, id, position, vector), in order of position within a batch.

    A session's centroids move by the mean of their points. Once `confirm_at` points of a session are in, its `confirm_top`
    largest clusters are confirmed: they take points and stay where they are. State is at most `most` centroids a session.
    """
    def assign(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = Centroids(radius, most)
        if state.exists:
            centres, sizes, counts, frozen = state.get
            for i, c in enumerate(centres):
                model.points.append(np.array(c, float))
                model.joined.append([])
                model._place(i)
            model.sizes, model.frozen = list(sizes), set(frozen)
            model.counts = {i: n for i, n in enumerate(counts) if n}
        rows, out = pd.concat(list(parts)).sort_values(["position", "id"]), []
        for r in rows.itertuples():
            cluster, distance, _ = model.add(np.asarray(r.vector, float))
            out.append((key[0], r.id, r.position, cluster, distance, cluster in model.frozen))
            if confirm_at is not None and not model.frozen and sum(model.sizes) >= confirm_at:
                model.frozen = set(sorted(range(len(model.sizes)), key=lambda i: -model.sizes[i])[:confirm_top])
        state.update(([p.tolist() for p in model.points], list(model.sizes), [model.counts.get(i, 0) for i in range(len(model.points))], sorted(model.frozen)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    return points.groupBy("session").applyInPandasWithState(assign, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def final_labels(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """(id, cluster): the nearest of final centroids for each point, by the cosine; one row a centroid goes with the plan."""
    from pyspark.sql import functions as F

    from kinetrace.operators.evaluation import inner

    units = [(np.array(c) / (np.linalg.norm(c) or 1.0)).tolist() for c in centroids]
    near = F.array(*[F.struct((-inner("vector", F.array(*map(F.lit, u)))).alias("d"), F.lit(i).alias("i")) for i, u in enumerate(units)])
    return points.select("id", F.array_min(near)["i"].cast("long").alias("cluster"))
