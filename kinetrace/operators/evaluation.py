"""Offline evaluation of clusterings, embeddings and fingerprints, over tables of labels, pairs and points.

Measures over labels are aggregates. What depends on an order, or solves a small dense system, runs as one numpy task a
parameter set; such inputs are evaluation sets, and each function says what bounds them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions import tasks
from kinetrace.operators.graph import components

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


def _cells(df: DataFrame, label: str, cluster: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


# --- partitions -------------------------------------------------------------------------------------------


def rand_scores(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """One row: adjusted Rand index (0 where undefined), and precision, recall and F1 over all pairs; from cell counts, without pairs."""
    c = _cells(df, label, cluster)

    def pairs(cells: DataFrame, name: str) -> DataFrame:
        return cells.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias(name)).withColumn("_", F.lit(1))

    p, q = (c.groupBy(k).agg(F.sum("n").alias("n")) for k in ("label", "cluster"))
    s = pairs(c, "i").join(pairs(p, "p"), "_").join(pairs(q, "q"), "_").join(c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m")).withColumn("_", F.lit(1)), "_")
    s = s.withColumn("t", F.col("m") * (F.col("m") - 1) / 2).withColumn("x", F.coalesce(F.try_divide(F.col("p") * F.col("q"), "t"), F.lit(0.0)))

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0))

    return s.select(share("i - x", "(p + q) / 2 - x").alias("ari"), share("i", "q").alias("pair_precision"), share("i", "p").alias("pair_recall"), share("2 * i", "p + q").alias("pair_f1"))


def b_cubed(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """One row: the mean of the items' F1 between their cluster and their label."""
    c = _cells(df, label, cluster)
    c = c.withColumn("a", F.sum("n").over(Window.partitionBy("label"))).withColumn("b", F.sum("n").over(Window.partitionBy("cluster")))
    return c.agg((F.sum(F.expr("n * 2 * (n / b) * (n / a) / (n / b + n / a)")) / F.sum("n")).alias("b_cubed"))


def fragmentation(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """(label, clusters, largest, modal_share, intact): over how many clusters each label spreads."""
    return _cells(df, label, cluster).groupBy("label").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("modal_share"), (F.count("*") == 1).alias("intact"))


def impure_clusters(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """(cluster, labels, share): the clusters with several labels, and the share of their most common one."""
    return _cells(df, label, cluster).groupBy("cluster").agg(F.count("*").alias("labels"), (F.max("n") / F.sum("n")).alias("share")).where("labels > 1")


def attribute_shares(df: DataFrame, cluster: str, attribute: str) -> DataFrame:
    """(cluster, label, share): of each cluster's items, how many have each value of an attribute."""
    return _cells(df, attribute, cluster).select("cluster", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))).alias("share"))


def subset_quality(df: DataFrame, label: str, cluster: str, where: Column) -> DataFrame:
    """One row: items, B-cubed, mean clusters a label and impure clusters, of the rows that a condition selects."""
    part = df.where(where)
    parts = [part.agg(F.count("*").alias("items")), b_cubed(part, label, cluster), fragmentation(part, label, cluster).agg(F.avg("clusters").alias("fragmentation")), impure_clusters(part, label, cluster).agg(F.count("*").alias("impure"))]
    return reduce(lambda a, b: a.join(b, "_"), [p.withColumn("_", F.lit(1)) for p in parts]).drop("_")


def gold_scores(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: rates of over- and under-merging, precision, recall, F1, scored, ambiguous and unassigned, of decided pairs.

    labels: item, cluster. pairs: a, b, same (null is undecided). Two items without a cluster count as together.
    """
    a, b = (labels.select(F.col("item").alias(k), F.col("cluster").alias(f"c{k}")) for k in "ab")
    p = pairs.join(a, "a", "left").join(b, "b", "left").withColumn("together", F.col("ca").eqNullSafe(F.col("cb")))
    one = p.agg(
        F.count_if("same").alias("pos"), F.count_if(~F.col("same")).alias("neg"), F.count_if(F.col("same").isNull()).alias("ambiguous_pairs"),
        F.count_if(F.col("same") & F.col("together")).alias("tp"), F.count_if(~F.col("same") & F.col("together")).alias("fp"),
    ).withColumn("_", F.lit(1))
    named = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    lost = named.join(labels, "item", "left_anti").agg(F.count("*").alias("unassigned")).withColumn("_", F.lit(1))

    def rate(x: str, y: str) -> Column:
        return F.coalesce(F.try_divide(F.expr(x), F.expr(y)), F.lit(0.0))

    return one.join(lost, "_").select(
        rate("fp", "neg").alias("over_merge_rate"), rate("pos - tp", "pos").alias("under_merge_rate"), rate("tp", "tp + fp").alias("pair_precision"), rate("tp", "pos").alias("pair_recall"),
        rate("2 * tp", "pos + tp + fp").alias("pair_f1"), F.expr("pos + neg").alias("scored_pairs"), "ambiguous_pairs", "unassigned",
    )


# --- pairs and distances ----------------------------------------------------------------------------------


def inner(a: str | Column, b: str | Column) -> Column:
    """The inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pair_distances(pairs: DataFrame, points: DataFrame, id_: str = "id", vector: str = "vector") -> DataFrame:
    """Adds 1 minus the inner product to stated pairs (a, b) of points."""
    a, b = (points.select(F.col(id_).alias(k), F.col(vector).alias(f"v{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").withColumn("distance", 1.0 - inner("va", "vb")).drop("va", "vb")


def axis_pairs(items: DataFrame, axes: list[str], axis: str, id_: str = "id") -> DataFrame:
    """(a, b, same_label): the pairs that differ in one axis alone and share the label, or share all axes and differ in the label.

    An equi-join on the other axes: items that share them all are an evaluation corpus's few variants.
    """
    others = [x for x in axes if x != axis]
    a, b = (items.select(F.col(id_).alias(k), F.col("label").alias(f"l{k}"), F.col(axis).alias(f"x{k}"), *others) for k in "ab")
    p = a.join(b, others).where("a < b and ((xa = xb and la <> lb) or (xa <> xb and la = lb))")
    return p.select("a", "b", (F.col("la") == F.col("lb")).alias("same_label"))


def axis_report(items: DataFrame, points: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, pairs and mean distances of the same and of different labels, margin, separable)."""
    found = [pair_distances(axis_pairs(items, axes, x), points).select(F.lit(x).alias("axis"), "same_label", "distance") for x in axes]
    g = reduce(DataFrame.unionByName, found).groupBy("axis").agg(
        F.count_if("same_label").alias("same_pairs"), F.count_if(~F.col("same_label")).alias("different_pairs"),
        F.avg(F.when(F.col("same_label"), F.col("distance"))).alias("same_mean"), F.avg(F.when(~F.col("same_label"), F.col("distance"))).alias("different_mean"),
    )
    return g.where("same_pairs > 0 and different_pairs > 0").withColumn("margin", F.col("different_mean") - F.col("same_mean")).withColumn("separable", F.col("margin") > 0)


def geometry(distances: DataFrame, radius: float) -> DataFrame:
    """One row from (same, distance): means, the 90th and 10th linear percentiles, shares within the radius and their precision."""
    d = F.col("distance")
    g = distances.agg(
        F.avg(F.when(F.col("same"), d)).alias("same_mean"), F.avg(F.when(~F.col("same"), d)).alias("different_mean"),
        F.expr("percentile(if(same, distance, null), 0.9)").alias("same_p90"), F.expr("percentile(if(same, null, distance), 0.1)").alias("different_p10"),
        F.avg(F.when(F.col("same"), (d <= radius).cast("double"))).alias("same_within"), F.avg(F.when(~F.col("same"), (d <= radius).cast("double"))).alias("different_within"),
    )
    return g.withColumn("precision", F.coalesce(F.try_divide("same_within", F.col("same_within") + F.col("different_within")), F.lit(0.0)))


def separability(scores: DataFrame, by: str) -> DataFrame:
    """(by, threshold, accuracy, false_merges, false_splits, clean): the best cut of (by, same, score), larger being closer.

    Every score is a candidate; counts at and above it are running sums over the distinct scores of a group.
    """
    n = scores.groupBy(by, "score").agg(F.count_if("same").alias("p"), F.count_if(~F.col("same")).alias("q"))
    up, whole = Window.partitionBy(by).orderBy(F.col("score").desc()), Window.partitionBy(by)
    t = n.select(by, "score", F.sum("p").over(up).alias("tp"), F.sum("q").over(up).alias("fp"), F.sum("p").over(whole).alias("pos"), F.sum("q").over(whole).alias("neg"), F.min(F.when(F.col("p") > 0, F.col("score"))).over(whole).alias("pmin"), F.max(F.when(F.col("q") > 0, F.col("score"))).over(whole).alias("qmax"))
    t = t.where("pos > 0 and neg > 0").withColumn("accuracy", (F.col("tp") / F.col("pos") + (F.col("neg") - F.col("fp")) / F.col("neg")) / 2)
    best = t.groupBy(by).agg(F.max_by(F.struct("score", "accuracy", "tp", "fp", "pos", "pmin", "qmax"), F.struct("accuracy", -F.col("score"))).alias("x"))
    return best.select(by, F.col("x.score").alias("threshold"), "x.accuracy", F.col("x.fp").alias("false_merges"), (F.col("x.pos") - F.col("x.tp")).alias("false_splits"), F.when(F.col("x.qmax") < F.col("x.pmin"), F.col("x.pmin")).alias("clean_threshold"))


def jaccard_pairs(items: DataFrame, threshold: float, id_: str = "id", words: str = "words") -> DataFrame:
    """(a, b, jaccard): the pairs of distinct-word sets with an index of `threshold` or more, exactly.

    Of a set of n words only the n - ceil(threshold * n) + 1 rarest are joined on: sets above the threshold share one of
    them, so that a word that is in most sets makes pairs only where a set has no rarer ones.
    """
    sets = items.select(F.col(id_).alias("id"), F.array_sort(F.array_distinct(words)).alias("w")).where(F.size("w") > 0)
    long = sets.select("id", F.size("w").alias("n"), F.explode("w").alias("x"))
    rare = long.join(long.groupBy("x").agg(F.count("*").alias("df")), "x")
    rare = rare.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "x"))).where(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    a, b = (rare.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), "x") for k in "ab")
    near = a.join(b, "x").where(f"a < b and least(na, nb) >= {threshold} * greatest(na, nb)").select("a", "b").distinct()
    wa, wb = (sets.select(F.col("id").alias(k), F.col("w").alias(f"w{k}")) for k in "ab")
    j = near.join(wa, "a").join(wb, "b").select("a", "b", (F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))).alias("jaccard"))
    return j.where(F.col("jaccard") >= threshold)


def leakage_split(pairs: DataFrame, near: DataFrame, share: float = 0.5) -> DataFrame:
    """pairs (a, b) with component and side: dev and held-out share no component of pairs and near duplicates (a, b).

    Components go to dev from the largest on, until they hold `1 - share` of all component memberships.
    """
    c = components(pairs.select("a", "b").unionByName(near.select("a", "b")))
    p = pairs.join(c.select(F.col("node").alias("a"), "component"), "a")
    size = p.groupBy("component").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col("n").desc(), "component").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("running", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    side = size.select("component", F.when(F.col("running") < F.col("total") * (1 - share), "dev").otherwise("heldout").alias("side"))
    return p.join(side, "component")


def pair_grid(items: DataFrame, per_cell: int, id_: str = "id") -> DataFrame:
    """(a, b, same_action, same_object): stated items (id, action, object) as pairs, at most `per_cell` evenly strided ones a cell.

    Pairs come from joins on the action and on the object; the cell that shares neither pairs each item with the next ones
    in order only, so that no cell is all pairs of a large corpus.
    """
    a, b = (items.select(F.col(id_).alias(k), F.col("action").alias(f"v{k}"), F.col("object").alias(f"o{k}")) for k in "ab")
    same_verb = a.join(b, F.expr("va = vb and a < b"))
    same_object = a.join(b, F.expr("oa = ob and va <> vb and a < b"))
    order = Window.orderBy("a")
    near = a.withColumn("k", F.row_number().over(order))
    ahead = near.select(F.col("a").alias("b"), F.col("va").alias("vb"), F.col("oa").alias("ob"), F.explode(F.sequence(F.col("k") - 3, F.col("k") - 1)).alias("k"))
    neither = near.join(ahead, "k").where("va <> vb and oa <> ob")
    found = reduce(DataFrame.unionByName, [x.select("a", "b", (F.col("va") == F.col("vb")).alias("same_action"), (F.col("oa") == F.col("ob")).alias("same_object")) for x in (same_verb, same_object, neither)])
    cell = Window.partitionBy("same_action", "same_object")
    ranked = found.withColumn("r", F.row_number().over(cell.orderBy("a", "b")) - 1).withColumn("step", F.greatest(F.lit(1), F.floor(F.count("*").over(cell) / per_cell)))
    return ranked.where("r % step = 0 and r / step < " + str(per_cell)).select("a", "b", "same_action", "same_object")


def corpus(spark, verbs: list[str], objects: list[str], colours: list[str], sites: list[str]) -> DataFrame:
    """(text, label, verb, colour, site) of a grammar: every combination once, as one table of generated rows."""
    parts = [("verb", verbs), ("colour", colours), ("label", objects), ("site", sites)]
    df = spark.range(1).select(*[F.explode(F.array(*map(F.lit, parts[0][1]))).alias("verb")])
    for name, values in parts[1:]:
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    text = F.concat_ws(" ", "verb", F.lit("the"), F.nullif("colour", F.lit("")), "label", F.nullif("site", F.lit("")))
    return df.select(text.alias("text"), "label", "verb", "colour", "site")


def shuffled(df: DataFrame, by: str, seed: int = 0) -> DataFrame:
    """Adds `position`, the rank in a seeded order that every run repeats."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), by), by)))


def strided(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """About n rows, evenly spaced in an order."""
    w = Window.orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy())).where(f"_r % greatest(1, _n div {n}) = 0").drop("_r", "_n")


# --- ordered runs -----------------------------------------------------------------------------------------


RUN = "config string, id string, position long, cluster long, distance double, into_frozen boolean"


def cluster_runs(points: DataFrame, configs: list[dict]) -> DataFrame:
    """Online clustering of points (id, position, vector) in order, once for each configuration, each in a task of its own.

    A configuration: name, radius, rule, most, confirm_after (share of the points) and confirm_top (clusters then frozen).
    One task sees all points of a run, as the order decides; `most` clusters bound its work to n * most products.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = next(x for x in configs if x["name"] == pdf["config"].iloc[0])
        pdf = pdf.sort_values(["position", "id"])
        model = tasks.Centroids(c.get("radius", 0.3), c.get("most", 512), c.get("rule", "mean"))
        at, out = int(len(pdf) * c.get("confirm_after", 0.5)), []
        for k, v in enumerate(pdf["vector"]):
            cluster, distance, _ = model.add(np.asarray(v, float))
            out.append((cluster, distance, cluster in model.frozen))
            if k == at and c.get("confirm_top"):
                model.frozen |= set(sorted(range(len(model.sizes)), key=lambda i: -model.sizes[i])[: c["confirm_top"]])
        found = pd.DataFrame(out, columns=["cluster", "distance", "into_frozen"])
        return pd.concat([pdf[["config", "id", "position"]].reset_index(drop=True), found], axis=1)

    names = F.array(*[F.lit(c["name"]) for c in configs])
    each = points.select(F.col("id").cast("string").alias("id"), F.col("position").cast("long").alias("position"), "vector", F.explode(names).alias("config"))
    return each.groupBy("config").applyInPandas(run, RUN)


def run_report(runs: DataFrame) -> DataFrame:
    """(config, n, clusters, singletons, largest, dominance, cohesion, arrivals_into_frozen) of each run."""
    sizes = runs.groupBy("config", "cluster").agg(F.count("*").alias("k"), F.sum(1 - F.col("distance")).alias("near"), F.count_if("into_frozen").alias("f"))
    return sizes.groupBy("config").agg(F.sum("k").alias("n"), F.count("*").alias("clusters"), F.count_if(F.col("k") == 1).alias("singletons"), F.max("k").alias("largest"), (F.max("k") / F.sum("k")).alias("dominance"), (F.sum("near") / F.sum("k")).alias("cohesion"), F.sum("f").alias("arrivals_into_frozen"))


def run_agreement(runs: DataFrame, one: str, other: str) -> DataFrame:
    """The agreement of two runs over the same points: order, rule, radius or batch sensitivity."""
    a, b = (runs.where(F.col("config") == x).select("id", F.col("cluster").alias(k)) for x, k in ((one, "a"), (other, "b")))
    return rand_scores(a.join(b, "id"), "a", "b")


def centroid_drift(points: DataFrame, rules: list[str], radius: float = 0.3, orders: int = 8, seed: int = 1729) -> DataFrame:
    """(rule, drift, counts, outlier_pull): how far centroids move over seeded orders of the points, and for one opposite point.

    One task a rule; the points are an experiment's (some hundreds), as each order is a run over all of them.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rule, v = pdf["rule"].iloc[0], np.stack(pdf.sort_values("id")["vector"].map(np.asarray)).astype(float)

        def centroids(rows) -> np.ndarray:
            model = tasks.Centroids(radius, rule=rule)
            for x in rows:
                model.add(x)
            c = np.stack(model.points)
            size = np.sqrt((c * c).sum(axis=1, keepdims=True))
            return c / np.where(size > 0, size, 1)

        random, base = np.random.default_rng(seed), centroids(v)
        found = [centroids(v[random.permutation(len(v))]) for _ in range(orders)]
        like = [1 - (base @ f.T).max(axis=1).mean() for f in found if len(f) == len(base)]
        bad = centroids(np.vstack([v, -v[:1]]))
        return pd.DataFrame([(rule, float(np.mean(like)) if like else 0.0, len({len(base), *map(len, found)}), float(1 - (base @ bad.T).max(axis=1).mean()))], columns=["rule", "drift", "counts", "outlier_pull"])

    each = points.select(F.col("id").cast("string").alias("id"), "vector", F.explode(F.array(*map(F.lit, rules))).alias("rule"))
    return each.groupBy("rule").applyInPandas(run, "rule string, drift double, counts long, outlier_pull double")


# --- fits of small dense systems ----------------------------------------------------------------------------


def _balanced(scores: np.ndarray, same: np.ndarray) -> float:
    return float(((scores[same] > 0).mean() + (scores[~same] <= 0).mean()) / 2)


def ridge_probe(pairs: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(view, alpha, cv, dev, heldout): a linear probe of pair differences, its strength chosen by leaving components out.

    pairs: view, side (dev or heldout), component, same, difference (array). One task a view; its system has a row for
    each decided dev pair, which people have labelled.
    """
    def features(pdf: pd.DataFrame):
        pdf = pdf[pdf["same"].notna()]
        d = np.stack(pdf["difference"].map(np.asarray)).astype(float)
        size = np.sqrt((d * d).sum(axis=1))
        keep = size > 0
        d, size = d[keep], size[keep]
        x = np.column_stack([d / np.sqrt((d * d).sum(axis=1).mean()), size / np.sqrt((size * size).mean()), np.ones(len(d))])
        return x, pdf["same"].to_numpy(bool)[keep], pdf["component"].to_numpy()[keep]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (x, y, group), (hx, hy, _) = (features(pdf[pdf["side"] == s]) for s in ("dev", "heldout"))
        gram, sign = x @ x.T, np.where(y, 1.0, -1.0)

        def cross(alpha: float) -> float:
            out = np.zeros(len(y))
            for g in np.unique(group):
                t = group != g
                out[~t] = gram[np.ix_(~t, t)] @ np.linalg.solve(gram[np.ix_(t, t)] + alpha * np.eye(t.sum()), sign[t])
            return _balanced(out, y)

        cv, alpha = max(((cross(a), a) for a in alphas), key=lambda s: (s[0], -s[1]))
        w = x.T @ np.linalg.solve(gram + alpha * np.eye(len(x)), sign)
        return pd.DataFrame([(pdf["view"].iloc[0], alpha, cv, _balanced(x @ w, y), _balanced(hx @ w, hy))], columns=["view", "alpha", "cv", "dev", "heldout"])

    return pairs.groupBy("view").applyInPandas(run, "view string, alpha double, cv double, dev double, heldout double")


def fit_projection(same: np.ndarray, different: np.ndarray, k: int, shrinkage: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(basis of k directions, eigenvalues): whitens the scatter within the classes, then keeps what separates them most."""
    means = [d.mean(axis=0) for d in (same, different)]
    within = sum(((d - m).T @ (d - m) / len(d) for d, m in zip((same, different), means, strict=True)), np.zeros((same.shape[1],) * 2)) / 2
    gap = means[0] - means[1]
    ridge = within + shrinkage * np.trace(within) / len(within) * np.eye(len(within))
    value, vector = np.linalg.eigh(ridge)
    whiten = (vector / np.sqrt(np.maximum(value, max(value.max(), 1e-12) * 1e-10))) @ vector.T
    spread = whiten @ (within + np.outer(gap, gap)) @ whiten
    value, vector = np.linalg.eigh((spread + spread.T) / 2)
    top = np.argsort(value)[::-1][:k]
    return (whiten @ vector[:, top]).T, value[top]


def bootstrap_interval(samples: DataFrame, by: str, value: str, seed: int, resamples: int = 2000) -> DataFrame:
    """(by, n, mean, low, high): the 95% interval of the mean from seeded resamples, by nearest rank; one task a group of samples."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].to_numpy(float))
        random = np.random.default_rng(seed)
        means = np.sort([x[random.integers(0, len(x), len(x))].mean() for _ in range(resamples)])
        low, high = (means[max(0, int(np.ceil(q * resamples)) - 1)] for q in (0.025, 0.975))
        return pd.DataFrame([(pdf[by].iloc[0], len(x), x.mean(), low, high)], columns=[by, "n", "mean", "low", "high"])

    if resamples < 100:
        raise ValueError("100 resamples at least")
    kind = samples.schema[by].dataType.simpleString()
    return samples.select(by, value).where(F.col(value).isNotNull()).groupBy(by).applyInPandas(run, f"{by} {kind}, n long, mean double, low double, high double")


def leaderboard(summary: DataFrame, by: str = "p95", limit: int = 20) -> DataFrame:
    """The worst label sets of a metric summary, each with the worst of its name beside it."""
    worst = Window.partitionBy("name")
    return summary.withColumn("worst", F.max(by).over(worst)).orderBy(F.col(by).desc(), "name", "label_key").limit(limit)
