"""Evaluation measures against closed forms and brute force."""

from functools import partial

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinetrace.functions import tasks
from kinetrace.operators import evaluation as ev
from kinetrace.operators import sets
from kinetrace.plans.catalog import token_jaccard
from pyspark.sql import functions as F


def test_partitions(spark):
    same = spark.createDataFrame([(i, i % 3, (i % 3) * 7) for i in range(30)], "id int, a int, b int")
    r = ev.rand_scores(same, "a", "b").first()
    assert (r.ari, r.pair_precision, r.pair_recall, r.pair_f1) == (1.0, 1.0, 1.0, 1.0)
    assert ev.b_cubed(same, "a", "b").first().b_cubed == pytest.approx(1.0)
    assert ev.rand_scores(same.limit(1), "a", "b").first().ari == 0.0
    one = same.withColumn("b", F.lit(1))
    assert ev.rand_scores(one, "a", "b").first().ari == pytest.approx(0.0)
    s = ev.subset_quality(same, "a", "b", F.col("a") < 2).first()
    assert (s.items, s.fragmentation, s.impure) == (20, 1.0, 0)


def test_gold_scores(spark):
    labels = spark.createDataFrame([("x", 1), ("y", 1), ("z", 2), ("w", 2)], "item string, cluster int")
    pairs = spark.createDataFrame([("x", "y", True), ("x", "z", True), ("z", "w", False), ("x", "w", False), ("x", "q", None)], "a string, b string, same boolean")
    g = ev.gold_scores(labels, pairs).first()
    assert (g.over_merge_rate, g.under_merge_rate, g.pair_precision, g.pair_recall, g.scored_pairs, g.ambiguous_pairs, g.unassigned) == (0.5, 0.5, 0.5, 0.5, 4, 1, 1)


def test_jaccard_pairs_by_brute_force(spark):
    rng = np.random.default_rng(4)
    sets = [{f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 20))} | ({"the"} if i % 2 else set()) for i in range(80)]
    sets += [set(s) - {next(iter(s))} for s in sets[:20] if len(s) > 6] + [set(), {"a"}, {"a"}]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id int, words array<string>")
    for t in (0.5, 0.8):
        want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a | b and len(a & b) / len(a | b) >= t}
        got = {(r.a, r.b): r.jaccard for r in ev.jaccard_pairs(df, t).collect()}
        assert got == pytest.approx(want) and len(want) > 5


def test_leakage_split(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("f", "g"), ("h", "i"), ("k", "l")], "a string, b string")
    near = spark.createDataFrame([("c", "d")], "a string, b string")
    rows = ev.leakage_split(pairs, near).collect()
    side = {}
    for r in rows:
        for x in (r.a, r.b):
            assert side.setdefault(x, r.side) == r.side
    assert side["a"] == side["e"] and {r.side for r in rows} == {"dev", "heldout"} and len(rows) == 6


def test_axes_corpus_and_grid(spark):
    items = ev.corpus(spark, ["grab", "open"], ["cup", "box"], ["", "red"], ["", "on the table"])
    assert items.count() == 16 and items.where("text = 'grab the red cup on the table'").count() == 1
    items = ev.shuffled(items, "text").withColumn("id", F.col("position")).cache()
    again = {r.text: r.position for r in ev.shuffled(items.drop("position"), "text").collect()}
    assert {r.text: r.position for r in items.collect()} == again
    points = items.select("id", "text").toPandas()
    vectors = spark.createDataFrame([(int(i), tasks.pseudo_embedding(t).tolist()) for i, t in zip(points["id"], points["text"], strict=True)], "id long, vector array<double>")
    report = {r.axis: r for r in ev.axis_report(items, vectors, ["verb", "colour", "site"]).collect()}
    rows = {r.id: r for r in items.collect()}
    v = {r.id: np.array(r.vector) for r in vectors.collect()}
    same = [1 - v[i] @ v[j] for i in rows for j in rows if i < j and rows[i].label == rows[j].label and rows[i].verb != rows[j].verb and rows[i].colour == rows[j].colour and rows[i].site == rows[j].site]
    assert report["verb"].same_pairs == len(same) and report["verb"].same_mean == pytest.approx(np.mean(same))
    grid = ev.pair_grid(items.select("id", F.col("verb").alias("action"), F.col("label").alias("object")), 5).collect()
    assert {(r.same_action, r.same_object) for r in grid} == {(True, True), (True, False), (False, True), (False, False)}
    assert all((rows[r.a].verb == rows[r.b].verb, rows[r.a].label == rows[r.b].label) == (r.same_action, r.same_object) for r in grid)
    assert 4 <= ev.strided(items, ["id"], 4).count() <= 5


def test_separability_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [("v", bool(s), round(float(rng.normal(0.6 if s else 0.4, 0.15)), 2)) for s in rng.integers(0, 2, 120)]
    r = ev.separability(spark.createDataFrame(rows, "view string, same boolean, score double"), "view").first()
    pos, neg = (np.array([x for _, s, x in rows if s == k]) for k in (True, False))
    best = max(((pos >= c).mean() + (neg < c).mean()) / 2 for c in {x for *_, x in rows})
    assert r.accuracy == pytest.approx(best) and ((pos >= r.threshold).mean() + (neg < r.threshold).mean()) / 2 == pytest.approx(best)
    clean = ev.separability(spark.createDataFrame([("v", True, 0.9), ("v", False, 0.1)], "view string, same boolean, score double"), "view").first()
    assert (clean.accuracy, clean.clean_threshold) == (1.0, 0.9)


def test_runs_and_drift(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8)[:3]
    points = [(i, i, (centres[i % 3] + 0.05 * rng.normal(size=8)).tolist()) for i in range(60)]
    df = spark.createDataFrame(points, "id long, position long, vector array<double>")
    configs = [{"name": n, "radius": 0.3, "rule": n, "confirm_top": 2} for n in ("mean", "ema", "last 8", "trim 16 0.25", "huber 16 1", "medoid 8")]
    runs = ev.cluster_runs(df, configs)
    report = {r.config: r for r in ev.run_report(runs).collect()}
    assert all(r.clusters == 3 and r.n == 60 and r.singletons == 0 and r.arrivals_into_frozen > 10 for r in report.values()) and len(report) == 6
    assert ev.run_agreement(runs, "mean", "medoid 8").first().ari == pytest.approx(1.0)
    drift = {r.rule: r for r in ev.centroid_drift(df, ["mean", "medoid 8"]).collect()}
    assert all(0 <= r.drift < 0.1 for r in drift.values())


def test_probe_and_projection(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        same = bool(i % 2)
        d = rng.normal(size=6) * 0.2 + (0 if same else np.array([1.0, 0, 0, 0, 0, 0]))
        rows.append(("action", "dev" if i < 80 else "heldout", i // 4, same, d.tolist()))
    r = ev.ridge_probe(spark.createDataFrame(rows, "view string, side string, component long, same boolean, difference array<double>")).first()
    assert r.cv > 0.9 and r.heldout > 0.9
    same, different = (np.array([d for *_, s, d in rows if s == k]) for k in (True, False))
    basis, values = ev.fit_projection(same, different, 2)
    assert basis.shape == (2, 6) and values[0] >= values[1] and abs(basis[0, 0]) > 3 * np.abs(basis[0, 1:]).max()


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(100)] + [("b", 3.0)] * 5, "k string, v double")
    got = {r.k: r for r in ev.bootstrap_interval(df, "k", "v", 1, 500).collect()}
    assert got["a"].low < 49.5 < got["a"].high and got["a"].high - got["a"].low < 15 and (got["b"].low, got["b"].high) == (3.0, 3.0)
    with pytest.raises(ValueError):
        ev.bootstrap_interval(df, "k", "v", 1, 10)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["pick up", "red", "cup", "the", "open", "door"]), max_size=5))
def test_texts(found):
    text = " ".join(found)
    assert abs(np.linalg.norm(tasks.pseudo_embedding(text)) - 1) < 1e-9 or not text
    assert tasks.masked(text).split() == text.split()[len(text.split()) - len(tasks.masked(text).split()) :]
    assert (tasks.colour_vector(text).sum() > 0) == ("red" in found)


def test_large_rows_keep_robust_rules_robust():
    rows = np.vstack([np.tile([1.0, 0.0], (9, 1)), [[-1.0, 0.0]]])
    assert tasks.trimmed(rows, 10, 0.2) @ [1, 0] > 0.99 and tasks.medoid(rows, 10).tolist() == [1.0, 0.0]
    assert tasks.huber(rows, 10, 0.5) @ [1, 0] > 0.99


def _alike_by_brute_force(items, t):
    """id -> (class_id, copy_of, n_copies, n_links) of rows (id, words) with distinct ids."""
    same = {}
    for i, w in items:
        if w:
            same.setdefault(frozenset(w), []).append(i)
    found = list(same)
    near = {s: [x for x in found if x != s and len(s & x) / len(s | x) >= t] for s in found}
    want = {i: (i, i, 1, 0) for i, w in items if not w}
    for s in found:
        seen, todo = {s}, [s]
        while todo:
            for x in near[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        want |= {i: (min(min(same[x]) for x in seen), min(same[s]), len(same[s]), len(near[s])) for i in same[s]}
    return want


@pytest.mark.parametrize(("small", "listed"), [(256, 1 << 18), (3, 5), (1, 0)])
def test_alike_by_brute_force(spark, monkeypatch, small, listed):
    """Pairs of small groups and forests of large ones lose no link, whatever the list of frequent members."""
    monkeypatch.setattr(sets, "_met", partial(sets._met, small=small))
    rng = np.random.default_rng(6)
    items = []
    for n in (1, 2, 4, 5, 9, 10, 40, 70, 200):
        for _ in range(4):
            base = {f"w{x}" for x in rng.integers(0, 4000, n)} | {"the"}
            items.append(base)
            for drop in (0, 1, 2, n // 9, n // 5):
                items.append(set(list(base)[: max(1, len(base) - drop)]) | {f"n{x}" for x in rng.integers(0, 99, drop // 2)})
    items += [set(), {"a"}, {"a"}, set()]
    rows = [(i, sorted(w) * 2) for i, w in enumerate(items)]
    for t in (0.5, 0.8):
        got = {r.id: (r.class_id, r.copy_of, r.n_copies, r.n_links) for r in sets.alike(spark.createDataFrame(rows, "id long, words array<string>"), t, listed=listed).collect()}
        assert got == _alike_by_brute_force([(i, set(w)) for i, w in rows], t)
        assert sum(x[3] for x in got.values()) > 100


def test_alike_rows_and_exchange(spark):
    """A group of near copies gives one row a document and no pairs; rows of null words or ids are kept; an empty table gives none."""
    rows = [(i, ["x", "y", "z", "u", "v", "w", "p", "q", "r", f"n{i}"]) for i in range(400)] + [(None, None), (None, ["x"]), (7, [None, "x"])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    got = [(r.id, r.class_id, r.n_copies, r.n_links) for r in sets.alike(df, 0.8).collect()]
    assert len(got) == 403 and {x[1:] for x in got if x[3]} == {(0, 1, 399)}
    assert {x[1:] for x in got if x[3] == 0} == {(7, 2, 0), (None, 1, 0)}
    assert sets.alike(df.limit(0), 0.8).count() == 0


def test_token_jaccard_gives_classes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", tasks.tokens("text").alias("w")).collect()
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_copies, r.n_links) for r in token_jaccard(spark, sf).collect()}
    assert got == _alike_by_brute_force([(r.doc_id, set(r.w or [])) for r in docs], 0.8)
