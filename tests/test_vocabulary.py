"""The vocabulary's operations, its log and undo, proposals, and job analytics."""

import numpy as np
import pytest
from kinetrace.functions import layout, tasks
from kinetrace.operators import jobs, proposals, vocabulary
from pyspark.sql import functions as F


def state(v):
    return {r.task_string: (r.entry_id, r.provenance) for r in v.mappings.collect()}, {r.id: r.label for r in v.entries.collect()}


def test_operations_and_undo(spark):
    a, b, c = (vocabulary.entry_id(x) for x in ("red cup", "plate", "bowl"))
    v = vocabulary.Vocabulary.empty(spark).create("red cup").create("plate").create("red cup")
    assert v.last == 2
    v = v.map("grab cup", a).map("take cup", a).map("lift plate", b).dismiss("xx")
    assert state(v)[0] == {"grab cup": (a, "confirm"), "take cup": (a, "confirm"), "lift plate": (b, "confirm"), "xx": (None, "dismiss")}
    merged = v.merge(a, b)
    assert state(merged) == ({"grab cup": (b, "merge"), "take cup": (b, "merge"), "lift plate": (b, "confirm"), "xx": (None, "dismiss")}, {b: "plate"})
    assert state(merged.undo(merged.last)) == state(v)
    moved = merged.map("grab cup", b)
    with pytest.raises(vocabulary.Conflict):
        moved.undo(merged.last)
    split = v.split(a, ["take cup"], "bowl")
    assert state(split)[0]["take cup"] == (c, "split") and state(split)[1][c] == "bowl"
    assert state(split.undo(split.last)) == state(v)
    with pytest.raises(vocabulary.Conflict):
        v.split(a, ["lift plate"], "bowl")
    named = v.rename(a, "cup")
    assert state(named)[1][a] == "cup" and state(named.undo(named.last)) == state(v)
    with pytest.raises(vocabulary.Conflict):
        named.rename(b, "cup")
    with pytest.raises(vocabulary.Conflict):
        named.create("red cup")  # the identifier of the renamed entry
    undone = v.undo(v.last)
    assert "xx" not in state(undone)[0]
    with pytest.raises(vocabulary.Conflict):
        undone.undo(v.last)
    for bad in (lambda: v.merge(a, a), lambda: v.create(" "), lambda: v.map("x", a, "dismiss"), lambda: v.split(a, [], "q")):
        with pytest.raises(ValueError):
            bad()
    for missing in (lambda: v.map("x", "voc_0"), lambda: v.merge(a, "voc_0"), lambda: v.undo(99)):
        with pytest.raises(KeyError):
            missing()


def test_accepting_candidates(spark):
    seen = spark.createDataFrame([("grab the fork",), ("take fork",)], "task_string string")
    v = vocabulary.Vocabulary.empty(spark)
    new = v.accept(["grab the fork", "take fork"], "fork", seen, label="fork")
    assert set(state(new)[0]) == {"grab the fork", "take fork"} and list(state(new)[1].values()) == ["fork"]
    assert state(new.undo(new.last)) == ({}, {})
    again = new.map("put fork", vocabulary.entry_id("fork"))
    assert list(state(again.undo(new.last))[1].values()) == ["fork"]  # another string still uses the entry
    for bad in (lambda: new.accept(["take fork"], "fork", seen, entry=vocabulary.entry_id("fork")), lambda: v.accept(["take spoon"], "spoon", seen, label="spoon"), lambda: v.accept(["take fork"], "cup", seen, label="cup"), lambda: v.accept([], "fork", seen, label="fork")):
        with pytest.raises(ValueError):
            bad()


def test_core_of_a_string(spark):
    strings = ["pick up the red cup", "Open drawer", "screw in a bulb", "screw bulb", "the green", "", "42 apples"]
    df = spark.createDataFrame([(s,) for s in strings], "s string").withColumn("w", tasks.tokens("s"))
    got = [r.c for r in df.select(tasks.core(F.col("w"), tasks.leading_verb(F.col("w"))).alias("c")).collect()]
    assert got == [tasks.core_of(s) for s in strings] == ["cup", "drawer", "bulb", "bulb", "", "", "42 apples"]


def test_proposals(spark):
    rows = [("grab red cup", 5), ("take cup", 3), ("open drawer", 2), ("open the drawer", 9), ("wipe", 4), ("push wooden box", 1), ("push box wooden", 7)]
    found = proposals.extracted(spark.createDataFrame(rows, "task string, episodes long"))
    p = proposals.proposals(found, proposals.clustered_cores(found))
    by_core = {r.core: r for r in p["proposals"].collect()}
    assert set(by_core) == {"cup", "drawer", "box wooden"} and by_core["box wooden"].merged_cores == ["box wooden", "wooden box"]
    assert (by_core["drawer"].size, by_core["drawer"].episodes, by_core["box wooden"].is_merge) == (2, 11, True)
    h = proposals.health(found, p["proposals"]).first()
    assert (h.tasks, h.clusters, h.merges, h.distinct_cores, h.singletons) == (7, 3, 1, 4, 0)
    alone = proposals.extracted(spark.createDataFrame([("take lamp", 1), *rows], "task string, episodes long"))
    p = proposals.proposals(alone, proposals.clustered_cores(alone))
    review = proposals.review_candidates(p["members"], p["proposals"], spark.createDataFrame([], "task string")).collect()
    assert [(r.task, r.reason) for r in review] == [("take lamp", "no supporting neighbors")]
    decided = spark.createDataFrame([("take lamp",)], "task string")
    assert proposals.review_candidates(p["members"], p["proposals"], decided).count() == 0
    assert proposals.layout(p["proposals"]).count() == 4


def test_plane_and_hull_and_layers():
    rng = np.random.default_rng(1)
    a = np.vstack([np.eye(6)[0] + 0.05 * rng.normal(size=(5, 6)), np.eye(6)[1] + 0.05 * rng.normal(size=(5, 6))])
    at, explained = layout.plane(a)
    assert explained > 0.9 and np.abs(at[:5].mean(axis=0) - at[5:].mean(axis=0)).max() > 3 * at[:5].std(axis=0).max()
    assert layout.plane(a[:1])[0].tolist() == [[0.0, 0.0]] and layout.plane(a[:0])[0].shape == (0, 2)
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5], [0.5, 0], [0, 0]])
    assert layout.hull(square).tolist() == [[0, 0], [1, 0], [1, 1], [0, 1]]
    assert layout.layers({"a": set(), "b": {"a"}, "c": {"b", "a"}, "d": {"d", "zz"}}) == {"a": 0, "b": 1, "c": 2, "d": 0}
    assert max(layout.layers({"a": {"b"}, "b": {"a"}}).values()) <= 2


def test_error_texts(spark):
    texts = ["  a \n b ", "https://u:p@h/x token=abc", "Api-Key = 12 x", "y" * 500, "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in df.select(jobs.error_message(F.col("t")).alias("m")).collect()]
    assert got[:3] == ["a b", "https://***:***@h/x token=***", "Api-Key=*** x"]
    assert len(got[3]) == 400 and got[3].endswith("…") and got[4] == got[5] == "job handler failed"


def test_job_transitions_follow_the_table(spark):
    rows = [("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "succeeded"), ("b", 1, "queued"), ("b", 2, "succeeded"), ("c", 1, "failed"), ("c", 2, "running")]
    got = {(r.was, r.state): (r.n, r.illegal) for r in jobs.transition_report(spark.createDataFrame(rows, "id string, seq int, s string"), "id", "seq", "s").collect()}
    assert got[("queued", "running")] == (1, 0) and got[("queued", "succeeded")] == (1, 1) and got[("failed", "running")] == (1, 1)
