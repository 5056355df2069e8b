"""Telemetry, validation, curation and task strings, and every registered query against its SQL."""

import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions import tasks
from kinetrace.operators import curation, telemetry, validation
from kinetrace.plans import catalog, monitoring, storage  # noqa: F401  (they register their queries)
from kinetrace.plans.queries import QUERIES, SQL


def test_control_limits_follow_the_recurrence(spark):
    values = [float((i * 37) % 23) for i in range(120)]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "name string, i int, value double")
    got = telemetry.control_limits(df, ("i",)).first()
    centre = values[0]
    for v in values[1:]:
        centre += 0.2 * (v - centre)
    last = values[-50:]
    assert got.ewma == pytest.approx(centre) and got.median == pytest.approx(np.median(last)) and got.warm
    assert got.mad == pytest.approx(np.median(np.abs(np.array(last) - np.median(last))))


def test_triage_order_and_budget(spark):
    rows = [(0, i, f"f{i}", "high", True) for i in range(12)] + [(0, 12, "f0", "high", False), (0, 13, "x", "low", True), (0, 14, "open", "high", True)]
    s = spark.createDataFrame(rows, "window int, seq int, fingerprint string, severity string, has_evidence boolean").withColumn("ts", F.current_timestamp())
    known = spark.createDataFrame([("open", "open")], "fingerprint string, status string").withColumn("last_seen", F.lit(None).cast("timestamp"))
    got = [r.action for r in telemetry.triage(s, known).orderBy("seq").collect()]
    assert got == ["open"] * 10 + ["suppress_budget"] * 2 + ["suppress_no_evidence", "suppress_severity", "bump"]


def test_profiles():
    a, b = validation.Profile("p", min_frames=1), validation.Profile("p", min_frames=1)
    assert a.hash == b.hash != validation.Profile("p", min_frames=2).hash
    with pytest.raises(ValueError):
        validation.Profile("p", min_frames=3, max_frames=2)
    with pytest.raises(ValueError):
        validation.Profile("p", required=("a",), forbidden=("a",))
    with pytest.raises(ValueError):
        validation.canonical({"x": math.nan})
    m = [{"id": "b"}, {"id": "a"}]
    assert validation.build_hash("n", m) == validation.build_hash("n", m[::-1])


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a")], "n int, s string")
    rule = {"any": [{"field": "n", "op": "ge", "value": 2}, {"all": [{"field": "s", "op": "in", "value": ["a"]}, {"not": {"field": "n", "op": "eq", "value": 5}}]}]}
    assert df.where(curation.predicate(rule, {"n", "s"})).count() == 2
    with pytest.raises(ValueError):
        curation.predicate({"field": "secret", "op": "eq", "value": 1}, {"n"})


def test_task_cores(spark):
    df = spark.createDataFrame([("Pick up the red cup",), ("grab cup",), ("",), ("the the",), ("put down",)], "t string")
    w = tasks.tokens("t")
    got = df.select(tasks.leading_verb(w).alias("v"), tasks.core(w, tasks.leading_verb(w)).alias("c")).collect()
    assert [tuple(r) for r in got] == [("pick up", "cup"), ("grab", "cup"), ("", ""), ("", ""), ("put down", "")]
    site = df.sparkSession.createDataFrame([("move cup onto the table",)], "t string").select(tasks.core(w, tasks.leading_verb(w), ignore_site=True)).first()[0]
    assert site == "cup"


def test_second_member_replaces_the_seed():
    c = tasks.Centroids(radius=0.9)
    a, b = tasks.token_vector("red cup"), tasks.token_vector("blue cup")
    assert c.add(a)[2] and not c.add(b)[2]
    assert np.allclose(c.points[0], b)
    c.frozen.add(0)
    c.add(a)
    assert np.allclose(c.points[0], b) and c.sizes == [3]


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(_norm(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_works_without_the_corpus_operators(spark, monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and "episode_quality" in entry.oracle_sql()
    assert entry.entry(spark).count() > 0
    sys.modules.pop("__spark_entry__", None)
