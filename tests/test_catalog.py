"""Catalog reports against counts by hand."""

import pytest
from kinetrace.operators import catalog
from pyspark.sql import functions as F

DIMS = "array<struct<name:string,active:boolean,discrete:boolean,gripper:boolean,norm_delta_std:double,mean_abs_delta_norm:double>>"


@pytest.fixture(scope="module")
def tables(spark):
    episodes = spark.createDataFrame([(f"e{i}", ("valid", "quarantined", "ingested")[i % 3], 100 + 10 * i, "v3" if i % 2 else "log") for i in range(12)], "id string, state string, frame_count int, format string")
    quality = spark.createDataFrame([(f"e{i}", ("smooth", "jerky")[i % 2], "ok", 1.0 * i, 0.1 * i, 0.05 * i, [("x", True, False, False, 0.01 * i, 0.1)]) for i in range(10)], f"episode_id string, verdict string, integrity string, movement_score double, jerk_score double, stall_ratio double, dims {DIMS}")
    return episodes, quality


def test_quality_summary(tables):
    episodes, quality = tables
    s = catalog.quality_summary(quality, episodes)
    assert {r.verdict: r.n for r in s["verdicts"].collect()} == {"smooth": 5, "jerky": 5}
    length = s["length"].first()
    assert (length.n, length.mean, length.low, length.high) == (10, 145.0, 100, 190) and length.std == pytest.approx(30.2765, abs=1e-3)
    bins = s["histogram"].orderBy("bin").collect()
    assert sum(r.n for r in bins) == 10 and len(bins) == 10 and (bins[0].low, bins[-1].high) == (100, 190)
    assert {(r.episode_id, r.dim): r.sigma for r in s["sigmas"].collect()}[("e3", "x")] == pytest.approx(0.03)
    out = {}
    for r in s["outliers"].orderBy("r").collect():
        out.setdefault(r.measure, []).append(r.episode_id)
    assert out["jerk"] == ["e9", "e8", "e7", "e6", "e5"] and set(out["length"][:2]) == {"e0", "e9"} and len(out["stall"]) == 5


def test_job_and_failure_reports(spark, tables):
    episodes, quality = tables
    edges = episodes.select(F.lit("episode").alias("from_type"), F.col("id").alias("from_ref"), F.lit("job").alias("to_type"), F.when(F.col("frame_count") < 150, "j1").otherwise("j2").alias("to_ref"), F.lit("produced_by").alias("relation"))
    checked = quality.select("episode_id", (F.col("verdict") == "smooth").alias("passed"))
    r = {x.job_id: x for x in catalog.job_report(catalog.produced_by(edges), episodes, quality, checked).collect()}
    assert (r["j1"].n, r["j1"].jerky, r["j1"].passed, r["j1"].valid) == (5, 2, 3, 2) and r["j2"].evaluated == 5 and r["j2"].n == 7
    results = checked.withColumns({"profile_name": F.lit("p"), "reason_codes": F.when(~F.col("passed"), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))})
    f = catalog.failure_summary(results, episodes)
    assert tuple(f["totals"].first()) == (4, 10) and {x.code: x.n for x in f["codes"].collect()} == {"A": 5, "B": 5}
    assert {x.profile_name: x.n for x in f["by_profile"].collect()} == {"p": 5} and {x.format: x.n for x in f["by_format"].collect()} == {"v3": 5}


def test_small_cases(spark, tables):
    episodes, _ = tables
    assert catalog.length_summary(episodes.limit(1), "frame_count").first().std == 0.0
    assert catalog.histogram(episodes.limit(0), "frame_count").count() == 0
    one = catalog.histogram(episodes.limit(1), "frame_count").where("n > 0").collect()
    assert [(r.bin, r.n) for r in one] == [(0, 1)]
    assert {r.z for r in catalog.zscores(episodes.limit(1), "frame_count").collect()} == {0.0}
    cells = {(r.s, r.f): (r.build_count, r.catalog_count) for r in catalog.coverage_cells(episodes.select(F.col("state").alias("s"), F.col("format").alias("f"), (F.col("frame_count") < 130).alias("inside")), "inside", ["s", "f"]).collect()}
    assert cells[(None, None)] == (3, 12) and cells[("valid", None)] == (1, 4) and len(cells) == 1 + 3 + 2 + 6
    at = catalog.ages(spark.createDataFrame([("a", 5), ("a", 9), ("b", 20)], "k string, s int").withColumn("ts", F.timestamp_seconds("s")), "k", "ts")
    assert {r.k: r.age_us for r in at.collect()} == {"a": 11_000_000, "b": 0}
