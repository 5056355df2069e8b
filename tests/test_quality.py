"""Closed-form cases of motion quality and traces."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetrace.functions import motion
from kinetrace.operators import quality


def run(spark, values, clock=None):
    rows = [("e", i, float(clock[i]) if clock else float(i), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ep string, i int, t double, v double")
    return quality.episode_quality(df, "ep", ["i"], ["v"], "t").first()


def test_ramp(spark):
    q = run(spark, range(10))
    assert q.movement_score == pytest.approx(1.0)
    assert q.jerk_score == pytest.approx(1 / 9)
    assert (q.stall_ratio, q.verdict, q.integrity) == (0.0, "smooth", "ok")


def test_step(spark):
    q = run(spark, [0, 0, 0, 1, 1, 1])
    assert q.stall_ratio == pytest.approx(0.8)
    assert q.movement_score == pytest.approx(0.2)
    assert q.jerk_score == pytest.approx(0.2)
    assert q.verdict == "unknown" and q.dims[0].discrete


def test_void_and_short(spark):
    q = run(spark, [1, math.nan, 2, 3])
    assert (q.nonfinite, q.verdict, q.movement_score, q.integrity) == (1, "unknown", 0.0, "unknown")
    q = run(spark, [1.0])
    assert (q.frame_count, q.verdict, q.integrity) == (1, "unknown", "unknown")


def test_clock(spark):
    q = run(spark, range(6), [0, 1, 2, 3, 14, 15])
    assert (q.integrity, q.max_gap_seconds) == ("gapped", 11.0) and q.gap_ratio == pytest.approx(0.2)
    q = run(spark, range(4), [0, 2, 1, 3])
    assert (q.integrity, q.max_gap_seconds, q.gap_ratio) == ("gapped", None, 0.0)


def test_large_values_do_not_overflow(spark):
    rows = [("e", i, float(i), 1e200 * i, 1e200 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "ep string, i int, t double, a double, b double")
    assert quality.episode_quality(df, "ep", ["i"], ["a", "b"], "t").first().movement_score == pytest.approx(math.sqrt(2) * 1e200)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12), st.integers(4, 80))
def test_thinning_is_the_stepwise_one(sizes, cap):
    keep = list(sizes)
    while sum(keep) > cap:
        i = keep.index(max(keep))
        if keep[i] <= 2:
            break
        keep[i] -= 1
    got = motion.thin(sizes, cap)
    if sum(keep) <= cap:
        assert {i: len(x) for i, x in got.items()} == {i: k if k < n and k > 2 else min(n, max(k, 2)) if k < n else n for i, (n, k) in enumerate(zip(sizes, keep, strict=True))}
    assert all(x[0] == 0 and x[-1] == sizes[i] - 1 for i, x in got.items())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0.01, 5), min_size=3, max_size=40))
def test_shape_ignores_scale(values):
    t = np.arange(len(values), dtype=float)
    a, b = motion.shape(t, np.array(values)), motion.shape(t * 3 + 7, np.array(values) * 2)
    assert len(a) == 32 and np.allclose(a, b)
    me = {"shape": a, "dynamics": {"x": (0.1, 0.2)}, "stall": 0.1, "gap": 0.0}
    assert motion.distance(me, me)[0] == 0
    assert motion.distance(me, {**me, "shape": [], "dynamics": {}}) is None
