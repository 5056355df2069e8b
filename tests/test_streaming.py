import datetime as dt

from kinetrace.streaming import metrics

START = dt.datetime(2024, 1, 1)


def _stream(spark, tmp_path, values, name):
    rows = [("m", START + dt.timedelta(seconds=30 * i), float(v)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "name string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema("name string, ts timestamp, value double").parquet(str(tmp_path / name))


def test_windows(spark, tmp_path):
    stream = _stream(spark, tmp_path, range(10), "in")
    metrics.run_available(metrics.windows(stream), str(tmp_path / "out"), str(tmp_path / "state"), "complete")
    found = sorted((r.n, r.low, r.high) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [(2, 2.0 * i, 2.0 * i + 1) for i in range(5)]


def test_a_breach_holds_the_limits(spark, tmp_path):
    stream = _stream(spark, tmp_path, [10, 11] * 12 + [500, 500, 10], "in")
    metrics.run_available(metrics.control_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [r.held for r in found] == [False] * 24 + [True, True, False]
    assert found[23].ewma == found[25].ewma and found[19].z == 0.0 and found[20].z != 0.0


def test_live_clusters_are_those_of_one_run(spark, tmp_path):
    import numpy as np

    from kinetrace.functions.tasks import Centroids
    from kinetrace.streaming import clusters

    rng = np.random.default_rng(3)
    points = [(f"p{i}", i, (np.eye(5)[i % 3] + 0.1 * rng.normal(size=5)).tolist()) for i in range(30)]
    for part in (0, 1):
        rows = [("s", *p) for p in points[15 * part : 15 * part + 15]]
        spark.createDataFrame(rows, "session string, id string, position long, vector array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, id string, position long, vector array<double>").parquet(str(tmp_path / "in"))
    metrics.run_available(clusters.live_clusters(stream, confirm_at=20, confirm_top=1), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.id: r.cluster for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    model = Centroids(0.3)
    assert got == {i: model.add(np.array(v))[0] for i, _, v in points} and len(set(got.values())) == 3
    df = spark.createDataFrame([(i, v) for i, _, v in points], "id string, vector array<double>")
    assert {r.id: r.cluster for r in clusters.final_labels(df, [p.tolist() for p in model.points]).collect()} == got
