"""Blobs, builds, exports, downloads, metric logs and the readers' further facts."""

import csv
import glob
import hashlib
import io
import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from kinetrace.functions import motion
from kinetrace.operators import catalog, curation, redundancy, validation
from kinetrace.sinks import blobs, datasets, tables
from kinetrace.sources import records, recordings
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def test_blobs(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),)], "content binary")
    want = {hashlib.sha256(x).hexdigest(): x for x in (b"one", b"two")}
    assert {r.hash: r.size_bytes for r in blobs.put(df, root).collect()} == dict.fromkeys(want, 3)
    files = sorted(glob.glob(f"{root}/blobs/sha256/*/*.parquet"))
    blobs.put(df, root)
    assert sorted(glob.glob(f"{root}/blobs/sha256/*/*.parquet")) == files and blobs.stored(spark, root).count() == 2
    got = blobs.get(spark, root, spark.createDataFrame([(h,) for h in want], "hash string"))
    assert {r.hash: bytes(r.content) for r in got.collect()} == want
    for bad in (lambda: blobs.put(spark.createDataFrame([(bytearray(b""),)], "content binary"), root), lambda: blobs.get(spark, root, spark.createDataFrame([("0" * 64,)], "hash string")).collect()):
        with pytest.raises(PySparkException):
            bad()


def synthetic(n, width=2):
    return json.dumps({"timestamps": [0.1 * i for i in range(n)], "observations": [[float(i)] * width for i in range(n)], "actions": [[1.0] for _ in range(n)]}).encode()


def test_export_round_trip(spark, tmp_path):
    sink = io.BytesIO()
    pq.write_table(pa.table({"episode_index": [3, 3, 4], "timestamp": [0.0, 0.5, 0.0], "observation": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], "action": [[7.0], [8.0], [9.0]], "name": ["x", "y", "z"]}), sink)
    artifacts = spark.createDataFrame([("b", None, bytearray(synthetic(4))), ("a", "episode_index=3", bytearray(sink.getvalue()))], "episode_id string, episode_key string, content binary")
    frames = datasets.artifact_frames(artifacts)
    assert {r.episode_id: r.n for r in frames.groupBy("episode_id").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 4}
    made = datasets.build(spark, "demo", spark.createDataFrame([("b", "h2"), ("a", "h1")], "id string, artifact_hash string"))
    assert made["hash"] == datasets.build(spark, "demo", spark.createDataFrame([("a", "h1"), ("b", "h2")], "id string, artifact_hash string"))["hash"]
    assert [(r.episode_id, r.ordinal) for r in made["build_episodes"].orderBy("ordinal").collect()] == [("a", 0), ("b", 1)] and made["edges"].count() == 2
    named = datasets.record_build(made["builds"], made["builds"].withColumn("name", F.lit("new")))
    assert [(r.hash, r.name) for r in named.collect()] == [(made["hash"], "new")]
    members = made["build_episodes"].withColumns({"tasks": F.when(F.col("episode_id") == "a", F.array(F.lit("grab"))), "robot": F.lit("arm")})
    info = datasets.export(spark, str(tmp_path), made["hash"], "demo", members, frames)
    assert (info["total_frames"], info["total_episodes"], info["robot_type"]) == (6, 2, "arm")
    path = f"{tmp_path}/{made['hash']}"
    assert recordings.sniff(spark, path) == "dataset" and recordings.read_info(spark, path) == info
    index = recordings.episode_index(spark, path)
    assert [(r.episode_index, r.length, r.dataset_from_index, r.tasks) for r in index.orderBy("episode_index").collect()] == [(0, 2, 0, ["grab"]), (1, 4, 2, ["export"])]
    back = recordings.frames(spark, path, "episode_index=1").orderBy("index").collect()
    assert [(r["index"], r["frame_index"], r["observation[1]"], r["action[0]"]) for r in back] == [(2 + i, i, float(i), 1.0) for i in range(4)]
    first = recordings.frames(spark, path).orderBy("index").collect()
    assert [(r["observation[0]"], r["action"], r["action[0]"]) for r in first] == [(1.0, 7.0, None), (3.0, 8.0, None)]
    assert datasets.export(spark, str(tmp_path), made["hash"], "other", members, frames.limit(0)) == info  # an address is written once
    assert not glob.glob(f"{tmp_path}/.pending*") and [(r.chunk, r.file, r.first_index) for r in recordings.file_offsets(index).orderBy("file").collect()] == [(0, 0, 0), (0, 1, 2)]
    with pytest.raises(datasets.ExportError):
        datasets.export(spark, str(tmp_path), "bld_x", "demo", members, frames.where("episode_id = 'a'"))
    ragged = spark.createDataFrame([("r", None, bytearray(json.dumps({"timestamps": [0, 1], "observations": [[1]], "actions": [[1], [1]]}).encode()))], "episode_id string, episode_key string, content binary")
    with pytest.raises(PySparkException):
        datasets.artifact_frames(ragged).collect()
    for old in (tmp_path / made["hash"] / "data/chunk-000").glob("*file-001.parquet*"):
        old.unlink()
    (tmp_path / made["hash"] / "data/chunk-000/.file-001.parquet.crc").unlink(missing_ok=True)
    pq.write_table(pa.table({"index": [2, 3]}), tmp_path / made["hash"] / "data/chunk-000/file-001.parquet")
    with pytest.raises(recordings.UnreadableRecording):
        recordings.frames(spark, path, "1")


def test_downloads(spark, tmp_path):
    df = spark.createDataFrame([(2, True, "a,\"b\"", {"z": 1, "a": None}, (1, "x")), (1, None, None, None, None)], "id int, ok boolean, name string, labels map<string,int>, s struct<q:int,b:string>")
    columns = ["id", "ok", "name", "labels", "s"]
    tables.download(df, str(tmp_path / "c"), "csv", columns, [F.col("id")])
    rows = [r for f in sorted(glob.glob(f"{tmp_path}/c/*.csv")) for r in csv.reader(open(f))]
    assert rows == [columns, ["1", "", "", "", ""], ["2", "true", 'a,"b"', '{"a":null,"z":1}', '{"b":"x","q":1}']]
    tables.download(df, str(tmp_path / "j"), "jsonl", columns, [F.col("id").desc()], limit=1)
    (line,) = [x for f in glob.glob(f"{tmp_path}/j/*.json") for x in open(f)]
    assert json.loads(line) == {"id": 2, "ok": True, "name": 'a,"b"', "labels": {"z": 1, "a": None}, "s": {"q": 1, "b": "x"}}
    with pytest.raises(ValueError):
        tables.download(df, str(tmp_path / "x"), "xml", columns, [F.col("id")])


def test_metric_log(spark, tmp_path):
    rows = [("ok_total", 1.0, {"b": "2", "a": "1"}, "2026-01-02T03:04:05Z"), ("Bad", 1.0, {}, "2026-01-02T00:00:00Z"), ("x", 1.0, {"job_id": "7"}, "2026-01-03T00:00:00Z"), ("y", 2.0, {}, "2026-01-03T00:00:00Z")]
    df = spark.createDataFrame(rows, "name string, value double, labels map<string,string>, timestamp string")
    assert tables.append_metrics(df, str(tmp_path / "m")) == 2
    back = records.metric_records(spark, f"{tmp_path}/m/day=*")
    assert {r.name for r in back.collect()} == {"ok_total", "y"} and len(glob.glob(f"{tmp_path}/m/day=*")) == 2


def test_profile_documents(spark):
    good = {"name": "p", "version": "2", "required_channels": ["b", "a"], "min_frames": 2, "max_fps": 30, "enabled_rules": ["frame_count"]}
    p = validation.profile_of(json.dumps(good))
    assert (p.required, p.min_frames, p.max_fps, p.enabled) == (("a", "b"), 2, 30.0, ("frame_count",))
    assert p.hash == validation.profile_of({**good, "required_channels": ["a", "b"]}).hash != validation.profile_of({**good, "min_frames": 3}).hash
    for bad in ("{", [], {}, {**good, "name": ""}, {**good, "min_frames": 0}, {**good, "min_frames": True}, {**good, "max_fps": -1}, {**good, "max_fps": "3"}, {**good, "min_fps": 31}, {**good, "forbidden_channels": ["a"]}, {**good, "required_channels": "a"}, {**good, "enabled_rules": [1]}):
        with pytest.raises(validation.InvalidProfile):
            validation.profile_of(bad)
    stored = spark.createDataFrame([("e1", json.dumps({"frame_count": 5, "fps": 20.0, "task": "x", "channel_stats": {"a": {"min": 0, "max": 1, "mean": 0.5, "std": 0.1}}})), ("e2", "{}")], "id string, metadata string")
    profile = validation.profile_of({"name": "p", "version": "1", "required_channels": ["a"]})
    got = {r.id: r.reason_codes for r in validation.validate(validation.stored_episodes(stored), profile).collect()}
    assert got["e1"] == [] and set(got["e2"]) >= {"EMPTY_EPISODE", "REQUIRED_CHANNEL_MISSING", "UNDECLARED_TASK"}
    clocks = spark.createDataFrame([("a", i, t) for i, t in enumerate([0.0, 1.0, 0.5])] + [("b", i, float(i)) for i in range(3)], "ep string, i int, t double")
    assert {r.ep: (r.steps_back, r.passed) for r in validation.monotonic(clocks, "ep", ["i"], "t").collect()} == {"a": (1, False), "b": (0, True)}


def test_registers(spark):
    profiles = spark.createDataFrame([("p", "1", "h1")], "name string, version string, profile_hash string")
    assert records.register_profiles(profiles, profiles.withColumn("version", F.lit("2"))).count() == 2
    with pytest.raises(ValueError):
        records.register_profiles(profiles, profiles.withColumn("profile_hash", F.lit("h2")))
    shape = "episode_id string, profile_hash string, passed boolean, seq int"
    old, new = spark.createDataFrame([("e", "h1", True, 1), ("f", "h1", True, 2)], shape), spark.createDataFrame([("e", "h1", False, 3), ("e", "h2", True, 4)], shape)
    kept, told = records.register_validations(old, new, spark.createDataFrame([("e", "ingested"), ("f", "ingested"), ("g", "ingested")], "id string, state string"))
    assert kept.count() == 3 and {r.id: r.state for r in told.collect()} == {"e": "valid", "f": "valid", "g": "ingested"}
    base = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "k string, v double, seq int")
    batch = spark.createDataFrame([(["a", "c"], [9.0, 3.0], [2, 2])], "k array<string>, v array<double>, seq array<int>")
    assert {r.k: r.v for r in records.upsert_arrays(base, batch, ["k", "v", "seq"], ["k"], "seq").collect()} == {"a": 9.0, "b": 2.0, "c": 3.0}


def test_harvest_and_introspection(spark, tmp_path):
    pq.write_table(pa.table({"task": ["grab cup", "12345", "ab"]}), tmp_path / "t.parquet")
    (tmp_path / "t.jsonl").write_text('{"task": "open door"}\n{"task": "grab cup"}\n')
    (tmp_path / "t.csv").write_text("task,x\nwipe table,1\n")
    assert {r.task for r in records.harvest_tasks(spark, str(tmp_path)).collect()} == {"grab cup", "open door", "wipe table"}
    t = records.introspect(spark, {"x": spark.range(3)}, {"x": ["id"]}).collect()
    assert [(r.table, r.column, r.type, r.is_key, r.n_rows) for r in t] == [("x", "id", "bigint", True, 3)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/one.json").write_text(json.dumps({"benchmark": "ingest", "git_commit": "abc", "samples": [3.0, 1.0, 2.0]}))
    (tmp_path / "b/bad.json").write_text("{nope")
    assert [(r.name, r.commit, r.p50, r.p95, r.samples) for r in records.benchmark_records(spark, str(tmp_path / "b")).collect()] == [("ingest", "abc", 2.0, 3.0, 3)]


def test_metadata_facts(spark, tmp_path):
    def text(x):
        return struct.pack("<I", len(x)) + x

    def record(op, body):
        return struct.pack("<BQ", op, len(body)) + body

    def meta(name, found):
        packed = b"".join(text(k.encode()) + text(v.encode()) for k, v in found.items())
        return record(0x0C, text(name) + struct.pack("<I", len(packed)) + packed)

    data = recordings.MAGIC + meta(b"session", {"robot": "arm", "task": ""}) + meta(b"late", {"robot": "leg", "task_name": "wipe"}) + record(2, b"")
    (tmp_path / "x.mcap").write_bytes(data)
    r = recordings.metadata_facts(spark, str(tmp_path)).first()
    assert r.facts == {"robot": "arm", "task": "", "task_name": "wipe"} and (r.robot, r.task) == ("arm", "wipe")


def test_published_and_computed_statistics(spark, tmp_path):
    pq.write_table(pa.table({"episode_index": [0], "stats/action/min": [[-1.0]], "stats/action/max": [[2.0]], "stats/action/mean": [[0.5]], "stats/action/std": [[0.1]], "stats/action/count": [[7]]}), tmp_path / "i.parquet")
    published = recordings.published_statistics(spark.read.parquet(str(tmp_path / "i.parquet"))).drop("episode_index")
    frames = spark.createDataFrame([(0, [1.0, 3.0], 4.0, "x"), (1, [5.0, float("nan")], 8.0, "y")], "frame_index int, action array<double>, speed double, name string")
    computed = catalog.value_statistics(recordings.feature_values(frames), "feature", "value")
    got = {r.feature: r for r in catalog.published_or_computed(published, computed, "feature").collect()}
    assert (got["action"].n, got["action"].low, got["action"].std, got["action"].nonfinite) == (7, -1.0, 0.1, 1)
    assert (got["speed"].n, got["speed"].mean, got["speed"].std) == (2, 6.0, 2.0) and set(got) == {"action", "speed"}


def test_decimating_window():
    def twin(n):
        values, clock = [], []
        for x in range(n):
            values.append(x)
            if len(values) > 8:
                values = values[::2]
            clock.append(x)
            if len(clock) > 8:
                clock = clock[len(clock) - (len(clock) + 1) // 2 :]
        return values, clock

    for n in (0, 1, 8, 9, 13, 14, 50, 203):
        v, c = motion.sampled(n, 4)
        assert (v.tolist(), c.tolist()) == twin(n), n
    assert len(motion.evenly(5000)) == 1024 and motion.evenly(0).tolist() == [] and motion.evenly(3).tolist() == [0, 1, 2]


def test_redundancy_flags(spark):
    shape = np.linspace(0, 1, 32).tolist()
    rows = [(f"e{i}", "smooth", 1, 0.1 * (i % 2), 0.0, shape if i < 4 else shape[::-1], {"x": (0.1, 0.2 + (i >= 4))}) for i in range(6)]
    df = spark.createDataFrame(rows, "episode string, verdict string, judged_dims int, stall_ratio double, gap_ratio double, shape array<double>, dynamics map<string,struct<std:double,mean:double>>")
    whole = redundancy.redundancy(df)
    assert {r.truncated for r in whole.collect()} == {False} and {r.truncated for r in redundancy.redundancy(df, most=3).collect()} == {True}
    groups = redundancy.redundancy_groups(whole).collect()
    assert sum(g.n for g in groups) <= 6 and all(g.representative in g.members for g in groups)


def test_listing_cursor_and_gaps(spark):
    e = spark.createDataFrame([(i, "valid", i, 10 - i) for i in range(6)], "id int, state string, created_at int, frame_count int")
    q = spark.createDataFrame([(i, "jerky", float(i), 0.6, 1.0) for i in range(4)], "episode_id int, verdict string, jerk_score double, stall_ratio double, movement_score double")
    assert [r.id for r in curation.episode_listing(e, q, flag="jerky").collect()] == [3, 2, 1, 0]
    assert [r.id for r in curation.episode_listing(e, q, flag="jerky", before=3).collect()] == [2, 1, 0]
    assert [r.id for r in curation.episode_listing(e, q, flag="long", limit=2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        curation.slice_rule(flag="odd")
    entries = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, label string")
    gaps = curation.vocabulary_gaps(entries, spark.createDataFrame([("a", True), ("b", False)], "entry_id string, inside boolean"), "inside").collect()
    assert [(r.id, r.catalog_episodes, r.missing_total, r.total) for r in gaps] == [("b", 1, 2, 3), ("c", 0, 2, 3)]
    first, more = catalog.capped(e, [F.col("id")], 4)
    assert more and first.count() == 4 and not catalog.capped(e, [F.col("id")], 6)[1]
    assert catalog.with_element(spark.createDataFrame([(["X"],), ([],), (None,)], "c array<string>"), "c", "X").count() == 1
    edges = spark.createDataFrame([("a", 1, "a", 2, "r"), ("a", 2, "a", 3, "r"), ("a", 3, "a", 1, "r")], "from_type string, from_ref int, to_type string, to_ref int, relation string")
    start = spark.createDataFrame([("a", 1)], "kind string, ref int")
    assert {(r.ref, r.depth) for r in catalog.reachable(edges, start).collect()} == {(1, 0), (2, 1), (3, 2)}
    with pytest.raises(ValueError):
        catalog.reachable(edges, start, max_depth=1)
    assert {r.key: r.n for r in curation.coverage_report(curation.coverage(spark.createDataFrame([("x", True), ("y", False)], "t string, i boolean"), "i", ["t"])).select(F.col("value").alias("key"), F.col("ratio").alias("n")).collect()} == {"x": 2.0, "y": 0.0}


def test_channels_of_messages(spark):
    rows = [("f", i, "/a", "json", "S", 1_000_000_000 + i * 500_000_000, bytearray(json.dumps({"x": i, "y": {"z": 2 * i}}).encode())) for i in range(5)]
    rows += [("f", 5, "/b", "json", "T", 0, bytearray(b"7")), ("f", 6, "/b", "json", "T", 10, bytearray(b"{nope")), ("f", 7, "/c", "cdr", None, 0, bytearray(b"xx"))]
    found = spark.createDataFrame(rows, "file string, ordinal long, topic string, encoding string, schema_name string, log_time_ns long, payload binary")
    numbers = recordings.message_numbers(found)
    got = {r.topic: r for r in recordings.channel_summary(found, numbers).collect()}
    assert (got["/a"].messages, got["/a"].rate, got["/a"].n, got["/a"].high) == (5, 2.0, 10, 8.0) and got["/c"].n is None and got["/b"].n == 1
    assert {(r.topic, r.undecodable) for r in recordings.undecodable(found).collect()} == {("/a", 0), ("/b", 1), ("/c", 1)}
    assert tuple(recordings.scorable_topic(numbers).first()) == ("f", "/a", 2, 5)
    frames = recordings.topic_frames(numbers, "/a", ["x", "y.z"])
    assert [(r.t, r["x"], r["y.z"]) for r in frames.orderBy("t").collect()][1] == (1.5, 1.0, 2.0)
