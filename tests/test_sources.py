import json
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from kinetrace.sources import records, recordings


def _dataset(root, version):
    (root / "meta").mkdir()
    (root / "meta/info.json").write_text(json.dumps({"codebase_version": version}))
    (root / "data/chunk-000").mkdir(parents=True)

    def table(*numbers):
        rows = [(n, i, [0.5 * i, 1.0]) for n in numbers for i in range(3)]
        return pa.table({"episode_index": [r[0] for r in rows], "frame_index": [r[1] for r in rows], "action": [r[2] for r in rows]})

    if version == "v3.0":
        (root / "meta/episodes/chunk-000").mkdir(parents=True)
        pq.write_table(pa.table({"episode_index": [0, 1], "length": [3, 3], "tasks": [["a"], ["b"]]}), root / "meta/episodes/chunk-000/file-000.parquet")
        pq.write_table(table(0, 1), root / "data/chunk-000/file-000.parquet")
    else:
        lines = [{"episode_index": 0, "length": 9, "tasks": ["old"]}, {"episode_index": 1, "length": 3, "tasks": ["b"]}, {"episode_index": 0, "length": 3, "tasks": ["a"]}]
        (root / "meta/episodes.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
        for n in (0, 1):
            pq.write_table(table(n), root / f"data/chunk-000/episode_{n:06d}.parquet")
    return str(root)


@pytest.mark.parametrize("version", ["v2.0", "v2.1", "v3.0"])
def test_datasets(spark, tmp_path, version):
    path = _dataset(tmp_path, version)
    index = recordings.episode_index(spark, path)
    assert [(r.episode_index, r.length, r.tasks) for r in index.orderBy("episode_index").collect()] == [(0, 3, ["a"]), (1, 3, ["b"])]
    assert recordings.sniff(spark, path) == "dataset"
    assert {r.episode_index for r in recordings.frames(spark, path).collect()} == {0}
    assert recordings.frames(spark, path, "episode_index=1").count() == 3
    assert recordings.frames(spark, path, every=True).count() == 6
    for bad in ("7", "x"):
        with pytest.raises(recordings.UnreadableRecording):
            recordings.frames(spark, path, bad)


def test_unknown_version(spark, tmp_path):
    with pytest.raises(recordings.UnreadableRecording):
        recordings.read_info(spark, _dataset(tmp_path, "v9"))


def _container(packed):
    def text(x):
        return struct.pack("<I", len(x)) + x

    def record(op, body):
        return struct.pack("<BQ", op, len(body)) + body

    body = record(3, struct.pack("<H", 1) + text(b"S") + text(b"jsonschema") + text(b"{}"))
    body += record(4, struct.pack("<HH", 5, 1) + text(b"/a") + text(b"json") + struct.pack("<I", 0))
    for i, payload in enumerate((b'{"x": 1, "y": [2.5, true, "s", null]}', b"nonsense", b"7")):
        body += record(5, struct.pack("<HIQQ", 5, i, 1000 + i, 0) + payload)
    if packed:
        data = zstandard.ZstdCompressor().compress(body)
        body = record(6, struct.pack("<QQQI", 0, 9, len(body), 0) + text(b"zstd") + struct.pack("<Q", len(data)) + data)
    return recordings.MAGIC + record(1, text(b"") + text(b"t")) + body + record(15, b"\0" * 4) + record(2, b"\0" * 20) + recordings.MAGIC


@pytest.mark.parametrize("packed", [False, True])
def test_containers(spark, tmp_path, packed):
    (tmp_path / "log.mcap").write_bytes(_container(packed))
    path = str(tmp_path / "log.mcap")
    assert recordings.sniff(spark, path) == "container"
    found = recordings.messages(spark, path)
    assert [(r.ordinal, r.topic, r.encoding, r.schema_name, r.log_time_ns) for r in found.orderBy("ordinal").collect()] == [(i, "/a", "json", "S", 1000 + i) for i in range(3)]
    numbers = recordings.message_numbers(found).orderBy("ordinal", "dimension").collect()
    assert [(r.ordinal, r.dimension, r.value) for r in numbers] == [(0, "x", 1.0), (0, "y[0]", 2.5), (2, "value", 7.0)]


def test_cut_off_container_is_an_error():
    with pytest.raises(recordings.UnreadableRecording):
        list(recordings.container_messages(_container(False)[:-60]))


def test_metric_log(spark, tmp_path):
    good = {"name": "m", "value": 1, "labels": {"k": "v"}, "timestamp": "2024-01-01T00:00:00"}
    (tmp_path / "log.jsonl").write_text("\n".join(["", "{broken", '{"name": "n"}', json.dumps(good), json.dumps(good | {"timestamp": "soon"})]))
    found = records.metric_records(spark, str(tmp_path / "log.jsonl"))
    assert [r.ts is not None for r in records.newest(found, 5).collect()] == [True, False]
    assert not found.where(records.refused(F.col("name"), F.col("labels"))).count()


def test_upserts(spark):
    table = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, seq long, x string")
    new = spark.createDataFrame([(2, 1, "c"), (3, 2, "d"), (3, 1, "e"), (1, 0, "f")], "k long, seq long, x string")

    def rows(df):
        return sorted((r.k, r.x) for r in df.collect())

    assert rows(records.insert_absent(table, new, ["k"], "seq")) == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(records.replace_latest(table, new, ["k"], "seq")) == [(1, "a"), (2, "c"), (3, "d")]
    runs = spark.createDataFrame([("p", 1, True), ("p", 2, False), ("q", 1, True)], "episode_id string, seq long, passed boolean")
    assert {tuple(r) for r in records.validation_states(runs).collect()} == {("p", "quarantined"), ("q", "valid")}


def test_synthetic_episodes(spark):
    a, b, c = [[1.0], [2.0]], [[1.0], [2.0, 3.0]], [0.0, 1.0]
    cases = [(1, c, a, a), (2, c, b, a), (3, [1.0, 0.0], a, a), (4, c, a, a[:1]), (5, [], [], [])]
    df = spark.createDataFrame(cases, "id long, timestamps array<double>, observations array<array<double>>, actions array<array<double>>")
    found = {r.id: r.problem for r in records.episode_problems(df).collect()}
    assert found == {1: None, 2: "widths differ", 3: "time runs back", 4: "lengths differ", 5: "empty"}
    assert records.episode_frames(df.where("id = 1"), "id").count() == 2


def test_lz4_frames():
    def frame(*blocks, flags=0x60):
        return b"\x04\x22\x4d\x18" + bytes([flags, 0x40, 0]) + b"".join(struct.pack("<I", len(b) | raw) + b for b, raw in blocks) + bytes(4)

    literals = bytes([0x50]) + b"hello"
    assert recordings.lz4_frame(frame((literals, 0))) == b"hello"
    overlap = bytes([0x1F]) + b"a" + struct.pack("<H", 1) + bytes([0]) + bytes([0x10]) + b"b"
    assert recordings.lz4_frame(frame((overlap, 0))) == b"a" * 20 + b"b"
    many = bytes([0xF0, 255, 15]) + b"x" * 285
    assert recordings.lz4_frame(frame((many, 0), (b"raw", 1 << 31))) == b"x" * 285 + b"raw"
    linked = frame((literals, 0), (bytes([0x01]) + struct.pack("<H", 5) + bytes([0x10]) + b"!", 0), flags=0x40)
    assert recordings.lz4_frame(linked) == b"hellohello!"
    with pytest.raises(recordings.UnreadableRecording):
        recordings.lz4_frame(frame((bytes([0x01]) + struct.pack("<H", 9) + bytes([0x10]) + b"!", 0)))
