"""Cloud files and stateful streams."""

import datetime as dt

import numpy as np
import pytest

from stoa.sources import clouds
from stoa.streaming import events, navigation


def test_ply_round_trip(spark, tmp_path):
    clouds.register(spark)
    rows = [(float(i), i * 0.5, -1.0, i * 30, 300, -4) for i in range(10)]
    df = spark.createDataFrame(rows, "x float, y float, z float, r int, g int, b int").coalesce(1)
    path = str(tmp_path / "a.ply")
    df.write.format("ply").mode("append").save(path)
    got = spark.read.format("ply").option("block", "3").load(path).orderBy("point_id").collect()
    assert [tuple(r) for r in got] == [(i, x, y, z, min(r, 255), 255, 0) for i, (x, y, z, r, _, _) in enumerate(rows)]


@pytest.mark.parametrize("head", [b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n", b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n", b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n", b"none"])
def test_ply_refusals(head):
    with pytest.raises(ValueError):
        clouds.ply_header(head)


def test_npy(spark, tmp_path):
    clouds.register(spark)
    array = np.arange(42, dtype=np.float32).reshape(7, 6)
    np.save(tmp_path / "c.npy", array)
    got = spark.read.format("npycloud").option("block", "2").load(str(tmp_path / "c.npy")).orderBy("point_id").collect()
    assert [list(r)[1:] for r in got] == array.tolist()


def replay(spark, frame, schema, apply, folder, batches):
    """The rows that a stream gives when ``frame`` comes in so many files."""
    name = f"out_{batches}_{abs(hash(str(folder)))}"
    source = str(folder / f"in{batches}")
    for part in np.array_split(np.arange(len(frame)), batches):
        spark.createDataFrame([frame[i] for i in part], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = apply(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / f"cp{batches}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect())


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("batches", [1, 4])
def test_repeats_do_not_refresh(spark, tmp_path, batches):
    frame = [("a", at(s), "hi") for s in (0, 1.5, 1.9, 2.1)]
    got = replay(spark, frame, "robot_id string, ts timestamp, text string", events.without_repeats, tmp_path, batches)
    assert [r[1] for r in got] == [at(0), at(2.1)]


@pytest.mark.parametrize("batches", [1, 3])
def test_watchdog(spark, tmp_path, batches):
    frame = [("w", at(s), ok) for s, ok in ((0, False), (3, False), (6, False), (9, False), (12, False), (15, False), (18, True), (21, False))]
    got = replay(spark, frame, "iface string, ts timestamp, ok boolean", events.watchdog, tmp_path, batches)
    assert [(r[1], r[2]) for r in got] == [(at(6), 3)]  # three more fail by 15 s, within the cooldown; then it recovers


def test_frames(spark):
    lines = spark.createDataFrame([('{"command":"/api/robot_status","results":{"current_pose":{"x":1,"y":2,"theta":0.5}}}\n{"commanWd":"b"}\n\nbroken{',), ('{"type":"notification","code":"01002"}',)], "value string")
    got = events.frames(lines).collect()
    assert [(r["command"], r["code"]) for r in got] == [("/api/robot_status", None), ("b", None), (None, "01002")] and got[0]["pose"]["y"] == 2


@pytest.mark.parametrize("batches", [1, 3])
def test_navigation_state_outlives_batches(spark, tmp_path, batches):
    frame = [("r", at(k), code, target, markers) for k, (code, target, markers) in enumerate([("01101", None, ["A", "B"]), ("01001", "A", None), ("01002", None, None), ("01004", None, None), ("01104", None, None)])]
    got = replay(spark, frame, "robot_id string, ts timestamp, code string, target string, markers array<string>", navigation.navigation, tmp_path, batches)
    assert [tuple(r[3:]) for r in got] == [("running", -1, True, False, None), ("running", 0, True, False, None), ("running", 0, True, False, "A"), ("failed", 0, True, False, "A"), ("failed", 0, False, False, "A")]
