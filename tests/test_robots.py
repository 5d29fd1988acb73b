"""Splines, LAS files and the navigation state."""

import datetime as dt
import struct

import numpy as np
import pytest

from stoa.operators import splines
from stoa.sources import las
from stoa.streaming import navigation


def test_spline_meets_knots_with_still_ends(spark):
    rng = np.random.default_rng(3)
    t, y = np.sort(rng.choice(300, 9, replace=False)) / 100, rng.normal(size=9)
    t -= t[0]
    m = splines.second_derivatives(t, y)
    n, h = len(t), np.diff(t)
    full, right = np.zeros((n, n)), np.zeros(n)
    for i in range(n):  # the same conditions, solved as a dense system
        left, after = h[i - 1] if i else 0, h[i] if i < n - 1 else 0
        full[i, i] = 2 * (left + after)
        if i:
            full[i, i - 1] = left
        if i < n - 1:
            full[i, i + 1] = after
        right[i] = 6 * (((y[i + 1] - y[i]) / after if after else 0) - ((y[i] - y[i - 1]) / left if left else 0))
    assert np.allclose(m, np.linalg.solve(full, right))
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(t, y)] + [("b", 0.0, 1.0), ("b", 0.5, 2.0), ("c", None, 1.0)], "k string, t double, y double")
    got = splines.held(splines.resampled(df, ["k"]), ["k"], 2).orderBy("k", "step").collect()
    a = {round(r["t"], 2): r for r in got if r["k"] == "a"}
    assert all(abs(a[round(p, 2)]["position"] - q) < 1e-6 for p, q in zip(t, y))
    assert abs(a[0.0]["velocity"]) < 1e-9 and abs(a[round(t[-1], 2)]["velocity"]) < 1e-6
    assert [(r["step"], r["position"]) for r in got if r["k"] == "b"] == [(0, 1.0), (1, 2.0), (2, 2.0), (3, 2.0)]
    assert not [r for r in got if r["k"] == "c"]


def las_bytes(form, rows, stated, tail=b"", packed=0):
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, form | packed, {1: 28, 3: 34}[form], stated)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.1, 10.0, 0.0, -1.0)
    body = b"".join(struct.pack("<iiiH", *r[:4]) + bytes(14) + (struct.pack("<3H", *r[4:]) if form == 3 else b"") for r in rows)
    return bytes(head) + body + tail


def test_las(spark, tmp_path):
    las.register(spark)
    rows = [(i, -i, 3 * i, 100 + i, 256 * i, 65535, 7) for i in range(5)]
    (tmp_path / "a.las").write_bytes(las_bytes(3, rows, 99, b"12345"))
    got = spark.read.format("las").option("block", "2").load(str(tmp_path / "a.las")).orderBy("point_id").collect()
    assert [tuple(r)[4:] for r in got] == [r[3:] for r in rows]
    assert np.allclose([tuple(r)[1:4] for r in got], [(10 + i * 0.01, -i * 0.01, i * 0.3 - 1) for i in range(5)])
    (tmp_path / "b.las").write_bytes(las_bytes(1, rows, 5))
    plain = spark.read.format("las").load(str(tmp_path / "b.las"))
    assert plain.columns == ["point_id", "x", "y", "z", "intensity"]
    assert [r["r"] for r in las.with_colours(plain, colours=None).orderBy("point_id").collect()] == [0.0, 63.75, 127.5, 191.25, 255.0]
    head = las.las_header(las_bytes(3, rows, 99, b"12345"), 227 + 5 * 34 + 5)
    assert (head.points, head.stated, head.tail) == (5, 99, 5)
    for bad in (b"none", las_bytes(3, [], 0, packed=128)):
        with pytest.raises(ValueError):
            las.las_header(bad, 300)


def test_navigation(spark):
    notes = [
        ("r", 1, "01101", None, ["A", "B"]), ("r", 2, "01001", "A", None), ("r", 3, "01002", None, None), ("r", 4, "01001", "B", None),
        ("r", 5, "01002", "B", None), ("r", 6, "01102", None, None), ("r", 7, "01001", "Z", None), ("r", 8, "01002", None, None),
        ("r", 9, "02003", None, None), ("r", 10, "02004", None, None), ("r", 11, None, None, None), ("s", 1, "01005", None, None),
    ]
    df = spark.createDataFrame([(k, dt.datetime(2024, 1, 1, 0, 0, s), c, t, m) for k, s, c, t, m in notes], "robot_id string, ts timestamp, code string, target string, markers array<string>")
    got = navigation.navigation(df).orderBy("robot_id", "ts").collect()
    assert [(r["status"], r["cruise_index"], r["cruise_active"], r["cruise_done"], r["reached"]) for r in got] == [
        ("running", -1, True, False, None), ("running", 0, True, False, None), ("running", 0, True, False, "A"), ("running", 1, True, False, "A"),
        ("running", 1, True, False, "B"), ("succeeded", 1, False, True, "B"), ("running", 1, False, True, "B"), ("succeeded", 1, False, True, "Z"),
        ("failed", 1, False, False, "Z"), ("failed", 1, False, False, "Z"), ("running", -1, False, False, None),
    ]


def test_answered(spark):
    shape = "audio_id string, ts timestamp"
    at = lambda s: dt.datetime(2024, 1, 1, 0, s // 60, s % 60)
    asked = spark.createDataFrame([("a", at(0)), ("b", at(5)), ("c", at(9))], shape)
    done = spark.createDataFrame([("a", at(60)), ("b", at(66)), ("c", at(8))], shape)
    assert [tuple(r) for r in navigation.answered(asked, done).collect()] == [("a", at(0), at(60))]
