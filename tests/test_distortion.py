"""Elastic distortion against whole lattices in numpy with the same draws."""

import hashlib
import math

import numpy as np
import pytest

from stoa.operators import distortion


def plain(points: np.ndarray, scene: int, granularity: float, magnitude: float, seed: int) -> np.ndarray:
    low = points.min(0)
    dim = ((points - low).max(0) // granularity).astype(int) + 3
    noise = np.empty((*dim, 3))
    for i, j, k in np.ndindex(*dim):
        for a in range(3):
            text = hashlib.md5(f"{scene}:{i}:{j}:{k}:{3 * seed + a}".encode()).hexdigest()
            noise[i, j, k, a] = math.sqrt(-2 * math.log((int(text[:8], 16) + 1) / 2**32)) * math.cos(2 * math.pi * int(text[8:16], 16) / 2**32)
    for _ in range(2):
        for axis in range(3):
            wide = np.pad(noise, [(1, 1) if a == axis else (0, 0) for a in range(4)])
            noise = sum(np.take(wide, np.arange(s, s + noise.shape[axis]), axis) for s in range(3)) / 3
    u = (points - low) / granularity + 1
    base, part = np.floor(u).astype(int), u - np.floor(u)
    moved = points.copy()
    for c in np.ndindex(2, 2, 2):
        at = base + c
        share = np.prod(np.where(np.array(c) == 1, part, 1 - part), 1)
        moved += magnitude * share[:, None] * noise[at[:, 0], at[:, 1], at[:, 2]]
    return moved


def test_equals_whole_lattices(spark):
    """Two scenes, one of a single point; missing coordinates, scenes and columns that come along stay."""
    rng = np.random.default_rng(3)
    clouds = {1: rng.normal(size=(60, 3)) * (1.5, 0.4, 0.1), 2: np.array([[5.0, 5.0, 5.0]])}
    rows = [(s, n, *map(float, p)) for s, c in clouds.items() for n, p in enumerate(c)]
    odd = [(1, 900, None, 1.0, 1.0), (1, 901, float("nan"), 1.0, 1.0), (None, 902, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows + odd, "scene long, n long, x double, y double, z double").selectExpr("x", "scene", "n", "y", "z", "n * 2 as more")
    out = distortion.elastic(df, "scene", ((0.2, 0.4), (0.8, 1.6)), 1.0, 5)
    assert out.columns == df.columns
    got = {(r["scene"], r["n"]): r for r in out.collect()}
    assert len(got) == len(rows) + 3
    for s, c in clouds.items():
        want = plain(plain(c, s, 0.2, 0.4, 6), s, 0.8, 1.6, 7)
        have = np.array([[got[s, n][a] for a in "xyz"] for n in range(len(c))])
        assert np.allclose(have, want, atol=1e-9) and np.abs(have - c).max() > 0.01
    assert got[1, 900]["x"] is None and got[1, 900]["y"] == 1.0 and got[None, 902]["x"] == 1.0 and math.isnan(got[1, 901]["x"]) and got[1, 5]["more"] == 10


def test_no_rows_no_chance_and_own_names(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 2.0)], "scene long, x double, y double, z double")
    assert distortion.elastic(df, "scene", chance=0.0).collect() == df.collect()
    assert distortion.elastic(df.limit(0), "scene", chance=1.0).collect() == []
    with pytest.raises(ValueError, match="begin with _"):
        distortion.elastic(df.withColumnRenamed("x", "_x"), "scene")
