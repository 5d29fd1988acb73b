"""Pose costs and their search against plain numpy."""

import numpy as np
import pytest

from stoa.operators import poses


@pytest.fixture(scope="module")
def band(spark):
    rng = np.random.default_rng(4)
    field = rng.random((14, 11))
    at = rng.random((900, 2)) * [9, 12]
    laid = spark.createDataFrame([(r, c, float(field[r, c])) for r in range(14) for c in range(11)], "row long, col long, d double")
    return field, at, laid, spark.createDataFrame([tuple(map(float, p)) for p in at], "x double, y double")


def plain(field, at, pose, penalty, outside, least, unfit, resolution=1.0, origin=(0.0, 0.0)):
    c, s = np.cos(pose[2]), np.sin(pose[2])
    x, y = at[:, 0] * c - at[:, 1] * s + pose[0], at[:, 0] * s + at[:, 1] * c + pose[1]
    h, w = field.shape
    row, col = (h - 1) - (y - origin[1]) / resolution, (x - origin[0]) / resolution
    on = (row >= 0) & (row < h - 1) & (col >= 0) & (col < w - 1)
    if on.sum() < least:
        return unfit
    r, q = np.floor(row[on]).astype(int), np.floor(col[on]).astype(int)
    fr, fc = row[on] - r, col[on] - q
    d = (field[r, q] * (1 - fc) + field[r, q + 1] * fc) * (1 - fr) + (field[r + 1, q] * (1 - fc) + field[r + 1, q + 1] * fc) * fr
    return np.quantile(d, 0.5) + 0.35 * np.quantile(d, 0.75) + outside * penalty * (1 - on.sum() / len(at))


LIST = [(0.0, 0.0, 0.0), (1.0, 0.5, 0.2), (9.0, 12.0, np.pi), (50.0, 0.0, 0.0), (-3.0, 1.0, -0.4)]


@pytest.mark.parametrize("gathered", [10_000, 10])
def test_costs(spark, band, gathered):
    """By values and by narrowing histograms."""
    field, at, laid, points = band
    walls = poses.wall_guide(points, laid, 14, 11, 1.0, (0.0, 0.0), 2.0)
    known = poses.object_guide(points.limit(40), laid, 14, 11, 1.0, (0.0, 0.0), 2.0)
    some = np.array(points.limit(40).collect())
    got = poses.pose_costs(walls, LIST, known, 0.5, gathered)
    for pose, cost in zip(LIST, got, strict=True):
        own = plain(field, at, pose, 2.0, 0.6, 500, 1e6 + 2.0)
        want = own if own == 1e6 + 2.0 else own + 0.5 * plain(field, some, pose, 2.0, 0.8, 1, 3.0)
        assert cost == pytest.approx(want, abs=1e-9)
    assert got[3] == 1e6 + 2.0
    assert poses.pose_costs(poses.wall_guide(points.limit(0), laid, 14, 11, 1.0, (0.0, 0.0), 2.0), LIST[:1]) == [1e6 + 2.0]


def test_search_equals_a_plain_loop(spark, band):
    field, at, laid, points = band
    walls = poses.wall_guide(points, laid, 14, 11, 1.0, (0.0, 0.0), 2.0)
    bounds = [(-2.0, 2.0), (-2.0, 2.0), (-0.5, 0.5)]
    got = poses.search(lambda some: poses.pose_costs(walls, some), bounds, generations=2, size=3, seed=9, halvings=2)
    want = poses.search(lambda some: [plain(field, at, p, 2.0, 0.6, 500, 1e6 + 2.0) for p in some], bounds, generations=2, size=3, seed=9, halvings=2)
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])


def test_search_finds_a_minimum():
    at, least = poses.search(lambda some: [(x - 1.2) ** 2 + (y + 0.3) ** 2 + 2 * abs(np.sin(z - 0.5)) for x, y, z in some], [(-5.0, 5.0), (-5.0, 5.0), (-1.5, 1.5)], halvings=24)
    assert least < 1e-4 and at == pytest.approx((1.2, -0.3, 0.5), abs=1e-2)


def test_placed_points_keep_their_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, "a")], "id int, x double, y double, name string")
    r = poses.placed(df, (2.0, 3.0, np.pi / 2)).first()
    assert (r["id"], r["name"]) == (1, "a") and (r["x"], r["y"]) == (pytest.approx(2.0), pytest.approx(4.0))
