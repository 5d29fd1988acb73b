"""Near boxes with many equals among them, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from stoa.operators import relations


def gap(a, b):
    dx, dy = max(a[1] - b[2], b[1] - a[2], 0.0), max(a[3] - b[4], b[3] - a[4], 0.0)
    return (dx * dx + dy * dy) ** 0.5


@pytest.fixture(scope="module")
def boxes():
    rng = random.Random(4)
    kinds = [(x, x + rng.choice([0.5, 3.0]), y, y + 0.5) for x, y in ((rng.randrange(30) / 2, rng.randrange(30) / 2) for _ in range(60))]
    return [(k, *rng.choice(kinds)) for k in rng.sample(range(10_000), 500)]


@pytest.mark.parametrize("most", [3, 1024])
def test_pairs_and_nearest_of_equal_boxes(spark, boxes, most):
    df = spark.createDataFrame([*boxes, (20_000, None, 1.0, 0.0, 1.0), (20_001, None, 1.0, 0.0, 1.0)], "id long, x0 double, x1 double, y0 double, y1 double")
    want = sorted((a[0], b[0], round(gap(a, b), 9)) for a in boxes for b in boxes if a[0] < b[0] and gap(a, b) <= 1.0)
    got = relations.near_pairs(df, "id", 1.0, most).select("a", "b", F.round("gap", 9)).collect()
    assert sorted(map(tuple, got)) == want
    near = {}
    for a in boxes:
        for far, dst in sorted((round(gap(a, b), 9), b[0]) for b in boxes if a[0] < b[0] and gap(a, b) <= 1.0)[:3]:
            near.setdefault(a[0], []).append(dst)
    assert sorted(map(tuple, relations.nearest_after(df, "id", 1.0, 3, 9, most).collect())) == sorted((s, d, k) for s, ds in near.items() for k, d in enumerate(ds, 1))


def test_a_hundred_thousand_equal_boxes(spark):
    """Their five billion pairs can't be made for three of each."""
    df = spark.range(100_000).selectExpr("id", "0.0D AS x0", "1.0D AS x1", "0.0D AS y0", "1.0D AS y1")
    got = relations.nearest_after(df, "id", 1.0, 3).agg(F.count("*"), F.sum("dst"), F.max(F.col("dst") - F.col("src"))).first()
    n = 100_000
    assert tuple(got) == (3 * (n - 3) + 3, sum(range(1, n)) + sum(range(2, n)) + sum(range(3, n)), 3)
