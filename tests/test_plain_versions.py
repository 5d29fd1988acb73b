"""Operators whose steps SQL doesn't say, against plain Python."""

import itertools
import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stoa.operators import chunks, graph, masks, quantiles, rooms


@pytest.fixture(scope="module")
def plane(spark):
    rng = random.Random(5)
    at = [(rng.random() * 10, rng.random() ** 2 * 6) for _ in range(400)]
    return at, spark.createDataFrame(at, "x double, y double")


def inside(at, b):
    return sum(b[0] <= x <= b[1] and b[2] <= y <= b[3] for x, y in at)


def test_small_boxes_merge(spark, plane):
    at, df = plane
    boxes = [(0, 2, 0, 3), (2, 5, 0, 3), (5, 10, 0, 3), (0, 5, 3, 6), (5, 10, 3, 6)]
    halo, least, most = 0.25, 60, 220
    wide = lambda b: (b[0] - halo, b[1] + halo, b[2] - halo, b[3] + halo)
    want = list(boxes)
    for _ in range(10):
        best = None
        for i, j in itertools.permutations(range(len(want)), 2):
            a, b = want[i], want[j]
            if inside(at, wide(a)) >= least:
                continue
            u = (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))
            n = inside(at, wide(u))
            gap = np.hypot(max(0, b[0] - a[1], a[0] - b[1]), max(0, b[2] - a[3], a[2] - b[3]))
            score = (n < least, gap, abs(n - (least + most) / 2), -n)
            if n <= most and (best is None or score < best[0]):
                best = (score, i, j, u)
        if best is None:
            break
        want = [b for k, b in enumerate(want) if k not in best[1:3]] + [best[3]]
    assert chunks.merged_boxes(df, boxes, halo, least, most) == want and len(want) < len(boxes)


def test_a_box_grows_to_enough_points(plane):
    at, df = plane
    got = chunks.grown_box(df, (4, 5, 1, 2), 50, 200, (0, 10, 0, 6), spare=20, halvings=12)
    assert 70 <= inside(at, got) <= 200 and got[0] <= 4 and got[3] >= 2
    assert inside(at, (got[0] + 0.05, got[1] - 0.05, got[2] + 0.05, got[3] - 0.05)) < 80
    assert chunks.grown_box(df, (0, 10, 0, 6), 50, 400, (0, 10, 0, 6), spare=20) == (0, 10, 0, 6)


def test_quantiles(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice([rng.random(), 1e12 * rng.random(), -3.0, None])) for g in range(4) for _ in range(g * 700 + 1)]
    got = quantiles.quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [0.0, 0.02, 0.5, 1.0]).collect()
    for r in got:
        own = [v for g, v in rows if g == r["g"] and v is not None]
        assert r["v"] == pytest.approx(np.quantile(own, r["share"]), rel=1e-12)
    assert len(got) == 4 * len({g for g, v in rows if v is not None})


def test_first_shortest_paths(spark):
    rng = random.Random(7)
    near = {f"n{i}": rng.sample([f"n{j}" for j in range(14)], 3) for i in range(14)}
    marked = {f"n{i}" for i in range(0, 14, 2)}

    def bfs(start, through):
        found, queue = {start: []}, deque([start])
        while queue:
            node = queue.popleft()
            if through is not None and node != start and node not in through:
                continue
            for n in near[node]:
                if n not in found:
                    found[n] = [*found[node], n]
                    queue.append(n)
        return found

    edges = spark.createDataFrame([(a, b, k) for a, own in near.items() for k, b in enumerate(own)], "src string, dst string, place int")
    starts = spark.createDataFrame([("n0",), ("n5",)], "start string")
    for through in (None, marked):
        allowed = None if through is None else spark.createDataFrame([(n,) for n in through], "node string")
        got = {(r["start"], r["node"]): r["path"] for r in graph.shortest_paths(edges, starts, allowed).collect()}
        assert got == {(s, n): p for s in ("n0", "n5") for n, p in bfs(s, through).items()}


def test_least_cost_assignment():
    rng = np.random.default_rng(8)
    for _ in range(40):
        n, m = sorted(rng.integers(1, 6, 2))
        cost = rng.random((n, m))
        got = rooms.hungarian(cost)
        least = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), int(n)))
        assert len(got) == n and sum(cost[i, j] for i, j in got) == pytest.approx(least)


def test_greedy_matches_below_half():
    """At an overlap of a quarter a mask may reach two instances: the first takes it."""
    rows = [(1, 10, 0.9, 0.4, 0.0), (2, 10, 0.9, 0.3, 0.0), (2, 11, 0.8, 0.3, 0.0), (2, 12, 0.7, 0.26, 0.0), (3, 12, 0.7, 0.1, 0.0), (3, None, None, None, None), (None, 13, 0.6, None, 0.5), (None, 14, 0.5, None, 0.1)]
    pairs = pd.DataFrame(rows, columns=["instance", "mask_id", "score", "share", "ignored"])
    got = sorted(masks.match(pairs, [0.25]))
    assert got == sorted([(0.25, 0.9, 1, 0), (0.25, 0.7, 0, 0), (0.25, 0.8, 1, 0), (0.25, 0.0, 0, 1), (0.25, 0.5, 0, 0)])


def test_simplified_outline():
    ring = [[0, 0], [1, 0.01], [2, 0], [2, 1], [2.01, 2], [0, 2]]
    assert rooms.simplified(ring, 0.1) == [[0, 0], [2, 0], [2.01, 2], [0, 2]]
    assert rooms.simplified([[0, 0], [1, 1]], 0.1) == [[0, 0], [1, 1]]


def test_skewed_join(spark):
    from stoa.session import join_skewed

    rows = spark.createDataFrame([(0, i) for i in range(500)] + [(k, k) for k in range(1, 2500)], "k int, v int")
    names = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = join_skewed(rows, names, "k", "n")
    assert got.columns == ["k", "v", "top"] and got.count() == rows.count() and got.where("k = 0 and top = 499").count() == 500
