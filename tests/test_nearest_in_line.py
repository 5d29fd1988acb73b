"""The nearest along a line against all pairs, equal boxes and points counted once, waves over a graph."""

import random

import pytest
from pyspark.sql import functions as F

from stoa.operators import graph, points


@pytest.mark.parametrize(("limit", "cap", "step"), [(0.75, 6, 0.05), (2.0, 3, 0.7), (0.2, 4, 0.01)])
def test_nearest_equal_those_of_all_pairs(spark, limit, cap, step):
    rng = random.Random(int(limit * 100))
    rows = [(k, rng.randrange(-60, 60) * step) for k in rng.sample(range(9999), 400)]
    odd = [(20_000, None), (20_001, float("nan")), (20_002, float("inf"))]
    got = points.nearest_in_line(spark.createDataFrame(rows + odd, "k long, x double"), "k", "x", limit, cap).collect()
    want = [(a, b, r) for a, x in rows for r, (_, b) in enumerate(sorted((abs(x - y), b) for b, y in rows if a != b and abs(x - y) <= limit)[:cap], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_hundred_thousand_rows_at_one_place(spark):
    """Their five billion pairs can't be made for six of each."""
    df = spark.range(100_000).select("id", F.lit(1.5).alias("x"))
    got = points.nearest_in_line(df, "id", "x", 1.0, 2).where("item < 3 or item = 99999").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2), (99_999, 0, 1), (99_999, 1, 2)]


def test_large_waves_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "broadcast_if_small", lambda df: df)
    edges = spark.createDataFrame([(k, k * 2) for k in range(1, 40)] + [(k, k * 2 + 1) for k in range(1, 40)] + [(5, 1)], "src long, dst long")
    got = {r["node"]: r["hops"] for r in graph.distances(edges, 1).collect()}
    assert got == {k: k.bit_length() - 1 for k in range(1, 80)}


def test_places_of_a_graph_are_not_broadcast(spark, monkeypatch):
    from stoa.plans import graphs

    seen = []
    monkeypatch.setattr(graph, "distances", lambda edges, start: seen.append(edges) or edges)
    graphs.bfs_distances(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_equal_boxes_are_counted_once(spark, tmp_path):
    """200,000 boxes of 1,800 kinds over 20,000 points: pairs would be hundreds of millions."""
    from stoa.plans import clouds

    spark.range(200_000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(20_000).selectExpr("id AS p_partkey", "cast(id % 50 + 1 AS int) AS p_size", "900 + id % 1000 AS p_retailprice").withColumn("p_retailprice", F.col("p_retailprice").cast("double")).write.parquet(f"{tmp_path}/part.parquet")
    got = {r["box_id"]: r["n"] for r in clouds.box_counts(spark, str(tmp_path)).collect()}
    spots = [(k % 50 + 1, 900 + k % 1000) for k in range(20_000)]
    for b in (0, 77, 1877, 199_999):
        x0, y0 = b % 40, 900 + b * 37 % 900
        assert got[b] == sum(x0 <= x <= x0 + 8 and y0 <= y <= y0 + 150 for x, y in spots)
    assert len(got) == 200_000 and got[77] == got[77 + 1800]
