import random

import numpy as np

from stoa.operators import components
from stoa.operators.components import connected_components, stars


def test_components_of_random_graphs(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(5, 5), (100, 101), (101, 100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {(n, find(n)) for n in parent}
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {tuple(r) for r in got.collect()} == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 201


def test_small_edges_stay_in_few_partitions_and_leave_no_shuffles(spark):
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    try:
        edges = spark.range(300).selectExpr("id as src", "id + if(id % 10 = 9, 0, 1) as dst")
        groups = connected_components(edges)
        assert groups.rdd.getNumPartitions() <= 4
        assert {(r["node"], r["component"]) for r in groups.collect()} == {(i, i - i % 10) for i in range(300)}
        assert spark.conf.get(name, None) == setting
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _least(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in parent}


def test_stars_of_one_partition():
    random.seed(5)
    for nodes, rows in ((2, 1), (40, 25), (300, 280), (300, 900)):
        edges = {tuple(sorted(random.sample(range(-nodes, nodes), 2), reverse=True)) for _ in range(rows)}
        hi, lo = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        assert dict(zip(*(x.tolist() for x in stars(hi, lo)), strict=True)) == {n: c for n, c in _least(edges).items() if n != c}


def test_few_edges_take_few_jobs(spark):
    """A chain in one partition needs no steps: each has some ten jobs, whose plans the driver keeps."""
    context = spark.sparkContext
    context.setJobGroup("few-edges", "few-edges")
    try:
        edges = spark.range(400).selectExpr("id as src", "id + 1 as dst")
        got = {(r["node"], r["component"]) for r in connected_components(edges).collect()}
        jobs = len(context.statusTracker().getJobIdsForGroup("few-edges"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    assert got == {(n, 0) for n in range(401)} and jobs <= 12


def test_edges_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(components, "PART_ROWS", 16)
    random.seed(7)
    order = random.sample(range(500), 500)
    edges = [(order[i], order[i + 1]) for i in range(499) if i % 50 != 49] + [(600, n) for n in range(601, 700)]
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(8)
    assert {r["node"]: r["component"] for r in connected_components(frame).collect()} == _least(edges)


def test_components_of_named_nodes(spark):
    edges = [("b", "c"), ("a", "c"), ("x", "é"), ("y", "x")]
    got = connected_components(spark.createDataFrame(edges, "src string, dst string"))
    assert {r["node"]: r["component"] for r in got.collect()} == _least(edges)
