"""Joins whose tables look small to Spark but aren't, and sides of polygons compared in vectors."""

import random

import pytest
from pyspark.sql import functions as F

from stoa.functions import shapes
from stoa.operators import relations


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_meet_by_shuffle(spark):
    boxes = spark.range(1000).select("id", *[(F.col("id") * 1.0).alias(c) for c in ("x0", "x1", "y0", "y1")])
    assert "BroadcastHashJoin" not in plan(relations.box_pairs(boxes, "id", 0.5))


def test_sides_in_vectors(spark):
    rng = random.Random(5)
    rows = [tuple(float(rng.randrange(5)) for _ in range(8)) for _ in range(2000)] + [tuple(rng.random() * 4 for _ in range(8)) for _ in range(2000)]
    side = lambda n: F.struct(*[F.col(f"{n}{k}").alias(e) for k, e in enumerate(("ax", "ay", "bx", "by"))])
    df = spark.createDataFrame(rows, ", ".join(f"{n}{k} double" for n in "su" for k in range(4))).select(side("s").alias("s"), side("u").alias("u"))
    at = lambda s, e: (F.col(f"{s}.{e}x"), F.col(f"{s}.{e}y"))
    want = shapes.segment_distance(at("s", "a"), at("s", "b"), at("u", "a"), at("u", "b"))
    near = shapes.segments_meet(F.col("s"), F.col("u"), 0.5)
    got = df.select(shapes.side_distance(F.col("s"), F.col("u")).alias("d"), want.alias("w"), near.alias("near")).collect()
    assert all(r["d"] == pytest.approx(r["w"], abs=1e-12) for r in got)
    assert all(r["near"] for r in got if r["w"] <= 0.5) and not all(r["near"] for r in got)
