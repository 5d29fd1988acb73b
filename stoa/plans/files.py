"""Queries over cloud files: parts, as points, written by all tasks into one file and read back by ranges of records."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from stoa.plans.registry import query
from stoa.session import scratch, table
from stoa.sources import clouds, las, records

PLACED = "pt AS (SELECT p_partkey / 4.0::DOUBLE AS x, CAST(p_size AS DOUBLE) AS y, p_retailprice AS z, p_partkey * 7919 % 65536 AS red, row_number() OVER (ORDER BY p_partkey) - 1 AS point_id FROM part)"


def _points(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select((k / 4.0).alias("x"), F.col("p_size").cast("double").alias("y"), F.col("p_retailprice").alias("z"), (k * 7919 % 65536).alias("red"))
    return p.withColumns({"green": F.lit(1), "blue": F.lit(2)}).repartitionByRange(8, "x").sortWithinPartitions("x")


@query(f"WITH {PLACED} SELECT point_id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, least(red, 255) AS red FROM pt")
def ply_by_offsets(spark, sf):
    """One binary file of vertices, each of eight parts written at its own offset."""
    clouds.register(spark)
    path = scratch(spark, "cloud") + ".ply"
    records.write_ply(_points(spark, sf), path)
    read = spark.read.format("ply").option("block", "1000").load(path)
    return read.select(F.col("point_id").cast("long").alias("point_id"), "x", "y", "z", F.col("red").cast("long").alias("red"))


@query(f"WITH {PLACED} SELECT point_id, CAST(x AS FLOAT) AS x, CAST(z AS FLOAT) AS z FROM pt")
def npy_scan(spark, sf):
    """An array of points, a row each, read by ranges of its rows."""
    clouds.register(spark)
    path = scratch(spark, "cloud") + ".npy"
    records.write_npy(_points(spark, sf).select("x", "y", "z"), path)
    return spark.read.format("npycloud").option("block", "1000").load(path).select("point_id", "x", "z")


def _cut_las(spark, sf) -> str:
    """A file whose header claims seven points too many and whose last 30 bytes, a point and four bytes of another, are missing."""
    p = _points(spark, sf)
    path = scratch(spark, "cloud") + ".las"
    records.write_las(p, path, stated=p.count() + 7)
    place = records.mounted(path)
    os.truncate(place, max(227, os.path.getsize(place) - 30))
    return path


@query(f"WITH {PLACED} SELECT point_id, round(x, 3) AS x, round(z, 2) AS z, CAST(least(greatest(red // 256, 0), 255) AS BIGINT) AS red FROM pt WHERE point_id < (SELECT max(point_id) FROM pt) - 1")
def las_ranges(spark, sf):
    """Points of a LAS file that lies about their number and ends within one: only whole records are read, colours as bytes."""
    las.register(spark)
    read = spark.read.format("las").option("block", "1000").load(_cut_las(spark, sf))
    return read.select("point_id", F.round("x", 3).alias("x"), F.round("z", 2).alias("z"), las.byte_colour(F.col("red")).cast("long").alias("red"))


@query(f"""WITH {PLACED}, rd AS (SELECT * FROM pt WHERE point_id < (SELECT max(point_id) FROM pt) - 1) SELECT count(*) AS points, (SELECT count(*) + 7 FROM part) AS stated, CAST(22 AS BIGINT) AS tail, round(min(x), 3) AS x_low, round(max(x), 3) AS x_high,
CAST(sum(floor(CASE WHEN (SELECT max(red) FROM rd) > 255 THEN red / 257.0::DOUBLE ELSE red END)) AS BIGINT) AS reds FROM rd""")
def las_report(spark, sf):
    """What a cloud of the file holds against what its header claims, and its colours scaled from two bytes."""
    las.register(spark)
    path = _cut_las(spark, sf)
    place = records.mounted(path)
    with open(place, "rb") as f:
        head = las.las_header(f.read(375), os.path.getsize(place))
    read = las.with_colours(spark.read.format("las").option("block", "1000").load(path))
    stated, tail = F.lit(head.stated).cast("long").alias("stated"), F.lit(head.tail).cast("long").alias("tail")
    return read.agg(F.count(F.lit(1)).alias("points"), stated, tail, F.round(F.min("x"), 3).alias("x_low"), F.round(F.max("x"), 3).alias("x_high"), F.sum(F.floor("r")).alias("reds"))
