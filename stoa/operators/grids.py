"""Sparse rasters: a table of occupied ``row, col`` cells; an absent cell is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.operators.components import connected_components


def occupancy(points: DataFrame, row: Column, col: Column, least: int = 1) -> DataFrame:
    """Cells with at least ``least`` points, and how many."""
    return points.groupBy(row.alias("row"), col.alias("col")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _shifts(cells: DataFrame, radius: int) -> DataFrame:
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    moved = cells.select("row", "col", F.explode(steps).alias("i")).select("row", "col", "i", F.explode(steps).alias("j"))
    return moved.select(F.col("row").alias("r0"), F.col("col").alias("c0"), (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col"))


def _inside(shape: tuple[int, int]) -> Column:
    return F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1)


def dilate(cells: DataFrame, radius: int, shape: tuple[int, int]) -> DataFrame:
    """Cells within a square of ``radius`` of an occupied one."""
    return _shifts(cells, radius).where(_inside(shape)).select("row", "col").distinct()


def erode(cells: DataFrame, radius: int, shape: tuple[int, int]) -> DataFrame:
    """Cells whose whole square within the raster is occupied: outside counts as occupied."""
    votes = _shifts(cells, radius).where(_inside(shape)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("k"))
    high = F.least(F.col("row") + radius, F.lit(shape[0] - 1)) - F.greatest(F.col("row") - radius, F.lit(0)) + 1
    wide = F.least(F.col("col") + radius, F.lit(shape[1] - 1)) - F.greatest(F.col("col") - radius, F.lit(0)) + 1
    return votes.where(F.col("k") == high * wide).select("row", "col").join(cells, ["row", "col"], "left_semi")


def components(cells: DataFrame, width: int) -> DataFrame:
    """``(row, col, component)``: 8-connected components, named by their first cell in row-major order."""
    name = F.col("row") * width + F.col("col")
    own = cells.select("row", "col", name.alias("node"))
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    links = own.select(F.col("node").alias("src"), "row", "col", F.explode(ahead).alias("s")).select("src", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    edges = links.join(own, ["row", "col"]).select("src", F.col("node").alias("dst"))
    return own.join(connected_components(edges), "node", "left").select("row", "col", F.coalesce("component", "node").alias("component"))
