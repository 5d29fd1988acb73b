"""Holes of sparse rasters: empty cells that no path of empty neighbours joins to the raster's edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoa.operators.components import connected_components


def fill_holes(cells: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``(row, col)`` of occupied cells and holes. Paths go over the four sides; cells outside the raster are left out.

    The empty cells of a raster of ``shape`` are made from a range, linked to their right and lower neighbours and
    named by component; a component with no cell on the edge is a hole.
    """
    high, wide = shape
    inside = cells.where(F.col("row").between(0, high - 1) & F.col("col").between(0, wide - 1)).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    every = cells.sparkSession.range(high * wide).select(F.expr(f"id div {wide}").alias("row"), (F.col("id") % wide).alias("col"), F.col("id").alias("node"))
    empty = every.join(inside, ["row", "col"], "left_anti")
    right = empty.where(F.col("col") < wide - 1).select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    below = empty.where(F.col("row") < high - 1).select(F.col("node").alias("src"), (F.col("node") + wide).alias("dst"))
    edges = right.unionByName(below).join(empty.select(F.col("node").alias("dst")), "dst", "left_semi")
    named = empty.join(connected_components(edges), "node", "left").select("row", "col", F.coalesce("component", "node").alias("component"))
    border = (F.col("row") == 0) | (F.col("row") == high - 1) | (F.col("col") == 0) | (F.col("col") == wide - 1)
    open_ = named.where(border).select("component").distinct()
    return inside.unionByName(named.join(open_, "component", "left_anti").select("row", "col"))
