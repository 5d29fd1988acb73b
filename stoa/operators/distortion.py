"""Elastic distortion of scenes: smooth noise on a coarse lattice moves each point by what lies around it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.operators.sampling import draw, share
from stoa.session import broadcast_if_small, written

AXES = "xyz"
NODE = ["i", "j", "k"]


def gaussian(keys: list[str], seed: int) -> Column:
    """A draw of the standard normal distribution by a hash of the keys, the same on every engine."""
    part = lambda at: F.conv(F.substring(draw(keys, seed), at, 8), 16, 10).cast("double")
    return F.sqrt(-2 * F.log((part(1) + 1) / float(1 << 32))) * F.cos(2 * math.pi * part(9) / float(1 << 32))


def _smoothed(nodes: DataFrame, axis: str, size: str, values: list[str]) -> DataFrame:
    """Means of three along an axis, twice; beyond the lattice there is nothing, so the weights fall at its ends."""
    near = nodes.withColumn("_to", F.explode(F.sequence(F.greatest(F.col(axis) - 2, F.lit(0)), F.least(F.col(axis) + 2, F.col(size) - 1))))
    a, b = F.col(axis), F.col("_to")
    ways = F.least(F.least(a, b) + 1, F.col(size) - 1) - F.greatest(F.greatest(a, b) - 1, F.lit(0)) + 1
    weight = F.greatest(ways, F.lit(0)) / 9.0
    keys = [c for c in nodes.columns if c not in (axis, *values)]
    return near.groupBy(*keys, F.col("_to").alias("_at")).agg(*[F.sum(weight * F.col(v)).alias(v) for v in values]).withColumnRenamed("_at", axis)


def distorted(points: DataFrame, scene: str, granularity: float, magnitude: float, seed: int) -> DataFrame:
    """``points`` with ``x, y, z`` moved by ``magnitude`` times noise, smooth over some ``granularity``.

    The lattice starts a step below a scene's least corner. Only nodes near points are made, their noise by hash: what is
    shuffled before the points' own join grows with the occupied coarse cells. Points with a null or NaN coordinate stay.
    """
    fine = F.col(scene).isNotNull()
    for a in AXES:
        fine &= F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double"))
    ends = points.where(fine).groupBy(scene).agg(*[f(a).cast("double").alias(f"_{n}{a}") for a in AXES for n, f in (("l", F.min), ("h", F.max))])
    ends = ends.select(F.col(scene).alias("_scene"), *[F.col(f"_l{a}") for a in AXES], *[(F.floor((F.col(f"_h{a}") - F.col(f"_l{a}")) / granularity) + 3).alias(f"_n{a}") for a in AXES])
    ends = written(ends, "extents")
    u = {a: F.when(fine, (F.col(a) - F.col(f"_l{a}")) / granularity + 1) for a in AXES}
    placed = points.join(broadcast_if_small(ends), F.col(scene) == F.col("_scene"), "left").withColumns({f"_{n}": F.floor(u[a]) for n, a in zip(NODE, AXES, strict=True)} | {f"_f{a}": u[a] - F.floor(u[a]) for a in AXES})
    sizes = [f"_n{a}" for a in AXES]
    cells = written(placed.where("_i is not null and _j is not null and _k is not null").select("_scene", *[f"_{n}" for n in NODE], *sizes).distinct(), "cells")
    spread = cells
    for n, size in zip(NODE, sizes, strict=True):  # a cell's corners and two nodes around each
        spread = spread.select("*", F.explode(F.sequence(F.greatest(F.col(f"_{n}") - 2, F.lit(0)), F.least(F.col(f"_{n}") + 3, F.col(size) - 1))).alias(n)).drop(f"_{n}").distinct()
    values = [f"_d{a}" for a in AXES]
    nodes = spread.select("*", *[gaussian(["_scene", *NODE], 3 * seed + k).alias(v) for k, v in enumerate(values)])
    for n, size in zip(NODE, sizes, strict=True):
        nodes = _smoothed(nodes, n, size, values)
    corners = F.array(*[F.struct(F.lit(c).alias("c"), *[(F.col(f"_{n}") + (c >> s & 1)).alias(n) for s, n in enumerate(NODE)]) for c in range(8)])
    asked = cells.select("_scene", *[f"_{n}" for n in NODE], F.explode(corners).alias("e")).select("_scene", *[f"_{n}" for n in NODE], "e.*")
    held = asked.join(nodes, ["_scene", *NODE]).groupBy("_scene", *[f"_{n}" for n in NODE]).agg(F.sort_array(F.collect_list(F.struct("c", *values))).alias("_corners"))  # eight a cell
    met = placed.join(broadcast_if_small(written(held, "noise")), ["_scene", *[f"_{n}" for n in NODE]], "left")
    weight = lambda c: (F.col("_fx") if c & 1 else 1 - F.col("_fx")) * (F.col("_fy") if c & 2 else 1 - F.col("_fy")) * (F.col("_fz") if c & 4 else 1 - F.col("_fz"))
    moved = {a: F.col(a) + magnitude * F.coalesce(sum((weight(c) * F.get("_corners", F.lit(c))[v] for c in range(8)), F.lit(0.0)), F.lit(0.0)) for a, v in zip(AXES, values, strict=True)}
    return met.select(*[moved[c].alias(c) if c in AXES else F.col(c) for c in points.columns])


def elastic(points: DataFrame, scene: str, steps: tuple[tuple[float, float], ...] = ((0.2, 0.4), (0.8, 1.6)), chance: float = 0.95, seed: int = 0) -> DataFrame:
    """Scenes distorted by each ``(granularity, magnitude)`` in turn, each scene with the given ``chance``; the others stay, and so do points without scene."""
    if any(c.startswith("_") for c in points.columns):
        raise ValueError("names that begin with _ are the operator's own")
    chosen = F.coalesce(share([scene], seed) < chance, F.lit(False))
    df, kept = points.where(chosen), points.where(~chosen)
    for k, (granularity, magnitude) in enumerate(steps):
        df = written(distorted(df, scene, granularity, magnitude, seed + k + 1), "moved")
    return df.unionByName(kept)
